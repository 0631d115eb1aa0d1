"""Links between notes: backlinks, resolution, and the checks that are anti and semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.functions import text
from notewell.operators import notes as N
from notewell.sources.shared import written


def backlinks(notes: DataFrame, keep_duplicates: bool = True) -> DataFrame:
    """(name, rel, src_name, src_rel, src_tier, line): a row for each body link to a note, duplicates kept."""
    # A link's row carries its source's trust, and names come from paths alone, so that the notes are parsed once.
    found = notes.select(F.col("rel").alias("src_rel"), F.col("name").alias("src_name"), F.col("tier").alias("src_tier"), F.explode("links").alias("l"))
    found = found.select(text.link_key(F.col("l.target")).alias("link_key"), "src_rel", "src_name", "src_tier", "l.line")
    if not keep_duplicates:
        found = found.dropDuplicates(["link_key", "src_rel"])
    named = N.with_key(notes).select("note_key", "name", "rel")
    return found.join(named, found.link_key == named.note_key).select("name", "rel", "src_name", "src_rel", "src_tier", "line")


def link_targets(notes: DataFrame) -> DataFrame:
    """(rel, ord, target): each note's targets, body before frontmatter, the first of each kept."""
    order = Window.partitionBy("rel").orderBy(F.col("surface") != "body", "ord")
    rows = N.links(notes).withColumn("_n", F.row_number().over(order))
    first = rows.groupBy("rel", "target").agg(F.min("_n").alias("ord"))
    return first.select("rel", "ord", "target")


def resolve(notes: DataFrame, slug: str) -> DataFrame:
    """Notes whose slug path is the slug or ends with it at a boundary."""
    needle = text.slug_path(F.lit(slug))
    own = text.slug_path(text.strip_md(F.col("rel")))
    return notes.where((own == needle) | F.endswith(own, F.concat(F.lit("/"), needle)))


def resolve_many(notes: DataFrame, needles: DataFrame, needle: str = "needle") -> DataFrame:
    """(needle, rel): the same for a table of slugs.  Each note lists its path's suffixes, so the join is on equality."""
    parts = F.split(text.slug_path(text.strip_md(F.col("rel"))), "/")
    suffixes = notes.select("rel", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_suffix"))
    asked = needles.select(F.col(needle).alias("needle"), text.slug_path(F.col(needle)).alias("_suffix"))
    return asked.join(suffixes, "_suffix").select("needle", "rel")


def tag_counts(notes: DataFrame, by: str | None = None) -> DataFrame:
    """(tag, n): occurrences; a tag that one file names twice counts twice.  In order ``by`` name, or count (then name)."""
    counted = _tag_counts(notes)
    return counted if by is None else counted.orderBy("tag") if by == "name" else counted.orderBy(F.desc("n"), "tag")


def _tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def listing(notes: DataFrame, kind: str, extra: str | None = None, drop_superseded: bool = False, in_order: bool = False) -> DataFrame:
    """(rel, line): ``name — description [tags] (field: value)`` of the notes of a type, templates left out."""
    rows = notes.where((F.col("type") == kind) & ~F.col("is_template"))
    if drop_superseded:
        rows = rows.where("tier <> 'superseded'")
    desc = F.when(F.col("description") != "", F.concat(F.lit(" — "), "description")).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    value = text.shown(F.col("fm")[extra]["display"]) if extra else F.lit("")
    more = F.when(value != "", F.concat(F.lit(f" ({extra}: "), value, F.lit(")"))).otherwise("")
    mark = F.when(F.col("tier") == "superseded", "[superseded] ").otherwise("")
    lines = rows.select("rel", F.concat(mark, "name", desc, tags, more).alias("line"), "name")
    return (lines.orderBy("name", "rel") if in_order else lines).select("rel", "line")


def files_by_tag(notes: DataFrame, tag: str) -> DataFrame:
    """(rel) of the notes with a tag, by path."""
    return notes.where(F.array_contains("tags", tag)).select("rel").orderBy("rel")


def get(notes: DataFrame, slug: str, drop_superseded: bool = False) -> tuple[DataFrame, int]:
    """The notes that a slug names, and the exit code: 1 if there is none.  Superseded ones go before they are counted."""
    found = resolve(notes.where("tier <> 'superseded'") if drop_superseded else notes, slug)
    return found, 0 if found.limit(1).count() else 1


def projects(notes: DataFrame, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Notes at most two folders below ``root``, by the depth of their path."""
    depth = F.size(F.split("rel", "/")) - len(root.split("/"))
    return notes.where(text.in_folder(F.col("rel"), root) & (depth <= 2) & ~F.col("name").isin(*exclude))


def ticket_owner() -> Column:
    """The slug of the track that a ticket's first track link names."""
    return F.regexp_replace(text.resolve_name(F.get(F.col("fm")["track"]["links"], F.lit(0))["target"]), "^track-", "")


def roster_check(notes: DataFrame) -> DataFrame:
    """(rel, slug, near): tickets of tracks that no note is, with the tracks whose slug has the same first part."""
    # Tracks are looked at twice and tickets once; what is asked of both is written, so that the notes are parsed once.
    asked = written(notes.where("type in ('track', 'ticket')").select("rel", "type", F.when(F.col("type") == "track", F.col("fm")["slug"]["display"]).otherwise(ticket_owner()).alias("slug")), "roster")
    known = asked.where("type = 'track'").select("slug")
    first = lambda c: F.substring_index(c, "-", 1)
    near = known.groupBy(first("slug").alias("_first")).agg(F.array_sort(F.collect_set("slug")).alias("near"))
    lost = asked.where("type = 'ticket'").select("rel", "slug").where("slug is not null").join(known, "slug", "left_anti")
    return lost.withColumn("_first", first("slug")).join(near, "_first", "left").select("rel", "slug", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
