"""Reading notes by address: overviews, unfolding, reserved addresses, frontmatter paths, checks of the structure."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.functions import text
from notewell.operators import graph, sections
from notewell.operators import notes as N


def reserved(address: Column) -> Column:
    """What a reserved address reads: text, links, fm, or fm-path with a path; null for any other address."""
    lower = F.lower(address)
    path = F.regexp_extract(address, r"^(?i:frontmatter|fm)\.(.+)$", 1)
    kind = F.when((address == "0") | (lower == "text"), "text").when(lower == "links", "links").when(lower.isin("frontmatter", "fm"), "fm").when(path != "", "fm-path")
    return F.when(kind.isNotNull(), F.struct(kind.alias("reading"), F.nullif(path, F.lit("")).alias("path")))


def shadows(ranges: DataFrame) -> DataFrame:
    """(rel, address, text, reading): headings whose slug is a reserved address; they can be reached by number only."""
    return ranges.withColumn("reading", reserved(F.col("slug"))["reading"]).where("reading is not null").select("rel", "address", "text", "reading")


def addressed(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """(rel, asked, outcome, found): for each address what it comes to, and the addresses of the headings it may mean.

    ``asked`` has (rel, asked).  Reserved addresses come first; numbers go by the address, anything else by the slug.
    The outcome is reserved, found, ambiguous, out of range (no such number) or no match (no such slug).
    """
    numeric = F.col("asked").rlike(r"^\d+(\.\d+)*$")
    rows = asked.withColumn("_reserved", reserved(F.col("asked")).isNotNull()).withColumn("_slug", text.slug_segment(F.col("asked"))).withColumn("_numeric", numeric)
    # One join for both kinds of address, so that the ranges are made once.
    r = ranges.select(F.col("rel").alias("_rel"), F.explode(F.array(F.struct(F.lit(True).alias("n"), F.col("address").alias("k")), F.struct(F.lit(False).alias("n"), F.col("slug").alias("k")))).alias("_x"), "address")
    rows = rows.withColumn("_k", F.when(F.col("_numeric"), F.col("asked")).when(~F.col("_reserved"), F.col("_slug")))
    found = rows.join(r, (F.col("rel") == F.col("_rel")) & (F.col("_k") == F.col("_x.k")) & (F.col("_numeric") == F.col("_x.n")), "left")
    found = found.groupBy("rel", "asked", "_reserved", "_numeric").agg(F.array_sort(F.collect_set("address")).alias("found"))
    n = F.size("found")
    outcome = F.when(F.col("_reserved"), "reserved").when(n == 1, "found").when(n > 1, "ambiguous").when(F.col("_numeric"), "out of range").otherwise("no match")
    return found.select("rel", "asked", outcome.alias("outcome"), "found")


def overview(notes: DataFrame) -> DataFrame:
    """(rel, headings, json): the tree of a note's headings with their lines and tokens, in order, as one JSON text."""
    rows = notes.where(F.size("headings") > 0).select("rel", "headings", text.lines(F.col("content")).alias("lines"))
    rows = rows.select("rel", sections.weighed(F.col("headings"), F.col("lines")).alias("tree"))
    node = lambda x: F.struct(x["address"].alias("address"), x["text"].alias("heading"), x["level"].alias("level"), x["start"].alias("line"), F.concat_ws("-", x["start"], x["end"]).alias("lines"), x["tokens"].alias("tokens"))
    return rows.select("rel", F.size("tree").alias("headings"), F.to_json(F.transform("tree", node)).alias("json"))


def unfold(notes: DataFrame, ranges: DataFrame | None, address: str, threshold: int, depth: int | None = None, full: bool = False) -> DataFrame:
    """(rel, text): the own prose of the section at ``address`` and of those below it that open, a line for those that don't.

    A section opens if it is within ``depth`` levels and ``threshold`` tokens, and all above it open; a section whose
    parent opens and that doesn't itself is one line with its address.  Without ``ranges`` all headings of the notes
    count.  Sections stand in the order of the text, so those below one that doesn't open follow it, and one pass over
    a note's own row tells what is shown.
    """
    if ranges is None:
        rows = notes.select("rel", sections.weighed(F.col("headings"), None).alias("t"), text.lines(F.col("content")).alias("lines"))
    else:
        given = ranges.groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "text", "parent_seq", "start", "end"))).alias("t"))
        rows = notes.select("rel", text.lines(F.col("content")).alias("lines")).join(given, "rel")
    rows = rows.withColumn("t", F.filter("t", lambda x: (x["address"] == address) | F.startswith(x["address"], F.lit(address + ".")))).where(F.size("t") > 0)
    shown = lambda a, b: F.array_join(F.slice("lines", a, F.greatest(F.lit(0), b - a + 1)), "\n")

    def own(x: Column) -> Column:
        child = F.get(F.filter("t", lambda c: c["parent_seq"] == x["seq"]), F.lit(0))["start"]
        return shown(x["start"], F.coalesce(child - 1, x["end"]))

    def step(so_far: Column, x: Column) -> Column:
        n, below = text.tokens(shown(x["start"], x["end"])), F.size(F.split(x["address"], r"\.")) - len(address.split("."))
        opens = (below == 0) | (F.lit(True) if full else (n <= threshold) & (F.lit(True) if depth is None else below <= depth))
        hidden = F.coalesce(F.startswith(x["address"], F.concat(so_far["shut"], F.lit("."))), F.lit(False))
        line = F.concat(x["address"], F.lit(" "), x["text"], F.lit(" ("), n.cast("string"), F.lit(")"))
        shut = F.when(hidden, so_far["shut"]).when(~opens, x["address"])
        return F.struct(shut.alias("shut"), F.when(hidden, so_far["parts"]).otherwise(F.concat(so_far["parts"], F.array(F.when(opens, own(x)).otherwise(line)))).alias("parts"))

    start = F.struct(F.lit(None).cast("string").alias("shut"), F.array().cast("array<string>").alias("parts"))
    return rows.select("rel", F.array_join(F.aggregate("t", start, step, lambda x: x["parts"]), "\n").alias("text"))


def read_target(notes: DataFrame, target: str) -> DataFrame:
    """(rel, address): where ``page#heading`` leads: the notes that the page names, and in each the heading's section."""
    page, _, fragment = target.partition("#")
    found = graph.resolve(notes, page)
    if not fragment:
        return found.select("rel", F.lit(None).cast("string").alias("address"))
    slug = text.slug_segment(F.lit(fragment))
    return sections.ranges(found).where((F.col("slug") == slug) | (F.col("address") == fragment)).select("rel", "address")


class PathError(ValueError):
    """A frontmatter path that isn't one."""


def path_steps(path: str) -> list[str | int]:
    """Keys and indices of ``a.b[0].c``."""
    steps: list[str | int] = []
    for part in path.split("."):
        m = re.fullmatch(r"([^\[]+)((?:\[[0-9]+\])*)", part)
        if not m:
            raise PathError(f"{part!r} is no key with indices, in {path!r}")
        steps.append(m[1])
        steps += [int(i) for i in re.findall(r"[0-9]+", m[2])]
    return steps


def at_path(document: Column, path: str) -> Column:
    """(value, error) of a path in a JSON text: the value as JSON, or the first step that leads nowhere and why."""
    value, error = F.parse_json(document), F.lit(None).cast("string")
    for step in path_steps(path):
        kind = F.schema_of_variant(value)
        if isinstance(step, str):
            inside, wrong = kind.startswith("OBJECT"), f"no key {step!r}: not a map"
            missing, place = F.lit(f"no key {step!r}"), "$['" + step.replace("\\", "\\\\").replace("'", "\\'") + "']"
        else:
            inside, wrong = kind.startswith("ARRAY"), f"no index {step}: not a list"
            length = F.size(F.try_variant_get(value, "$", "array<variant>"))
            missing, place = F.concat(F.lit(f"index {step} is out of range: "), length.cast("string"), F.lit(" items")), f"$[{step}]"
        then = F.try_variant_get(value, place, "variant")
        error = F.coalesce(error, F.when(~F.coalesce(inside, F.lit(False)), wrong).when(then.isNull(), missing))
        value = then
    return F.struct(F.when(error.isNull(), F.to_json(value)).alias("value"), error.alias("error"))


#: What the text of each kind of inline looks like, whatever reader found it.
SHAPES = {
    "Link": r"(?s)\[.*[)\]]", "Image": r"(?s)!\[.*[)\]]", "Wikilink": r"(?s)!?\[\[.*\]\]", "CodeSpan": r"(?s)`.*`", "Emph": r"(?s)[*_].*[*_]", "Strong": r"(?s)\*\*.*\*\*|__.*__",
    "Autolink": r"(?s)<.*>|.*(?:://|@).*|www\..*",
}


def check_structure(notes: DataFrame) -> DataFrame:
    """(rel, check, n, bad): how many places of a note were looked at, and how many are wrong.

    ``order``: blocks and headings of the top level begin after the one before has ended.  ``gap``: only white space
    stands between them, before the first and behind the last.  ``nesting``: what is inside a block stands within its
    span.  ``known``: every block has a type.  ``body``: the inside of a code block stands within it.  ``inline``: the
    text of each inline has the shape of its kind; in a table's cell, where places aren't exact, that isn't asked of
    links to notes and emphasis.  ``inner``: a link's text stands within it.  ``region``: a region stands between its
    anchors.  Checks of parts that ``notes`` doesn't have are left out.  All of it is one pass over the rows.
    """
    has = set(notes.columns)
    # The text is encoded once; each check takes its slices from it.
    rows = notes.withColumn("_raw", F.encode("content", "utf-8")).withColumn("_front", (F.octet_length("content") - F.octet_length("body")).cast("bigint"))
    cut = lambda a, b: F.decode(F.substring("_raw", (a + 1).cast("int"), (b - a).cast("int")), "utf-8")
    within = lambda inner, outer: (inner["start"] >= outer["start"]) & (inner["end"] <= outer["end"])
    checks: dict[str, tuple[Column, Column]] = {}

    def look(name: str, items: Column, right) -> None:
        checks[name] = (F.size(items), F.size(F.filter(items, lambda x: ~right(x))))

    if {"headings", "nodes"} <= has:
        tops = F.concat(F.transform("headings", lambda h: h["span"]), F.transform(F.filter("nodes", lambda x: x["depth"] == 0), lambda x: x["span"]))
        rows = rows.withColumn("_tops", F.array_sort(tops)).withColumn("_ends", F.concat(F.array("_front"), F.transform("_tops", lambda s: s["end"])))
        pairs = F.arrays_zip(F.slice("_tops", 2, F.greatest(F.size("_tops") - 1, F.lit(0))).alias("s"), F.slice("_ends", 2, F.greatest(F.size("_tops") - 1, F.lit(0))).alias("e"))
        gaps = F.arrays_zip(F.concat(F.transform("_tops", lambda s: s["start"]), F.array(F.octet_length("content").cast("bigint"))).alias("s"), F.col("_ends").alias("e"))
        look("order", pairs, lambda x: x["s"]["start"] >= x["e"])
        look("gap", gaps, lambda x: (x["s"] < x["e"]) | cut(x["e"], x["s"]).rlike(r"^\ufeff?\s*$"))
    if "nodes" in has:
        look("nesting", F.filter("nodes", lambda x: x["parent_seq"].isNotNull()), lambda x: within(x["span"], F.get("nodes", x["parent_seq"])["span"]))
        look("known", F.col("nodes"), lambda x: x["type"] != "Unknown")
        look("body", F.filter("nodes", lambda x: x["body_span"].isNotNull()), lambda x: within(x["body_span"], x["span"]))
    if "inlines" in has:
        shape = lambda x: reduce(lambda other, kind: F.when(x["type"] == kind, cut(x["span"]["start"], x["span"]["end"]).rlike("^(?:" + SHAPES[kind] + ")$")).otherwise(other), SHAPES, F.lit(True))
        look("inline", F.filter("inlines", lambda x: ~x["in_cell"]), shape)
        look("inner", F.filter("inlines", lambda x: x["inner"].isNotNull()), lambda x: within(x["inner"], x["span"]))
    if "regions" in has:
        look("region", F.col("regions"), lambda x: within(x["body_span"], x["span"]) & cut(x["span"]["start"], x["span"]["end"]).rlike(r"(?s)^<!--.*-->$"))
    found = F.array(*[F.struct(F.lit(name).alias("check"), n.alias("n"), F.coalesce(bad, F.lit(0)).alias("bad")) for name, (n, bad) in checks.items()])
    return rows.select("rel", F.inline(found))


def as_lines(notes: DataFrame, *parts: str) -> DataFrame:
    """(value): the named parts of each note as one JSON line, spans in the order in which they begin."""
    kept = [F.array_sort(p, lambda a, b: F.when(a["span"]["start"] < b["span"]["start"], -1).when(a["span"]["start"] > b["span"]["start"], 1).otherwise(0)).alias(p) if p in ("regions", "inlines", "nodes") else F.col(p) for p in parts]
    return notes.select(F.to_json(F.struct("rel", *kept)).alias("value"))


def write_lines(notes: DataFrame, path: str, *parts: str) -> None:
    as_lines(notes, *parts).write.mode("overwrite").text(path)
