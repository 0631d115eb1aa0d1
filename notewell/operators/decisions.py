"""Decision blocks: regions in which a reader ticks what shall be done, and what comes of the ticks.

A block is a region ``<!-- interact: KIND id=ID -->`` with items ``- [x] VERB target`` in it.  Kinds: ``pick-any`` fires
each ticked item, ``pick-one`` must have exactly one, ``confirm-all`` must have all ticked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.functions import text

KINDS = ("pick-any", "pick-one", "confirm-all")
ITEM = r"^\s*- \[([ xX])\] ([\w-]+)(?:\s+(.*?))?\s*$"


def _blocks(notes: DataFrame) -> DataFrame:
    """(rel, blocks...): the decision blocks of each note in its own row, with their items and whether they stand within another.

    All that is asked of a block stands in its note, so nothing is shuffled, joined or broadcast, and a note is parsed once.
    A block that doesn't count has no items.
    """
    part = lambda t, i: F.regexp_extract(t, ITEM, i)

    def opened(r: Column) -> Column:
        info = F.coalesce(r["info"], F.lit(""))
        inside = F.exists("_all", lambda o: (o["span"] != r["span"]) & (o["span"]["start"] <= r["span"]["start"]) & (r["span"]["end"] <= o["span"]["end"]))
        return F.struct(r["start_line"].alias("line"), r["end_line"].alias("last"), F.regexp_extract(info, r"^([\w-]+)", 1).alias("kind"), F.nullif(F.regexp_extract(info, r"\bid=\"?([\w.-]+)", 1), F.lit("")).alias("id"), inside.alias("nested"))

    def listed(b: Column) -> Column:
        inner = F.slice("_lines", b["line"] + 1, F.greatest(F.lit(0), b["last"] - b["line"] - 1))
        found = F.filter(F.transform(inner, lambda t, i: F.struct((b["line"] + 1 + i).alias("line"), t.alias("t"))), lambda x: x["t"].rlike(ITEM))
        made = F.transform(found, lambda x: F.struct(x["line"].alias("line"), (part(x["t"], 1) != " ").alias("checked"), part(x["t"], 2).alias("verb"), F.coalesce(part(x["t"], 3), F.lit("")).alias("target")))
        return b.withField("items", F.when(counts(b), made).otherwise(F.slice(made, 1, 0)))

    rest = [c for c in ("dangling",) if c in notes.columns]
    rows = notes.select("rel", "content", *rest, F.filter("regions", lambda r: r["label"] == "interact").alias("_all"))
    rows = rows.select("rel", *rest, text.lines(F.col("content")).alias("_lines"), F.transform("_all", opened).alias("_opened"))
    return rows.select("rel", *rest, F.transform("_opened", listed).alias("blocks"))


def counts(b: Column) -> Column:
    return ~b["nested"] & b["kind"].isin(*KINDS) & b["id"].isNotNull()


def _listed(blocks: DataFrame) -> DataFrame:
    # Outer, since else their number is asked for in a filter, which is pushed below what makes the blocks and makes them again.
    rows = blocks.select("rel", F.posexplode_outer("blocks").alias("block", "b")).select("rel", "block", "b.kind", "b.id", F.explode("b.items").alias("i"))
    return rows.select("rel", "block", "kind", "id", "i.line", "i.checked", "i.verb", "i.target")


def items(notes: DataFrame) -> DataFrame:
    """(rel, block, kind, id, line, checked, verb, target): a row for each item of the blocks that count."""
    return _listed(_blocks(notes))


def _wrong(verbs: tuple[str, ...]) -> Column:
    """[(line, code)]: all that keeps a note's decisions from being carried out, from the note's own row."""
    said = lambda rows, code: F.transform(rows, lambda x: F.struct(x["line"].alias("line"), F.lit(code).alias("code")))
    some = lambda condition: F.filter("blocks", condition)
    named = F.transform(some(lambda b: ~b["nested"] & b["id"].isNotNull()), lambda b, n: F.struct(n.alias("n"), b["id"].alias("id"), b["line"].alias("line")))
    # Of the blocks with one id the last is told of, if there is one before it; several may stand on one line.
    twice = F.filter(named, lambda x: F.exists(named, lambda o: (o["id"] == x["id"]) & (o["n"] < x["n"])) & ~F.exists(named, lambda o: (o["id"] == x["id"]) & (o["n"] > x["n"])))
    unpaired = F.transform(F.filter("dangling", lambda d: d["label"] == "interact"), lambda d: F.struct(d["line"].alias("line"), F.when(d["kind"] == "open", "never closed").otherwise("never opened").alias("code")))
    ticked = lambda b: F.size(F.filter(b["items"], lambda i: i["checked"]))
    return F.concat(
        said(some(lambda b: b["nested"]), "nested"),
        said(some(lambda b: ~b["nested"] & (~b["kind"].isin(*KINDS) | b["id"].isNull())), "bad anchor"),
        said(twice, "repeated id"),
        unpaired,
        said(F.filter(F.flatten(F.transform("blocks", lambda b: b["items"])), lambda i: ~i["verb"].isin(*verbs)), "unknown verb"),
        said(some(lambda b: counts(b) & (b["kind"] == "pick-one") & (ticked(b) != 1)), "not one"),
        said(some(lambda b: counts(b) & (b["kind"] == "confirm-all") & (ticked(b) < F.size(b["items"]))), "not confirmed"),
    )


def errors(notes: DataFrame, verbs: tuple[str, ...]) -> DataFrame:
    """(rel, line, code): all that keeps a note's decisions from being carried out."""
    return _blocks(notes).select("rel", F.explode(_wrong(verbs)).alias("e")).select("rel", "e.line", "e.code")


def fired(notes: DataFrame, verbs: tuple[str, ...]) -> DataFrame:
    """(rel, id, kind, verb, target): the ticked items of notes without any error; a note with one fires nothing."""
    # No filter either.
    right = _blocks(notes).select("rel", F.when(F.size(_wrong(verbs)) == 0, F.col("blocks")).alias("blocks"))
    return _listed(right).where("checked").select("rel", "id", "kind", "verb", "target")
