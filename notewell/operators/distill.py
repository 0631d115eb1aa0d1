"""Comparing texts and what they carry: residues, multisets, fuzzy names, snapping, and measures of runs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell.functions import format as fmt
from notewell.functions import payload, text
from notewell.sources.shared import written

LANE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("lane", "markup", "key")]))


@F.pandas_udf(LANE)
def _harvest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: [{"lane": a, "markup": b, "key": c} for a, b, c in payload.harvest(s or "")])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _segment(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: payload.segment(s or ""))


@F.pandas_udf(T.DoubleType())
def density(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: payload.density(s or ""))


@F.pandas_udf(T.StructType([T.StructField("masked", T.StringType()), T.StructField("kept", T.ArrayType(T.StringType()))]))
def masked(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([payload.mask(s or "") for s in texts], columns=["masked", "kept"])


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else payload.fold(s))


@F.pandas_udf(T.LongType())
def display_width(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: payload.display_width(s or ""))


@F.pandas_udf(T.StructType([T.StructField("formatted", T.StringType()), T.StructField("declined", T.ArrayType(T.StringType())), T.StructField("departures", T.ArrayType(T.StringType()))]))
def formatted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(*fmt.format_note(s or ""), fmt.check(s or "")) for s in texts], columns=["formatted", "declined", "departures"])


def harvest(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, lane, markup, item): a row for each thing that a text carries."""
    return docs.select(key, F.explode(_harvest(column)).alias("x")).select(key, "x.lane", "x.markup", F.col("x.key").alias("item"))


def blocks(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, block): blocks B1, B2, ... in order."""
    return docs.select(key, F.posexplode(_segment(column)).alias("i", "block")).select(key, (F.col("i") + 1).alias("n"), "block")


def residue(source: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """What the source carries and the output doesn't, each key once."""
    return source.join(output, keys, "left_anti").dropDuplicates(keys)


def tally(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dropped, invented): the differences of two multisets."""
    a, b = before.groupBy(*keys).agg(F.count("*").alias("_a")), after.groupBy(*keys).agg(F.count("*").alias("_b"))
    both = a.join(b, keys, "full").select(*keys, F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b")).where("_a <> _b")
    return both.select(*keys, F.greatest(F.lit(0), F.col("_a") - F.col("_b")).alias("dropped"), F.greatest(F.lit(0), F.col("_b") - F.col("_a")).alias("invented"))


#: Edits that may part two names, and the length from which names meet on pieces instead of on what deletions leave.
MOST, LONG = 3, 25


def _deleted(name: Column, most: int) -> Column:
    """Hashes of what is left of a name when up to ``most`` characters are deleted, each way once.

    Two names within ``most`` edits have such a rest in common: each edit deletes a character of one side or of both.
    Names that share a rest have all but ``most`` characters in common, in order, so they meet few others, however
    much all names have in common.
    """
    level = F.array(F.struct(F.lit(1).alias("at"), name.alias("s")))
    levels = [level]
    for _ in range(most):
        # The next deletion stands behind the last one, or a rest would be made in several orders.
        level = F.flatten(F.transform(level, lambda x: F.when(x["at"] <= F.length(x["s"]), F.transform(F.sequence(x["at"], F.length(x["s"])), lambda i: F.struct(i.alias("at"), F.concat(F.substr(x["s"], F.lit(1), i - 1), F.substr(x["s"], i + 1)).alias("s")))).otherwise(F.array().cast("array<struct<at:int,s:string>>"))))
        levels.append(level)
    return F.array_distinct(F.transform(F.flatten(F.array(*levels)), lambda x: F.xxhash64(x["s"])))


def _cut(length: Column, i: Column) -> Column:
    return F.floor(length * i / (2 * MOST + 2)).cast("int")


def _bands(rows: DataFrame, name: str) -> DataFrame:
    """The rarest pieces of long names: of 2 MOST + 2 pieces those MOST + 1 that the fewest names of the length have.

    MOST edits leave MOST + 2 pieces whole, moved by at most as many places, and only MOST + 1 are left out here: one
    of those kept is whole.  What most names have in common, up to half of each, is no key.
    """
    n = F.length(name)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(2 * MOST + 1)), lambda i: F.struct(n.cast("int").alias("len"), i.cast("int").alias("part"), F.substr(name, _cut(n, i) + 1, _cut(n, i + 1) - _cut(n, i)).alias("piece")))
    banded = rows.where(n >= LONG).withColumn("_band", F.explode(pieces))
    count = banded.groupBy("_band").agg(F.count("*").alias("_names"))
    # A window over the few pieces of one name.
    place = F.row_number().over(Window.partitionBy(name).orderBy("_names", "_band"))
    return banded.join(count, "_band").withColumn("_place", place).where(F.col("_place") <= MOST + 1).drop("_names", "_place")


def _probes(rows: DataFrame, name: str) -> DataFrame:
    """The pieces of all names of about this length that stand here, each at most MOST places from its own."""
    n = F.length(name)

    def pieces(length: Column) -> Column:
        at = lambda i, d: _cut(length, i) + d
        size = lambda i: _cut(length, i + 1) - _cut(length, i)
        whole = lambda i, d: F.when((at(i, d) >= 0) & (at(i, d) + size(i) <= n), F.substr(name, at(i, d) + 1, size(i)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2 * MOST + 1)), lambda i: F.transform(F.sequence(F.lit(-MOST), F.lit(MOST)), lambda d: F.struct(length.cast("int").alias("len"), i.cast("int").alias("part"), whole(i, d).alias("piece")))))

    lengths = F.sequence(F.greatest(F.lit(LONG), n - MOST), n + MOST)
    return rows.where(n >= LONG - MOST).withColumn("_band", F.explode(F.array_distinct(F.filter(F.flatten(F.transform(lengths, pieces)), lambda x: x["piece"].isNotNull()))))


def candidates(names: DataFrame, known: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): the pairs of ``names`` (a) and ``known`` (b) that are compared, all those within ``most`` edits among them.

    A name makes up to some thousand keys, which the size of its table doesn't tell; so both sides are shuffled, however
    small the tables are, and the keys never go through the driver as a broadcast.
    """
    rest = lambda rows, name: rows.withColumn("_rest", F.explode(_deleted(F.col(name), most)))
    short = rest(names.where(F.length("a") < LONG + most), "a").join(rest(known.where(F.length("b") < LONG), "b").hint("merge"), "_rest").select("a", "b")
    long = _probes(names, "a").join(_bands(known, "b").hint("merge"), "_band").select("a", "b")
    return short.union(long).distinct()


def _compared(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= text.corruption_cap(F.col("a"), F.col("b")))


def near_names(names: DataFrame, known: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """(name, match, distance): each name's nearest known name within a third of its length, at most 3 edits.

    Names look for a match at no distance, then at one edit, and so on; those that have one look no further, so that a
    name isn't compared with the many that are only about as near.
    """
    left = written(names.select(F.col(name).alias("a")).where("a <> ''").distinct(), "names")
    given = written(known.select(F.col(name).alias("b"), F.col(order).alias("ord")).where("b <> ''").groupBy("b").agg(F.min("ord").alias("ord")), "known-names")
    found = []
    for edits in range(MOST + 1):
        near = _compared(candidates(left, given.select("b"), edits)).where(F.col("distance") == edits).join(given, "b")
        found.append(written(near.groupBy("a").agg(F.min(F.struct("ord", "b")).alias("m")).select("a", F.col("m.b").alias("match"), F.lit(edits).alias("distance")), f"names-at-{edits}"))
        left = left.join(found[-1], "a", "left_anti")
    return reduce(DataFrame.union, found).withColumnRenamed("a", "name")


def near_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """(a, b, distance): pairs of different names within the cap of each other."""
    one = names.select(F.col(name).alias("a")).where("a <> ''").distinct()
    return _compared(candidates(one, one.withColumnRenamed("a", "b")).where("a < b"))


def words_of(column: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def plain_words(column: Column) -> Column:
    """A text as its words, in small letters, with one blank between them; links are their texts."""
    shown = F.regexp_replace(F.regexp_replace(column, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"!?\[\[([^\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(F.lower(shown), r"[^\p{L}\p{N}]+", " "))


def _holds() -> Column:
    """Whether the words of block b hold those of quote q one after the other."""
    return F.contains(F.concat(F.lit(" "), "b", F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" ")))


def _keys(q: DataFrame, b: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Words of quotes with their place, the rarest first, and words of blocks; words that no block has are left out."""
    held = b.select(*by, "n", F.size("bw").alias("size"), F.explode("bw").alias("w"))
    df = held.groupBy(*by, "w").agg(F.count("*").alias("df"))
    asked = q.select(*by, "quote_id", F.explode("qw").alias("w")).join(df, [*by, "w"])
    # A window over the words of one quote.
    return asked.withColumn("place", F.row_number().over(Window.partitionBy(*by, "quote_id").orderBy("df", "w"))), held


def snap_candidates(quotes: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quote_id, n, q, b, shared): the quotes and blocks that are compared, a quote's best block among them.

    A block that holds a quote has its rarest word, and the blocks with that word give a first count of shared words,
    at least 1.  To have as many, a block must have one of the words before the last ``count - 1``, in the order of
    rarity, and be no shorter than the count.  So words that nearly all blocks have join nothing, unless a quote shares
    nothing else with any block.
    """
    q = quotes.select(*by, "quote_id", plain_words(F.col("quote")).alias("q")).where("q <> ''").withColumn("qw", F.array_distinct(F.split("q", " ")))
    b = blocks.select(*by, "n", plain_words(F.col("block")).alias("b")).where("b <> ''").withColumn("bw", F.array_distinct(F.split("b", " ")))
    asked, held = _keys(q, b, by)
    keys = [*by, "w"]

    def counted(pairs: DataFrame) -> DataFrame:
        both = pairs.join(q, [*by, "quote_id"]).join(b, [*by, "n"])
        return both.withColumn("shared", F.size(F.array_intersect("qw", "bw"))).select(*by, "quote_id", "n", "q", "b", "shared", F.size("qw").alias("words"))

    first = written(counted(asked.where("place = 1").join(held, keys).select(*by, "quote_id", "n")), "snap-first")
    so_far = first.groupBy(*by, "quote_id").agg(F.max("shared").alias("count"), F.max(_holds().cast("int")).alias("holds"))
    present = asked.groupBy(*by, "quote_id").agg(F.max("place").alias("last"))
    open_ = so_far.where("holds = 0").join(present, [*by, "quote_id"])
    more = asked.where("place > 1").join(open_, [*by, "quote_id"]).where(F.col("place") <= F.col("last") - F.col("count") + 1)
    pairs = more.join(held, keys).where(F.col("size") >= F.col("count")).select(*by, "quote_id", "n").distinct()
    return first.union(counted(pairs.join(first.select(*by, "quote_id", "n"), [*by, "quote_id", "n"], "left_anti")))


def snap(quotes: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quote_id, n, how, score, error): the shortest block that holds a quote, else the first that shares most words.

    Quotes are placed among the blocks with equal ``by``, by words without regard to case, marks or links; ``score`` is
    the part of its words that the block has.  A block holds whole words, not parts of one.  A quote that shares no word with any block has no place but an error, as
    has one without any word.
    """
    rows = snap_candidates(quotes, blocks, by).withColumn("holds", _holds())
    order = F.struct((~F.col("holds")).alias("no"), F.when(F.col("holds"), F.length("b")).otherwise(-F.col("shared")).alias("cost"), "n")
    best = rows.groupBy(*by, "quote_id").agg(F.min(F.struct(order.alias("o"), (F.col("shared") / F.col("words")).alias("s"))).alias("x"))
    best = best.select(*by, "quote_id", "x.o.n", F.when(F.col("x.o.no"), "overlap").otherwise("contains").alias("how"), F.when(F.col("x.o.no"), F.col("x.s")).otherwise(1.0).alias("score"))
    error = F.when(plain_words(F.coalesce("quote", F.lit(""))) == "", "no words").when(F.col("n").isNull(), "no block shares a word")
    return quotes.select(*by, "quote_id", "quote").join(best, [*by, "quote_id"], "left").select(*by, "quote_id", "n", "how", "score", error.alias("error"))


def locate(content: Column, quote: Column) -> Column:
    """The byte span of a quote that stands once in a text; null where it doesn't, or stands twice."""
    first = F.instr(content, quote)
    again = F.instr(F.substr(content, first + 1), quote)
    start = F.octet_length(F.substr(content, F.lit(1), first - 1))
    return F.when((first > 0) & (again == 0), F.struct(start.alias("start"), (start + F.octet_length(quote)).alias("end")))


def disjoint_sections(notes: DataFrame) -> DataFrame:
    """(rel, seq, heading, depth, text): the intro, of depth 0, and each heading's own lines, none nested in another."""
    rows = notes.select("rel", "headings", text.lines(F.col("content")).alias("lines"), (F.col("body_start_line") - 1).alias("skip"))
    starts = F.concat(F.array(F.struct(F.lit("").alias("h"), F.lit(0).alias("depth"), (F.col("skip") + 1).alias("at"))), F.transform("headings", lambda h: F.struct(h["text"].alias("h"), h["level"].alias("depth"), h["line"].alias("at"))))
    rows = rows.withColumn("s", starts).select("rel", "lines", "s", F.posexplode("s").alias("seq", "x"))
    end = F.coalesce(F.get("s", F.col("seq") + 1)["at"] - 1, F.size("lines"))
    return rows.select("rel", "seq", F.col("x.h").alias("heading"), "x.depth", F.array_join(F.slice("lines", F.greatest(F.lit(1), F.col("x.at")), F.greatest(F.lit(0), end - F.col("x.at") + 1)), "\n").alias("text"))


def route(sections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``density`` and ``preserve``: sections that are mostly payload are kept as they are."""
    return sections.withColumn("density", density("text")).withColumn("preserve", F.col("density") >= threshold)


def word_caps(docs: DataFrame, key: str, column: str, cap: int = 20) -> DataFrame:
    """(key, n, words): sentences with more than ``cap`` words, with their place."""
    rows = docs.select(key, F.posexplode(text.sentences(F.col(column))).alias("i", "s"))
    return rows.select(key, (F.col("i") + 1).alias("n"), text.word_count(F.col("s")).alias("words")).where(F.col("words") > cap)


def run_stats(runs: DataFrame, by: str, *measures: str) -> DataFrame:
    """(by, measure, mean, stddev, min, max), rounded to 4 places; one run has no deviation."""
    rows = runs.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])).alias("e")).select(by, "e.*")
    r = lambda c: F.round(c, 4)
    return rows.groupBy(by, "measure").agg(r(F.avg("x")).alias("mean"), r(F.coalesce(F.stddev_samp("x"), F.lit(0.0))).alias("stddev"), r(F.min("x")).alias("min"), r(F.max("x")).alias("max"))


def run_deltas(runs: DataFrame, by: str, base: str, other: str, *measures: str) -> DataFrame:
    """(measure, base, other, delta): the means of two configurations, and how far the second lies above the first.

    A configuration without a run has no mean, and then there is no delta.
    """
    stats = run_stats(runs.where(F.col(by).isin(base, other)), by, *measures)
    mean = lambda which: F.max(F.when(F.col(by) == which, F.col("mean")))
    rows = stats.groupBy("measure").agg(mean(base).alias("base"), mean(other).alias("other"))
    return rows.withColumn("delta", F.round(F.col("other") - F.col("base"), 4))


def trigger_rate(runs: DataFrame, by: str, fired: str, threshold: float = 0.5) -> DataFrame:
    return runs.groupBy(by).agg(F.avg(F.col(fired).cast("int")).alias("rate")).withColumn("passes", F.col("rate") >= threshold)


def stratified_split(rows: DataFrame, by: str, key: str, part: float, seed: int) -> DataFrame:
    """(key, by, held_out): a drawn part of each class, one row at least.  The draw is the order of a digest.

    Ranks are counted within stretches of the digest and shifted by the counts of those before, so a large class is
    no single task; only a row a stretch, 4,096 of a class at most, is in one place.
    """
    drawn = rows.select(key, by, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("_d")).withColumn("_s", F.substring("_d", 1, 3))
    counts = drawn.groupBy(by, "_s").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(by)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col(by).alias("_by"), F.col("_s").alias("_t"), before.alias("_before"), F.greatest(F.lit(1), F.floor(F.sum("_c").over(whole) * part)).alias("_n"))
    placed = drawn.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_s").orderBy("_d", key))).join(shifts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_s") == F.col("_t")))
    return placed.select(key, by, (F.col("_before") + F.col("_r") <= F.col("_n")).alias("held_out"))
