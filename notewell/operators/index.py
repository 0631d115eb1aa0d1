"""A search index that outlives a query: written once from parsed notes, read by terms.

Four tables in one folder:

* ``docs``: a row a note, with what a caller wants of a hit;
* ``forward``: a row a note: the exact lengths of its fields, and its terms with their counts;
* ``postings``: a row for each term and block of notes, sorted by term, so that a query's filter on terms skips all other
  row groups.  A posting has the counts and one byte a field for the length, rounded down; a block has the highest impact
  of each field, which bounds the score of all notes in it;
* ``terms``: for each term and field how many notes have it, and its KEPT highest impacts.

A query reads its terms' blocks.  The blocks with the highest bounds give a lower bound of the kth score; blocks and then
notes that can't reach it are left, and those that can are scored with their exact lengths.  Scores are those of ``bm25``
over all notes of the index.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from notewell.functions import text
from notewell.operators import search as S
from notewell.sources.shared import written

#: The columns that make a field.
FIELDS = {"title": ("name",), "description": ("description",), "body": ("body",)}
CARRIED = ("name", "description", "type", "tier", "tokens", "body")
#: Notes of a block (a power of two), blocks that seed a threshold, and impacts kept of a term and field.
BLOCK_BITS, LEAD, KEPT = 12, 16, 20
#: Rows up to which a batch's candidates, and the terms and notes that it asks for, are broadcast; beyond, they are shuffled.
BROADCAST_CANDIDATES, BROADCAST_TERMS, BROADCAST_NOTES = 10_000, 100_000, 1_000_000
#: One byte a length: exact up to EXACT, then a step is so many percent.
EXACT, STEP = 24, 1.06


def length_code(n: Column) -> Column:
    steps = F.floor(F.log(F.greatest(n, F.lit(EXACT)) / F.lit(float(EXACT))) / math.log(STEP))
    return (F.least(F.when(n < EXACT, n).otherwise(EXACT + steps), F.lit(255)) - 128).cast("tinyint")


def length_below(code: Column) -> Column:
    """A length that isn't greater than any with this code."""
    c = code.cast("int") + 128
    return F.when(c < EXACT, c.cast("double")).otherwise(F.floor(EXACT * F.pow(F.lit(STEP), (c - EXACT).cast("double")) * (1 - 1e-9)).cast("double"))


def length_above(code: Column) -> Column:
    """A length that isn't smaller than any with this code."""
    c = code.cast("int") + 128
    top = F.when(c == 255, F.lit(float("inf"))).otherwise(F.ceil(EXACT * F.pow(F.lit(STEP), (c - EXACT + 1).cast("double")) * (1 + 1e-9)).cast("double"))
    return F.when(c < EXACT, c.cast("double")).otherwise(top)


def impact(tf: Column, length: Column, average: float) -> Column:
    """What a field adds to a score, but for boost and idf."""
    return F.when(tf > 0, tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * length / F.lit(max(average, 1e-300))))).otherwise(0.0)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    fields: tuple[str, ...]
    stem: bool
    docs_count: int
    averages: tuple[float, ...]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def idf(self, df: Column) -> Column:
        return F.log1p((F.lit(float(self.docs_count)) - df + 0.5) / (df + 0.5))


def build(notes: DataFrame, path: str, fields: dict[str, tuple[str, ...]] = FIELDS, stem: bool = True, carry: tuple[str, ...] = CARRIED) -> Index:
    """Writes the index of ``notes`` to the folder ``path``; the notes are parsed once, for ``docs``."""
    spark = notes.sparkSession
    needed = list(dict.fromkeys([*carry, *(c for columns in fields.values() for c in columns)]))
    notes.select("rel", *needed).withColumn("doc", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/docs")
    docs, names = spark.read.parquet(f"{path}/docs"), list(fields)
    words = docs.select("doc", *[S.tokens(F.concat_ws(" ", *fields[f]), stem).alias(f"_{i}") for i, f in enumerate(names)])
    # A note's tokens stay in one partition from here on, so its terms are counted without another shuffle.
    words = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
    each = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"_{i}").alias("words")) for i in range(len(names))])
    lens = F.array(*[F.size(f"_{i}") for i in range(len(names))])
    rows = words.select("doc", lens.alias("lens"), F.explode(each).alias("f")).select("doc", "lens", "f.field", F.explode_outer("f.words").alias("term"))
    counts = rows.groupBy("doc", "lens", "term").agg(F.array(*[F.count(F.when(F.col("field") == i, F.col("term"))).cast("int") for i in range(len(names))]).alias("tf"))
    forward = counts.groupBy("doc", "lens").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms"))
    forward.sortWithinPartitions("doc").write.mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    forward.agg(F.count("*").alias("docs"), F.array(*[F.coalesce(F.avg(F.col("lens")[i]), F.lit(0.0)) for i in range(len(names))]).alias("averages")).withColumn("fields", F.array(*map(F.lit, names))).withColumn("stem", F.lit(stem)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    made = open_index(spark, path)
    codes = F.transform("lens", length_code)
    posted = forward.select("doc", codes.alias("code"), F.explode("terms").alias("t")).select("doc", "code", "t.term", "t.tf", F.shiftright("doc", BLOCK_BITS).alias("block"))
    tops = [impact(F.col("tf")[i], length_below(F.col("code")[i]), made.averages[i]) for i in range(len(names))]
    # An impact that is kept has to be one that a note reaches, so it comes from the length rounded up.
    low = [impact(F.col("tf")[i], length_above(F.col("code")[i]), made.averages[i]) for i in range(len(names))]
    sure = [F.filter(F.slice(F.sort_array(F.collect_list(x), asc=False), 1, KEPT), lambda x: x > 0) for x in low]
    # Dealt by the order in which they are stored, postings are shuffled once, before they are gathered.
    blocks = posted.repartitionByRange("term", "block").groupBy("term", "block").agg(
        F.collect_list(F.struct("doc", "tf", "code")).alias("postings"), F.array(*[F.max(t) for t in tops]).alias("top"),
        F.array(*[F.count(F.when(F.col("tf")[i] > 0, 1)) for i in range(len(names))]).alias("df"), F.array(*sure).alias("sure"),
    )
    blocks.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    stored = made.table("postings")
    fielded = stored.select("term", F.posexplode(F.arrays_zip("top", "df", "sure")).alias("field", "x")).select("term", "field", "x.top", "x.df", "x.sure").where("df > 0")
    frequency = fielded.groupBy("term", "field").agg(F.sum("df").alias("df"), F.max("top").alias("top"))
    # Of the impacts that each block has kept, the highest of all blocks; the window drops others before the shuffle.
    place = F.row_number().over(Window.partitionBy("term", "field").orderBy(F.desc("impact")))
    kept = fielded.select("term", "field", F.explode("sure").alias("impact")).withColumn("place", place).where(F.col("place") <= KEPT)
    kept = kept.groupBy("term", "field").agg(F.sort_array(F.collect_list("impact"), asc=False).alias("kept"))
    frequency.join(kept, ["term", "field"], "left").repartitionByRange("term").sortWithinPartitions("term", "field").write.mode("overwrite").parquet(f"{path}/terms")
    return made


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` has written."""
    row = spark.read.parquet(f"{path}/stats").first()
    return Index(spark, path, tuple(row.fields), row.stem, row.docs, tuple(row.averages))


def _weights(index: Index, terms: list[str], boosts: dict[str, float]) -> dict[str, list[float]]:
    """Boost times idf of each term in each field; a query has few terms."""
    found = {t: [0.0] * len(index.fields) for t in terms}
    for r in index.table("terms").where(F.col("term").isin(terms)).select("term", "field", "df").collect():
        found[r.term][r.field] = boosts[index.fields[r.field]] * math.log1p((index.docs_count - r.df + 0.5) / (r.df + 0.5))
    return found


def top(index: Index, query: S.Query, k: int, boosts: dict[str, float] | None = None, where: Column | None = None, scaled: bool = False) -> DataFrame:
    """(doc, score, columns of docs): the ``k`` notes with the highest scores, ties by path.

    ``where`` is a condition on the columns of ``docs``; ``scaled`` scales scores by trust before the cut.
    """
    boosts, spark = boosts or dict.fromkeys(index.fields, 1.0), index.spark
    terms = sorted({*query.terms, *(t for _, barred in query.groups for t in barred)})
    docs = index.table("docs").withColumn("_scale", text.multiplier(F.col("tier")) if scaled else F.lit(1.0))
    docs = docs if where is None else docs.where(where)
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).drop("_scale").limit(0)
    weights = _weights(index, terms, boosts)
    scoring = set(query.terms)
    table = spark.createDataFrame([(t, [w if t in scoring else 0.0 for w in weights[t]]) for t in terms], "term string, weight array<double>")
    n = range(len(index.fields))
    asked = index.table("postings").where(F.col("term").isin(terms)).join(F.broadcast(table), "term")
    bound = asked.select("block", sum((F.col("weight")[i] * F.col("top")[i] for i in n), F.lit(0.0)).alias("b")).groupBy("block").agg(F.sum("b").alias("bound"))

    def scored(blocks: DataFrame) -> DataFrame:
        """The notes of some blocks that the query holds for, with bounds of their scores."""
        rows = blocks.select("term", "weight", F.explode("postings").alias("p")).select("term", "weight", "p.doc", "p.tf", "p.code")
        part = lambda length: sum((F.col("weight")[i] * impact(F.col("tf")[i], length(F.col("code")[i]), index.averages[i]) for i in n), F.lit(0.0))
        found = rows.groupBy("doc").agg(F.sum(part(length_above)).alias("least"), F.sum(part(length_below)).alias("most"), F.collect_list(F.struct("term", "weight", "tf")).alias("hits"))
        has = lambda t: F.exists("hits", lambda h: h["term"] == t)
        return found.where(query.holds(has)).join(docs, "doc")

    lead = [r.block for r in bound.orderBy(F.desc("bound"), "block").limit(LEAD).collect()]
    seeds = scored(asked.where(F.col("block").isin(lead))).select((F.col("least") * F.col("_scale")).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.count("*").alias("n"), F.min("s").alias("s")).first()
    least = seeds.s * (1 - 1e-9) - 1e-9 if seeds.n >= k else 0.0
    near = bound.where(F.col("bound") * (1 + 1e-9) >= least).select("block")
    able = scored(asked.join(near, "block", "left_semi")).where(F.col("most") * F.col("_scale") * (1 + 1e-9) >= least)
    exact = able.join(index.table("forward").select("doc", "lens"), "doc")
    part = lambda h: sum((h["weight"][i] * impact(h["tf"][i], F.col("lens")[i].cast("double"), index.averages[i]) for i in n), F.lit(0.0))
    total = F.aggregate(F.array_sort("hits"), F.lit(0.0), lambda acc, h: acc + part(h)) * F.col("_scale")
    return exact.withColumn("score", total).orderBy(F.desc(F.round("score", 9)), "rel").limit(k).drop("least", "most", "hits", "lens", "_scale")


def search(index: Index, query: str, limit: int = 10, types: tuple[str, ...] = (), drop_superseded: bool = False) -> DataFrame:
    """As ``search.search``, from the index alone; statistics are those of all notes in it, whatever the types asked for."""
    asked = S.parse_query(query, index.stem)
    where = F.lit(True)
    if types:
        where = where & F.col("type").isin(*types)
    if drop_superseded:
        where = where & (F.col("tier") != "superseded")
    hits = top(index, asked, limit, S.BOOSTS, where, scaled=True)
    return S.described(hits, asked.terms)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= rows else table


def neighbours(index: Index, candidates: DataFrame, k: int = 3) -> DataFrame:
    """(candidate, rank, rel, score): for the text of each of many candidates its ``k`` best notes of a one-field index.

    A threshold-seeded join.  The kth impact of any one term of a candidate bounds its kth score from below; terms are
    ordered by the most that they can add, and those whose sum stays below the threshold make no pairs.  So terms that
    nearly all notes have are not joined with their postings, unless a candidate has no others; the pairs that can still
    reach the threshold get their exact score from the note's own terms.
    """
    if len(index.fields) != 1 or k > KEPT:
        raise ValueError(f"neighbours need an index of one field, and at most {KEPT} a candidate")
    average = index.averages[0]
    asked = candidates.select("candidate", F.explode(F.array_distinct(S.tokens(F.col("text"), index.stem))).alias("term"))
    terms = index.table("terms").where("field = 0").select("term", index.idf(F.col("df")).alias("idf"), "top", F.coalesce(F.try_element_at("kept", F.lit(k)), F.lit(0.0)).alias("kth"))
    weighed = asked.join(terms, "term").withColumn("most", F.col("idf") * F.col("top"))
    # Terms of one candidate, which is one text: its arrays have the text's size.
    by_candidate = Window.partitionBy("candidate").orderBy("most", "term")
    # What this term and all below it add at most.
    below = weighed.withColumn("sum", F.sum("most").over(by_candidate)).withColumn("seed", F.max(F.col("idf") * F.col("kth")).over(Window.partitionBy("candidate")))
    below = written(below.withColumn("makes", F.col("sum") * (1 + 1e-9) >= F.col("seed")), "neighbour-terms")
    rest = below.groupBy("candidate").agg(F.sum(F.when(~F.col("makes"), F.col("most")).otherwise(0.0)).alias("rest"), F.max("seed").alias("seed"), F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idfs"))
    makes = written(below.where("makes").select("candidate", "term", "idf"), "neighbour-terms")
    # Blocks whose term no candidate asks for are left before their postings are listed.
    posted = index.table("postings").join(_small(written(makes.select("term").distinct(), "neighbour-terms"), BROADCAST_TERMS), "term", "left_semi").select("term", F.explode("postings").alias("p")).select("term", "p.doc", F.col("p.tf")[0].alias("tf"), F.col("p.code")[0].alias("code"))
    pairs = posted.join(_small(makes, BROADCAST_TERMS), "term")
    part = lambda length: F.sum(F.col("idf") * impact(F.col("tf"), length(F.col("code")), average))
    sums = pairs.groupBy("candidate", "doc").agg(part(length_above).alias("least"), part(length_below).alias("upto"))
    # The kth sum of what the pairs have for sure is a better threshold than the seed.
    place = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("least"), "doc"))
    kth = sums.select("candidate", "least", place.alias("place")).where(F.col("place") <= k).groupBy("candidate").agg(F.when(F.count("*") == k, F.min("least")).otherwise(0.0).alias("kth"))
    rest = written(rest, "neighbour-bounds")
    kth, bounds = (_small(x, BROADCAST_CANDIDATES) for x in (written(kth, "neighbour-bounds"), rest.drop("idfs")))
    able = sums.join(kth, "candidate").join(bounds, "candidate").where((F.col("upto") + F.col("rest")) * (1 + 1e-9) >= F.greatest("seed", "kth") * (1 - 1e-9))
    able = written(able.select("candidate", "doc"), "neighbour-pairs")
    # Only the notes of these pairs are shuffled with their terms.
    near = _small(written(able.select("doc").distinct(), "neighbour-notes"), BROADCAST_NOTES)
    noted = index.table("forward").join(near, "doc", "left_semi").select("doc", F.col("lens")[0].cast("double").alias("len"), "terms").join(index.table("docs").select("doc", "rel").join(near, "doc", "left_semi"), "doc")
    exact = F.aggregate(F.array_sort("terms"), F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at("idfs", t["term"]) * impact(t["tf"][0], F.col("len"), average), F.lit(0.0)))
    scored = able.join(noted, "doc").join(_small(rest.select("candidate", "idfs"), BROADCAST_CANDIDATES), "candidate").select("candidate", "rel", exact.alias("score"))
    best = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc(F.round("score", 9)), "rel"))
    return scored.withColumn("rank", best).where(F.col("rank") <= k).select("candidate", "rank", "rel", "score")


#: Candidates and pairs of candidate and term up to which a batch is scored as the notes are read; a larger one asks an index.
BATCH, BATCH_TERMS = 2_000, 500_000
#: Sums and products that a task holds at once.
CELLS, PRODUCTS = 2_000_000, 4_000_000


def _counted(terms) -> Callable:
    """An Arrow function from a note's words to their number and, of the batch's terms, places and counts in order."""
    kind = pa.struct([("len", pa.int32()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(words: pa.Array) -> pa.Array:
        known, out = pa.array(terms.value, pa.string()), []
        for a in range(0, len(words), 2048):
            part = words.slice(a, 2048)
            lens = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(part.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, n = np.unique((np.repeat(np.arange(len(lens)), lens) * len(known) + at)[at >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(lens) + 1) * len(known)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (keys % len(known), n)]
            out.append(pa.StructArray.from_arrays([pa.array(lens, pa.int32()), *lists], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    run.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "len int, ids array<int>, tfs array<int>").asNondeterministic()


@lru_cache(1 << 16)
def _rounded(score: float) -> float:
    """As Spark rounds, so that a task keeps what the whole would keep."""
    return float(Decimal(repr(score)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def _scores(weights, average: float, k: int) -> Callable:
    """A function over Arrow batches of counted notes: of each task the ``k`` best notes of each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, begins, holders, m = weights.value
        best: dict[int, list] = {}
        least = np.zeros(m)
        for batch in batches:
            rels = batch.column("rel")
            sizes = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
            lens = batch.column("len").to_numpy(zero_copy_only=False).astype(np.float64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            tf = tfs.astype(np.float64)
            value = idf[ids] * (tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * lens[rows] / average)))
            n = begins[ids + 1] - begins[ids]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            products = np.concatenate([[0], np.cumsum(n)])[ends]
            a = 0
            while a < len(sizes):
                b = int(np.searchsorted(products, products[a] + PRODUCTS, "right")) - 1
                b = min(len(sizes), max(a + 1, min(b, a + max(1, CELLS // m))))
                of = slice(ends[a], ends[b])
                each = n[of]
                # The candidates that hold each posting's term, one after the other; a sum takes its terms in their order.
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins[ids[of]], each)
                cell = np.repeat(rows[of] - a, each) * m + holders[place]
                sums = np.bincount(cell, np.repeat(value[of], each), (b - a) * m).reshape(b - a, m)
                floor = np.maximum(least, np.partition(sums, b - a - k, axis=0)[b - a - k] if b - a > k else 0.0)
                r, c = np.nonzero((sums > 0) & (sums >= floor - 2e-9))
                found: dict[int, list] = {}
                for i, j, x in zip(rels.take(pa.array(r + a)).to_pylist(), c.tolist(), sums[r, c].tolist(), strict=True):
                    found.setdefault(j, []).append((-_rounded(x), i, x))
                for j, more in found.items():
                    best[j] = sorted(best.get(j, []) + more)[:k]
                    least[j] = -best[j][-1][0] if len(best[j]) == k else 0.0
                a = b
        flat = [(j, i, x) for j, kept in best.items() for _, i, x in kept]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.string()), pa.array([f[2] for f in flat], pa.float64())], ["at", "rel", "score"])

    return run


def nearest(notes: DataFrame, candidates: DataFrame, path: str, fields: tuple[str, ...], k: int = 3, stem: bool = False) -> DataFrame | None:
    """As ``neighbours`` of an index of one field, without one; None if the batch is too large for it.

    Of each note the counts of the batch's terms alone are kept, in its own row in the folder ``path``, so nothing of the
    notes is shuffled.  Then each task scores its notes exactly for all candidates and gives its ``k`` best of each.
    """
    spark = notes.sparkSession
    asked = written(candidates.where("candidate is not null").select("candidate", F.explode(F.array_distinct(S.tokens(F.col("text"), stem))).alias("term")).distinct(), "neighbour-terms")
    size = asked.agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("m")).first()
    if size.m > BATCH or size.n > BATCH_TERMS:
        return None
    # At most BATCH_TERMS rows.
    pairs = asked.collect()
    terms, keys = sorted({r.term for r in pairs}), list({r.candidate: None for r in pairs})
    number, place = {t: i for i, t in enumerate(terms)}, {c: i for i, c in enumerate(keys)}
    held = sorted((number[r.term], place[r.candidate]) for r in pairs)
    begins = np.searchsorted(np.array([t for t, _ in held], np.int64), np.arange(len(terms) + 1))
    words = notes.select("rel", _counted(spark.sparkContext.broadcast(terms))(S.tokens(F.concat_ws(" ", *fields), stem)).alias("x"))
    words.select("rel", "x.*").write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.schema("rel string, len int, ids array<int>, tfs array<int>").parquet(f"{path}/counts")
    total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average")).first()
    idf = np.zeros(len(terms))
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():
        idf[r.id] = math.log1p((total.docs - r.df + 0.5) / (r.df + 0.5))
    weights = spark.sparkContext.broadcast((idf, begins, np.array([c for _, c in held], np.int64), len(keys)))
    found = counts.where(F.size("ids") > 0).mapInArrow(_scores(weights, max(total.average, 1e-300), k), "at int, rel string, score double")
    best = F.row_number().over(Window.partitionBy("at").orderBy(F.desc(F.round("score", 9)), "rel"))
    ranked = found.withColumn("rank", best).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(keys)), StructType([StructField("at", IntegerType()), StructField("candidate", candidates.schema["candidate"].dataType)]))
    return ranked.join(F.broadcast(named), "at").select("candidate", "rank", "rel", "score")
