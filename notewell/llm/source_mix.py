"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: each source gets its share by weight of the words asked for; a source stops at REPEATS times its size,
   and what it leaves is shared out again by weight among the others.
2. Blocks: all blocks go to the sources with the highest quotients target / (2 k + 1), which gives whole quotas, and
   each source's blocks go to its shards in the same way, by the shards' sizes.
3. Selection: in each shard the documents stand in an order drawn from the seed; its quota is taken as one run of
   blocks that begins at a place drawn from the seed too, round and round, at most REPEATS times.

Only one row a document (key, source, size) is written and shuffled; texts aren't.  All of it is column expressions.
Quotients are ranked, and targets summed up, by ranges of their order, so that a source with very many shards, or very
many sources, are no single task; a shard is one, and holds SHARD words and its longest document.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import WORD, written

WEIGHTS = (5, 2, 1)
SHARE, REPEATS, SEED = 1.5, 2, 42
#: Words a block, and words of the documents that make a shard.
BLOCK, SHARD = 16, 1 << 18


def _same(a: str, b: str, columns: list[str]) -> Column:
    """That two aliased tables agree in ``columns``; nulls are equal."""
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def _beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each group ``by``."""
    more = [F.col(f"t.{c}") for c in table.columns if c not in by]
    return rows.alias("r").join(table.alias("t"), _same("r", "t", by)).select("r.*", *more)


def in_order(rows: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Adds ``_n``, the place of a row in its group, and ``_upto_c``, the sum of each c up to it.

    Rows are dealt by ranges of the whole order, counted within each range, and shifted by what the ranges before it
    hold; only a row for each range and group is counted in one place, so neither a large group nor a table without
    groups is one task.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *[F.col(c).asc_nulls_first() for c in by], *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "mix-order")
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    totals = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_c"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"), *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_sum_{c}") for c in sums])
    local = dealt.withColumn("_n", F.row_number().over(inside))
    for c in sums:
        local = local.withColumn(f"_upto_{c}", F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = _beside(local, offsets, [*by, "_range"])
    return out.select(*[F.col(c) for c in rows.columns], (F.col("_n") + F.col("_c")).alias("_n"), *[(F.col(f"_upto_{c}") + F.col(f"_sum_{c}")).alias(f"_upto_{c}") for c in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size); sources count in code point order, null last.

    Sources stop in the order of size / weight; with those that stop set aside, the level that the others reach is a
    running sum.  The first source in this order that doesn't stop gives the level of all from there on.
    """
    by_name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("_n") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    w = in_order(sizes, [], [by_name], []).select("source", "source_size", weight.cast("double").alias("weight"), (REPEATS * F.col("source_size")).cast("double").alias("most"))
    ordered = written(in_order(w.withColumn("ratio", F.col("most") / F.col("weight")), [], [F.col("ratio"), by_name], ["most", "weight"]), "mix-targets")
    asked, weights = ordered.agg(SHARE * F.sum("source_size"), F.sum("weight")).first()
    # The level if all sources before this one stop and this one and those after it don't.
    level = (F.lit(asked) - (F.col("_upto_most") - F.col("most"))) / (F.lit(weights) - (F.col("_upto_weight") - F.col("weight")))
    goes_on = ordered.withColumn("level", level).where(F.col("level") * F.col("weight") < F.col("most"))
    place, reached = goes_on.agg(F.min(F.struct("_n", "level")).alias("x")).select("x._n", "x.level").first()
    if place is None:
        target = F.col("most")
    else:
        target = F.when(F.col("_n") < place, F.col("most")).otherwise(F.least(F.lit(reached) * F.col("weight"), F.col("most")))
    return ordered.select("source", "source_size", target.alias("target"))


def apportion(parts: DataFrame, by: list[str], part: str, size: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group ``by`` dealt to its parts by Sainte-Lague's highest quotients.

    A part's share is between the seats that divisors a little above and below the exact one give, so only the few
    quotients in between are ranked: about as many rows as there are parts, not as many as there are seats.
    """
    p = _beside(parts, parts.groupBy(*by).agg(F.sum(size).alias("_total"), F.count("*").alias("_parts")), by)
    p = p.withColumn("_exact", F.when(F.col("_total") > 0, F.col(seats) * (F.col(size) / F.col("_total"))).otherwise(0.0)).withColumn("_room", F.when(F.col(seats) > 0, F.col("_exact") * F.col("_parts") / F.col(seats)).otherwise(0.0))
    p = written(p.withColumn("_sure", F.greatest(F.lit(0), F.ceil(F.col("_exact") - F.col("_room") - 1.5)).cast("long")), "mix-parts")
    bids = _beside(p, p.groupBy(*by).agg((F.max(seats) - F.sum("_sure")).alias("_open")), by)
    bids = bids.select(*by, part, size, "_sure", "_open", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(2 * F.col("_room") + 3).cast("long"))).alias("_k"))
    bids = bids.withColumn("_quotient", F.col(size) / (2 * (F.col("_sure") + F.col("_k")) - 1))
    ranked = in_order(bids, by, [F.desc("_quotient"), F.col(part).asc_nulls_last(), F.col("_k").asc()], [])
    won = ranked.where("_n <= _open and _quotient > 0").groupBy(*dict.fromkeys([*by, part])).agg(F.count("*").alias("_won"))
    joined = p.alias("p").join(won.alias("w"), _same("p", "w", list(dict.fromkeys([*by, part]))), "left")
    return joined.select(*[F.col(f"p.{c}") for c in parts.columns], (F.col("p._sure") + F.coalesce(F.col("w._won"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, taken, text_hash) of each row.

    Null texts have no words; null sources are one source, the last; rows without a key are documents too.  Repeated
    rows are documents of their own, with equal or different ``taken``; which of two equal rows gets which is of no
    consequence.  Other columns are left out, so their names can't clash; an empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = written(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(text).alias("text_hash")), "mix-sizes")
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    sources = targets(sizes)
    seats = round((sources.agg(F.sum("target")).first()[0] or 0) / BLOCK)
    sources = sources.withColumn("shards", F.ceil(F.col("source_size") / SHARD)).withColumn("all", F.lit(1)).withColumn("seats", F.lit(seats).cast("long"))
    sources = written(apportion(sources, ["all"], "source", "target", "seats").drop("all", "seats").withColumnRenamed("quota", "source_quota"), "mix-sources")
    drawn = F.xxhash64(F.lit(SEED), "id", "text_hash")
    # The sources are few rows; where they are many, adaptive execution joins by a shuffle and splits a hot source.
    dealt = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    dealt = dealt.select("id", "r.source", "size", "text_hash", "source_size", "target", "source_quota", drawn.alias("drawn"), F.pmod(F.xxhash64(F.lit(SEED + 1), "id", "text_hash"), F.greatest(F.lit(1), F.col("shards"))).alias("shard"))
    dealt = written(dealt, "mix-dealt")
    # Documents without words have no place in a shard; nothing is taken of them.
    empty = dealt.where("size = 0").select(F.col("id").alias(key), "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "text_hash")
    dealt = dealt.where("size > 0")
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.count("*").alias("docs"))
    shards = apportion(shards, ["source"], "shard", "shard_size", "source_quota").withColumn("words", F.least(F.col("quota") * BLOCK, REPEATS * F.col("shard_size"))).select("source", "shard", "shard_size", "words")
    same = F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))
    joined = dealt.alias("d").join(shards.alias("q"), same).select("d.*", "shard_size", "words")
    inside = Window.partitionBy("source", "shard").orderBy("drawn", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / BLOCK))
    begin = F.pmod(F.xxhash64(F.lit(SEED + 2), "source", "shard"), blocks) * BLOCK
    # Whole rounds, and one run of ``rest`` words from ``begin`` that goes on at the start of the shard.
    joined = joined.withColumn("begin", begin).withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0))
    joined = joined.withColumn("rest", F.col("words") - F.col("rounds") * F.col("shard_size"))
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a))
    end = F.col("begin") + F.col("rest")
    run = overlap(F.col("begin"), F.least(end, F.col("shard_size"))) + overlap(F.lit(0), end - F.col("shard_size"))
    taken = (F.col("rounds") * F.col("size") + run).cast("long")
    return joined.select(F.col("id").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), "text_hash").unionByName(empty)
