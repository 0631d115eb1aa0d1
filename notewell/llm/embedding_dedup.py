"""Near duplicates among embeddings with one label: random-hyperplane signs in several tables, exact cosines, components.

A hyperplane through the origin parts two vectors at an angle of a with chance a/pi.  A table keeps the signs of ``bits``
drawn hyperplanes; vectors with one label and the same signs fall in one bucket.  The number of bits grows with the
logarithm of the largest label, so that buckets stay small, and the number of tables follows from it: a pair that is
just similar enough shares a bucket of some table with a chance of RECALL at least, and a closer pair with a greater one.

In a bucket all cosines are computed exactly, in double precision, and a pair counts in the first table that brings it
together, which each side's signs tell; so nothing is emitted a pair.  A bucket gives a row a vector: how many links it
has there, and the vector that its links there lead to, which is an edge for the distributed components.  Buckets of
more than BLOCK vectors are compared block by block, each pair of blocks in a group of its own: all of their pairs
are still compared, and no group grows.  Equal vectors are one class from the first step on and travel once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .pieces import like
from .support import written

#: The chance with which a pair just at the threshold meets in a bucket, at least.
RECALL = 0.9995
#: Vectors that a bucket holds on average in the largest label, about, and signs of a table, at least.
BUCKET, LEAST_BITS = 128, 6
#: Vectors that are compared with one another at once; a group holds two blocks at most.
BLOCK = 1024
SEED = 20_231


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """Signs of a table and number of tables, for the vectors of the largest label."""
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, largest) / BUCKET))))
    together = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** bits
    return bits, max(1, int(np.ceil(np.log1p(-RECALL) / np.log1p(-together)))) if together < 1 else 1


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): each row's signs in each table as one integer.  The hyperplanes depend on nothing but the length."""
    planes = np.random.default_rng(SEED).standard_normal((tables * bits, x.shape[1]))
    signs = (x @ planes.T >= 0).reshape(len(x), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; each is divided by its largest component first, so that no square is out of range."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows side by side, summed in the order of the components."""
    x, y = x / np.abs(x).max(1)[:, None], y / np.abs(y).max(1)[:, None]
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in range(x.shape[1]):
        dot += x[:, c] * y[:, c]
        xx += x[:, c] * x[:, c]
        yy += y[:, c] * y[:, c]
    return dot / np.sqrt(xx * yy)


def _keys(docs: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, key, v) of each row; key and v are null for rows that can't be linked with anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            values, present = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), flat.is_valid().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            sound = np.concatenate([[0], np.cumsum(present & np.isfinite(values))])
            filled = np.concatenate([[0], np.cumsum(values != 0)])
            fine = (sound[ends] - sound[ends - sizes] == sizes) & (filled[ends] > filled[ends - sizes]) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            raw = memoryview((values + 0.0).tobytes())
            kept = [raw[8 * (e - n) : 8 * e] if ok else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), fine.tolist(), strict=True)]
            names = [None if x is None else xxhash.xxh3_128_digest(x) for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array([None if x is None else bytes(x) for x in kept], pa.binary())], schema.names)

    schema = T.StructType([like(docs, key, "id"), like(docs, label, "label"), T.StructField("key", T.BinaryType()), T.StructField("v", T.BinaryType())])
    return docs.select(key, label, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)


def _buckets(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(label, bucket, cid, copies, signs, v): each class once a table; a bucket's name holds length, table and signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(3).to_pylist()], np.int64) // 8
            for n in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                x = unit(np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(-1, n))
                for a in range(0, len(x), 4096):
                    signs = signatures(x[a : a + 4096], bits, tables)
                    raw = [row.tobytes() for row in signs.astype("<u8")]
                    rows = part.slice(a, len(signs))
                    for t in range(tables):
                        names = [f"{n}:{t}:{s}" for s in signs[:, t].tolist()]
                        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names), rows.column(1), rows.column(2), pa.array(raw, pa.binary()), rows.column(3)], schema.names)

    schema = T.StructType([classes.schema["label"], *[T.StructField(c, t) for c, t in (("bucket", T.StringType()), ("cid", T.LongType()), ("copies", T.LongType()), ("signs", T.BinaryType()), ("v", T.BinaryType()))]])
    return classes.select("label", "cid", "copies", "v").mapInArrow(run, schema)


def _group_links(table: int, side: np.ndarray, cids: np.ndarray, copies: np.ndarray, signs: np.ndarray, x: np.ndarray, threshold: float, within: bool) -> tuple[np.ndarray, ...]:
    """(cid, links, root) of the vectors of a group that this table links first; root is the smallest of its part."""
    n = len(x)
    one, two = (np.arange(n), np.arange(n)) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    ones = unit(x)
    linked = np.zeros((len(one), len(two)), bool)
    for a in range(0, len(one), 256):
        rows = one[a : a + 256]
        rough = ones[rows] @ ones[two].T
        hit = rough >= threshold + 1e-9
        i, j = np.nonzero((rough >= threshold - 1e-9) & ~hit)
        # So near the threshold the order of the sum matters.
        hit[i, j] = _cosines(x[rows[i]], x[two[j]]) >= threshold
        if within:
            hit &= rows[:, None] != two[None, :]
        i, j = np.nonzero(hit)
        before = (signs[rows[i], :table] == signs[two[j], :table]).any(1)
        hit[i[before], j[before]] = False
        linked[a : a + 256] = hit
    links = np.zeros(n, np.int64)
    links[one] += linked @ copies[two]
    if not within:
        links[two] += linked.T @ copies[one]
    whole = np.zeros((n, n), bool)
    whole[np.ix_(one, two)] = linked
    whole |= whole.T
    root, seen = np.arange(n), np.zeros(n, bool)
    for s in np.argsort(cids, kind="stable").tolist():
        if links[s] and not seen[s]:
            front = np.array([s])
            seen[s] = True
            while len(front):
                root[front] = s
                front = np.flatnonzero(whole[front].any(0) & ~seen)
                seen[front] = True
    some = np.flatnonzero(links)
    return cids[some], links[some], cids[root[some]]


def _links(dealt: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, root) from rows sorted by group: (grp, one, two, block, cid, copies, signs, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if sum(len(h) for h in held) > 1:
                rows = pa.Table.from_batches(held)
                label, bucket, first, second = now
                block, cids, copies = (rows.column(c).to_numpy() for c in ("block", "cid", "copies"))
                vectors, signs = (np.frombuffer(b"".join(rows.column(c).to_pylist()), k).reshape(len(rows), -1) for c, k in (("v", np.float64), ("signs", "<u8")))
                found = _group_links(int(bucket.split(":")[1]), (block != first).astype(int), cids, copies, signs, vectors, threshold, first == second)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["cid", "links", "root"])

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("label", "bucket", "one", "two")), strict=True))
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != now:
                    yield from done()
                    now, held = names[at], []
                held.append(batch.slice(at, end - at))
                at = end
        yield from done()

    return dealt.mapInArrow(run, "cid long, links long, root long")


def links(table: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of each row: how many others it is linked with, and the smallest key it reaches.

    Rows are linked if their labels are equal and not null and the cosine of their vectors is ``threshold`` at least.
    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
    nothing, as do vectors of different lengths.  Rows that repeat a key or a vector are vectors each, and linked if
    their vectors are; a component's name is its smallest key that isn't null.  A row is kept if its key names its
    component, or if it has no key and reaches none.  Other columns are left out; an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = _keys(table, key, vector, label)
    largest = table.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan(largest, threshold)
    usable = rows.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(usable.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    made = _buckets(classes, bits, tables)
    # Buckets of several blocks: there are fewer of them than vectors a BLOCK and table.
    large = _buckets(classes, bits, tables).groupBy("label", "bucket").count().where(F.col("count") > BLOCK)
    large = written(large.select(F.col("label").alias("_label"), F.col("bucket").alias("_bucket"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    if large.limit(1).count():
        made = made.join(large, (F.col("label") == F.col("_label")) & (F.col("bucket") == F.col("_bucket")), "left")
    else:
        made = made.withColumn("blocks", F.lit(None).cast("int"))
    block: Column = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    groups = made.withColumn("block", block).withColumn("_other", other)
    groups = groups.select("label", "bucket", F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"), "block", "cid", "copies", "signs", "v")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["label", "bucket", "one", "two"]
    found = written(_links(groups.repartition(width, *names).sortWithinPartitions(*names), threshold), "vector-links")
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected(found.where("cid <> root"), "cid", "root").withColumnRenamed("node", "cid")
    parts = classes.select("cid", "least").join(parts, "cid")
    least = parts.groupBy("component").agg(F.min("least").alias("component_least"))
    parts = parts.join(least, "component").select("cid", "component_least")
    named = classes.select("label", "key", "least", "copies", "cid").join(counted, "cid", "left").join(parts, "cid", "left")
    named = named.select(F.col("label").alias("_label"), F.col("key").alias("_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_least", "least").alias("component_id"))
    # A class of very many copies is one key of this join, which adaptive execution can split on the side of the rows.
    out = rows.select("id", "label", "key").join(named, (F.col("label") == F.col("_label")) & (F.col("key") == F.col("_key")), "left")
    component = F.when(F.col("_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


#: All pairs with one label; components by the smallest vector that is reached.
SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach as (select vec_id as node, vec_id as root from embeddings union select pairs.b, reach.root from reach join pairs on pairs.a = reach.node)
select e.vec_id, (select count(*) from pairs where pairs.a = e.vec_id) as n_links, r.root as component_id, e.vec_id = r.root as kept
from embeddings e join (select node, min(root) as root from reach group by node) r on r.node = e.vec_id
"""
