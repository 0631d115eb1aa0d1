"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, and each half is quantised by a codebook of its own; a vector stands in the cell of
its two centroids.  A query looks at pairs of centroids in the order of their summed distance, kept in a heap, until
the cells looked at hold enough vectors; those are reranked by the exact inner product of the original vectors.

How many vectors are enough is measured: for queries drawn from the fitted sample, against all of it, the part of the
vectors that must be looked at to meet TARGET of the true neighbours.  Within a task rows are sorted by their cell, and a
query is multiplied with the rows of the cells that it visits and no others.

Nearness is the inner product, so the distance of a half from a centroid is minus their inner product, less SLACK
times the length of the half and the spread of the vectors around that centroid: long vectors and wide cells, which
may hold large products, come earlier.  It needs no vectors of length one, and it is the same at every table size.

The codebooks are fitted on a sample of at most SAMPLE vectors; every vector is indexed.  The table of cells has
CODES**2 entries at most.  Index rows are dealt by the first centroid and, where that one is frequent, by parts of
PART vectors, drawn row by row; a query goes only to the parts of centroids that it visits, so neither a hot centroid
nor a hot vector is one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import written

SAMPLE, CODES, ROUNDS = 20_000, 128, 12
#: The part of the true neighbours that the measured reach meets, and the queries that it is measured with.
TARGET, PROBES = 0.95, 256
SLACK = 0.4
PART = 16_384


def codebook(half: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Centroids of a half by Lloyd's rounds from a drawn start."""
    draw = np.random.default_rng(seed)
    centroids = half[draw.choice(len(half), min(codes, len(half)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = distances(half, centroids).argmin(1)
        count = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, half)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


def distances(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (half**2).sum(1)[:, None] - 2 * half @ centroids.T + (centroids**2).sum(1)


class Book:
    """The codebook of a half: centroids, and the spread of the fitted vectors around each."""

    def __init__(self, half: np.ndarray, codes: int, seed: int):
        self.centroids = codebook(half, codes, seed)
        at = self.assign(half)
        square = ((half - self.centroids[at]) ** 2).sum(1)
        count = np.bincount(at, minlength=len(self.centroids))
        self.spread = np.sqrt(np.bincount(at, square, len(self.centroids)) / np.maximum(1, count))

    def assign(self, half: np.ndarray) -> np.ndarray:
        return distances(half, self.centroids).argmin(1)

    def far(self, half: np.ndarray) -> np.ndarray:
        """How far each row of ``half``, as a query, is from each centroid; the two halves' distances add up."""
        return -(half @ self.centroids.T) - SLACK * np.linalg.norm(half, axis=1)[:, None] * self.spread


def products(x: np.ndarray, vectors: np.ndarray, cells: np.ndarray, visited: np.ndarray) -> tuple[np.ndarray, int]:
    """Inner products of queries with the rows of the cells that they visit, minus infinity elsewhere; and how many.

    Rows are sorted by their cell, so each cell is one slice, and only the queries that visit it are multiplied with it.
    """
    out, made = np.full((len(x), len(vectors)), -np.inf), 0
    bounds = np.searchsorted(cells, np.arange(visited.shape[1] + 1))
    for j in np.flatnonzero(np.diff(bounds)).tolist():
        some, a, b = np.flatnonzero(visited[:, j]), bounds[j], bounds[j + 1]
        if len(some):
            out[some, a:b] = x[some] @ vectors[a:b].T
            made += len(some) * (b - a)
    return out, made


def traverse(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, enough: int) -> float:
    """The summed distance of the last cell that a query visits.

    Both halves' centroids are taken in the order of their distance; a heap holds the next pairs, and a pair is
    pushed once both pairs before it have been taken.
    """
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    a, b, held = one[first].tolist(), two[second].tolist(), sizes[np.ix_(first, second)].tolist()
    n, m = len(a), len(b)
    taken = [0] * n
    heap = [(a[0] + b[0], 0, 0)]
    found, last = 0, -np.inf
    while heap and found < enough:
        last, i, j = heapq.heappop(heap)
        found += held[i][j]
        taken[i] = j + 1
        if i + 1 < n and taken[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < m and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return last


def measured_reach(fitted: np.ndarray, books: tuple[Book, Book], k: int) -> float:
    """The part of all vectors that a query has to look at, by drawn queries against the fitted vectors."""
    cut, n = books[0].centroids.shape[1], len(fitted)
    if n <= k + 1:
        return 1.0
    picks = np.random.default_rng(3).choice(n, min(PROBES, n), replace=False)
    cell = books[0].assign(fitted[:, :cut]) * len(books[1].centroids) + books[1].assign(fitted[:, cut:])
    sizes = np.bincount(cell, minlength=len(books[0].centroids) * len(books[1].centroids))
    needed = []
    for a in range(0, len(picks), 32):
        asked = fitted[picks[a : a + 32]]
        near = asked @ fitted.T
        near[np.arange(len(asked)), picks[a : a + 32]] = -np.inf
        best = np.argpartition(-near, k, 1)[:, :k]
        far = (books[0].far(asked[:, :cut])[:, :, None] + books[1].far(asked[:, cut:])[:, None, :]).reshape(len(asked), -1)
        for q in range(len(asked)):
            order = np.argsort(far[q], kind="stable")
            upto = np.empty(len(order), np.int64)
            upto[order] = np.cumsum(sizes[order])
            needed.append(upto[cell[best[q]]])
    return float(np.quantile(np.concatenate(needed), TARGET)) / n


def _usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key whose vector has only finite components and not only zeros."""
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(table: DataFrame, queries_divide: int, k: int = 20, key: str = "vec_id", vector: str = "embedding", reach: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` nearest of those looked at, by largest inner product.

    ``reach`` is the part of all vectors that a query looks at; it is measured if it isn't given.
    Queries are the rows whose key is divisible by ``queries_divide``; a row is no candidate of its own.  Rows with a
    null key, and vectors that are null, empty, zero or hold null or non-finite components take no part; rows that
    repeat a key are candidates each, but no query repeats (the row with the smallest vector asks).  Keys are read as
    long.  Vectors of several lengths are an error, since they have no inner product.  An empty table gives an empty
    result; other columns are left out.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(_usable(table, key, vector), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).limit(2).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths, such as {lengths[0].n} and {lengths[1].n}")
    total = lengths[0].c
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(-(-total // SAMPLE))) == 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = rows.limit(1).select("v").toArrow().column(0).combine_chunks()
    fitted = _matrix(sample)
    cut = fitted.shape[1] // 2
    codes = max(1, min(CODES, len(fitted) // 8))
    pair = (Book(fitted[:, :cut], codes, 1), Book(fitted[:, cut:], codes, 2))
    reach = measured_reach(fitted, pair, k) if reach is None else reach
    books = spark.sparkContext.broadcast(pair)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                i, j = books.value[0].assign(x[:, :cut]), books.value[1].assign(x[:, cut:])
                # Rows are dealt to the parts of a hot centroid in turn, whatever their keys.
                turn = np.arange(at, at + len(x), dtype=np.int64)
                at += len(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(turn), batch.column(1)], ["id", "i", "j", "turn", "v"])

    index = written(rows.mapInArrow(assign, "id long, i int, j int, turn long, v array<double>"), "multi-index")
    sizes = np.zeros((codes, codes), np.int64)
    for r in index.groupBy("i", "j").agg(F.count("*").alias("c")).collect():
        sizes[r.i, r.j] = r.c
    parts = np.maximum(1, -(-sizes.sum(1) // PART))
    enough = min(total, max(k + 1, int(np.ceil(reach * total))))
    shared = spark.sparkContext.broadcast((sizes, parts, enough))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, parts, enough = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            one, two = books.value[0].far(x[:, :cut]), books.value[1].far(x[:, cut:])
            for q in range(len(x)):
                # The last cell is in, whatever the rounding of its distance elsewhere.
                cutoff = traverse(one[q], two[q], sizes, enough) + 1e-9 * (np.abs(one[q]).max() + np.abs(two[q]).max())
                visited = ((one[q][:, None] + two[q] <= cutoff) & (sizes > 0)).any(1)
                where = [(i, p) for i in np.flatnonzero(visited).tolist() for p in range(parts[i])]
                yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in where], pa.int32()), pa.array([w[1] for w in where], pa.int32()), pa.array([True] * len(where)), pa.array([batch.column(0)[q].as_py()] * len(where), pa.int64()), pa.array([-1] * len(where), pa.int32()), pa.array([cutoff] * len(where)), pa.array([x[q]] * len(where), pa.list_(pa.float64()))], ["i", "part", "query", "id", "j", "cutoff", "v"])

    layout = "i int, part int, query boolean, id long, j int, cutoff double, v array<double>"
    asked = rows.where(F.pmod("id", F.lit(queries_divide)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    probes = asked.mapInArrow(probe, layout)
    counts = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("i") + 1)
    stored = index.select("i", F.pmod("turn", counts).cast("int").alias("part"), F.lit(False).alias("query"), "id", "j", F.lit(0.0).alias("cutoff"), "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, data = None, [], None
        for batch in batches:
            lists = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], 1)
            query = batch.column(2).to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]).any(1) | (query[1:] != query[:-1])])).tolist() + [len(batch)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(a, b - a)
                name = tuple(lists[a].tolist())
                if name != now:
                    now, held, data = name, [], None
                if not query[a]:
                    held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(6))))
                    continue
                if data is None:
                    if not held:
                        continue
                    data = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield from _nearest(data, part, now[0])

    def _nearest(data: list[np.ndarray], part: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        ids, second, vectors = data
        asks, cutoffs, x = part.column(3).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(6))
        cells = books.value[0].far(x[:, :cut])[:, [i]] + books.value[1].far(x[:, cut:])
        longest = np.sqrt((vectors**2).sum(1).max())
        # Queries at once, such that their products have a bounded size.
        step = max(16, (1 << 22) // len(vectors))
        for a in range(0, len(x), step):
            asked, keys = x[a : a + step], asks[a : a + step]
            rough, _ = products(asked, vectors, second, cells[a : a + step] <= cutoffs[a : a + step, None])
            # The query's own row.
            rough[keys[:, None] == ids[None, :]] = -np.inf
            n = min(k, rough.shape[1])
            least = np.partition(rough, rough.shape[1] - n, 1)[:, rough.shape[1] - n]
            room = 1e-9 * longest * np.sqrt((asked**2).sum(1))
            q, p = np.nonzero((rough >= (least - room)[:, None]) & (rough > -np.inf))
            # The score is summed in the order of the components, so that equal vectors score the same.
            score = np.zeros(len(q))
            for c in range(x.shape[1]):
                score += vectors[p, c] * asked[q, c]
            order = np.lexsort((ids[p], -score, q))
            q, p, score = q[order], p[order], score[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(keys[q[best]]), pa.array(ids[p[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    from pyspark.sql import Window

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored.union(probes).repartition(width, "i", "part").sortWithinPartitions("i", "part", "query", "j")
    scored = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
