"""Exact Jaccard join of documents on word n-grams, in a metric space.

The Jaccard distance of two sets, 1 - |x & y| / |x | y|, is a metric.  The join of all pairs within THETA = 1 - 0.8 runs
over ever smaller regions around pivots:

1. Unrelated documents are at distance 1 from each other, so document pivots alone would copy all of them to every
   region.  The first level therefore deals documents by single shingles: in a fixed order of all shingles a document's
   window holds its first n - ceil(0.8 n) + 1 ones, and a few more, such that linked documents meet in up to eight
   regions, not just one.  Shingles that are frequent in a sample come last in the order; that decides which regions
   are small, never the result.  Pairs that meet often enough, and all members of a region of more than SMALL rows, fall
   into one coarse group.
2. Within a group the pivots are documents, and each document is at home in the Voronoi region of its nearest one.  By
   the triangle inequality a document x has its links at home in the region of pivot p only if
   d(x, p) - d(x, nearest) <= 2 THETA; it is copied to these regions and no other.
3. Documents within THETA of their region's pivot hang on it, and need no comparison with each other.  The rest of a
   region is joined by new pivots, region within region, until LEAF documents are at home or the pivots part it no
   further; then those at home are compared with all, exactly.
4. A group too large for one task goes through the same steps over the cluster, a level a round; what its pivots don't
   part is compared in blocks, those off the pivots with all.

Documents with equal sets are one class from the first step on; what is shuffled of a document is its set's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .pieces import like
from .support import give_back_memory, written
from .textcodes import MIX_A, U, expand, mix, piece_hashes, slices, utf8_column, words

#: Regions of up to so many documents emit pairs; larger ones go to the document pivots as a whole.
SMALL = 64
#: Linked documents share at least min(MEET, ceil(0.8 n)) shingles of their windows.
MEET = 8
#: Shingles kept as frequent ones, and the part of the sets in which they are counted.
FREQUENT, SAMPLE = 500_000, 8
#: Shingles of all documents of a group that one task takes, and of a block of a larger group.
GROUP, BLOCK = 3_000_000, 400_000
#: Rows up to which a table of chosen documents is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Threshold 4/5, and the distance that goes with it.
NUM, DEN = 4, 5
THETA = 1 - NUM / DEN
#: Pivots of a region, the documents at home up to which it is compared at once, and rounds over the cluster.
PIVOTS, LEAF, LEVELS = 8, 48, 6
#: A part of a region is parted further if it holds no more than this share of it, in one task and over the cluster.
PARTED, PARTED_FAR = 0.8, 0.5


def need(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any set linked to it, at least."""
    return -(-NUM * n // DEN)


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DEN * common >= NUM * (n + m - common)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and the offsets of the texts."""
    data, offsets = utf8_column(column)
    data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    starts, ends, per_text = words(data, offsets)
    factors = mix(MIX_A * np.arange(1, width + 1, dtype=U)) | U(1)
    with np.errstate(over="ignore"):
        h = np.concatenate([piece_hashes(data, starts, ends), np.zeros(width, U)])
        whole = sum((h[i : len(h) - width + i] * factors[i] for i in range(1, width)), h[: len(h) - width] * factors[0])
    first = np.cumsum(per_text) - per_text
    counts = np.maximum(per_text - width + 1, (per_text > 0).astype(per_text.dtype))
    at = expand(first, counts)
    values = whole[at]
    upto = np.concatenate([[0], np.cumsum(counts)])
    # A text with fewer words than a shingle has: its whole sequence, without the words that follow it in the batch.
    for text in np.flatnonzero((per_text > 0) & (per_text < width)).tolist():
        k = int(per_text[text])
        with np.errstate(over="ignore"):
            values[upto[text]] = sum((h[first[text] + i] * factors[i] for i in range(k)), U(0)) ^ U(k)
    values = mix(values)
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[upto[:-1][counts > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[upto]


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each set as two integers."""
    raw = memoryview(values.tobytes())
    digests = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _windows(counts: np.ndarray) -> np.ndarray:
    return counts - need(counts) + np.minimum(MEET, need(counts))


def _sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, k1, k2, th, sample): size and hash of each set, hash of its text, for some the shingles of a wider window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                values, offsets = shingle_sets(batch.column(1).slice(a, b - a), width)
                counts, keys = np.diff(offsets), set_keys(values, offsets)
                wide = np.where(keys[:, 0] % SAMPLE == 0, np.minimum(counts, _windows(counts) * 3 // 2), 0)
                sample = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)), pa.array(values[expand(offsets[:-1], wide)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), batch.column(2).slice(a, b - a), sample], schema.names)

    longs = [T.StructField(c, T.LongType()) for c in ("n", "k1", "k2", "th")]
    schema = T.StructType([like(docs, key, "id"), *longs, T.StructField("sample", T.ArrayType(T.LongType()))])
    return docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(run, schema)


def _replicas(docs: DataFrame, text: str, width: int, frequent) -> DataFrame:
    """(token, k1, m) for each region that a document is copied to; m packs n, the place, and whether the pivot is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch.column(0)):
                values, offsets = shingle_sets(batch.column(0).slice(a, b - a), width)
                counts, keys = np.diff(offsets), set_keys(values, offsets)
                new = np.zeros(len(counts), bool)
                for i, k in enumerate(keys[:, 1].tolist()):
                    # A set that this task has copied already gives the same rows.
                    if k not in seen:
                        new[i] = counts[i] > 0
                        if len(seen) < 200_000:
                            seen.add(k)
                size = np.where(new, _windows(counts), 0)
                owner = np.repeat(np.arange(len(counts)), counts)
                at = np.minimum(np.searchsorted(hot, values), max(0, len(hot) - 1))
                late = hot[at] == values if len(hot) else np.zeros(len(values), bool)
                early = np.concatenate([[0], np.cumsum(~late)])
                place = early[:-1] - early[offsets[:-1]][owner]
                cold = ~late & (place < size[owner])
                token, who, at = values[cold], owner[cold], place[cold]
                n_early = early[offsets[1:]] - early[offsets[:-1]]
                # Frequent pivots fill up the window where the others are too few.
                fill = np.maximum(0, size - n_early)
                tail = np.flatnonzero(late & (fill[owner] > 0))
                rank = np.arange(len(tail)) - np.searchsorted(owner[tail], owner[tail])
                tail = tail[rank < fill[owner[tail]]]
                token, who, at = np.concatenate([token, values[tail]]), np.concatenate([who, owner[tail]]), np.concatenate([at, np.full(len(tail), -1)])
                m = counts[who] << 32 | np.where(at < 0, 0xFFFFFFFF, at)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(keys[who, 0]), pa.array(m)], ["token", "k1", "m"])
        give_back_memory()

    return docs.select(text).mapInArrow(run, "token long, k1 long, m long")


def _meetings(replicas: DataFrame) -> DataFrame:
    """(a, b, need): pairs that meet in a small region; with need 0, a document and a large region of its own."""

    def regions(token: np.ndarray, k1: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        same = np.zeros(len(token), bool)
        same[1:] = (token[1:] == token[:-1]) & (k1[1:] == k1[:-1])
        token, k1, m = token[~same], k1[~same], m[~same]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(token)))
        each = np.repeat(size, size)
        frequent = (m & 0xFFFFFFFF) == 0xFFFFFFFF
        large = frequent | (each > SMALL)
        out = [(k1[large], token[large], np.zeros(large.sum(), np.int64))]
        keep = ~large & (each > 1)
        token, k1, n, left = token[keep], k1[keep], m[keep] >> 32, (m[keep] >> 32) - (m[keep] & 0xFFFFFFFF)
        for step in range(1, SMALL):
            if len(token) <= step:
                break
            i = np.flatnonzero(token[step:] == token[:-step])
            if not len(i):
                break
            j = i + step
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            both = np.minimum(MEET, need(low))
            # What linked sets of these sizes share, at least; one of their first meetings leaves room for that.
            shared = -(-NUM * (n[i] + n[j]) // (NUM + DEN))
            ok = (low >= need(high)) & (np.minimum(left[i], left[j]) >= shared - both + 1)
            a, b = k1[i[ok]], k1[j[ok]]
            out.append((np.minimum(a, b), np.maximum(a, b), both[ok]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            # The last region may go on in the next batch; of one that is large already its first rows may go.
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if len(rows[0]) - cut > 4 * SMALL + len(batch) // 2:
                many = [r[cut:] for r in rows]
                if len(np.unique(many[1])) > SMALL:
                    yield pa.RecordBatch.from_arrays([pa.array(many[1]), pa.array(many[0]), pa.array(np.zeros(len(many[0]), np.int64))], ["a", "b", "need"])
                    keep = np.sort(np.unique(many[1], return_index=True)[1][: SMALL + 1])
                    rows = [np.concatenate([r[:cut], x[keep]]) for r, x in zip(rows, many, strict=True)]
            yield regions(*[r[:cut] for r in rows])
            rest = [r[cut:] for r in rows]
        yield regions(*rest)

    frequent = F.col("m").bitwiseAND(0xFFFFFFFF) == 0xFFFFFFFF
    width = int(replicas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = replicas.repartition(width, F.when(frequent, F.col("k1")).otherwise(F.col("token"))).sortWithinPartitions("token", "k1")
    return dealt.mapInArrow(run, "a long, b long, need long")


class _Sets:
    """The sets of a group in one task."""

    def __init__(self, n: np.ndarray, flat: np.ndarray):
        self.n, self.flat = n, flat
        self.first = np.cumsum(n) - n
        self.owner = np.repeat(np.arange(len(n)), n)

    @classmethod
    def of(cls, rows: list[bytes]) -> _Sets:
        return cls(np.fromiter(map(len, rows), np.int64, len(rows)) // 8, np.frombuffer(b"".join(rows), U))

    def take(self, rows: np.ndarray) -> _Sets:
        return _Sets(self.n[rows], self.flat[expand(self.first[rows], self.n[rows])])

    def common_with(self, one: np.ndarray) -> np.ndarray:
        """How many shingles each set shares with the sorted set ``one``."""
        at = np.minimum(np.searchsorted(one, self.flat), len(one) - 1)
        return np.bincount(self.owner[one[at] == self.flat], minlength=len(self.n))

    def from_pivots(self, pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the sets (rows) from the pivots (columns), and whether they are linked, which is exact."""
        common = np.stack([self.common_with(p) for p in pivots], 1)
        sizes = np.array([len(p) for p in pivots])
        return 1 - common / (self.n[:, None] + sizes - common), linked(common, self.n[:, None], sizes)

    def get(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i] + self.n[i]]

    def links(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of ``left`` x ``right`` (indices), by products of 0/1 matrices over the shingles they share."""
        for a in range(0, len(left), 256):
            rows = left[a : a + 256]
            mine = self.flat[expand(self.first[rows], self.n[rows])]
            vocabulary = np.unique(mine)
            spot = np.searchsorted(vocabulary, mine)
            who = np.repeat(np.arange(len(rows)), self.n[rows])
            for b in range(0, len(right), 1024):
                cols = right[b : b + 1024]
                # Sets whose sizes differ too much can't be linked, whatever they share.
                cols = cols[(self.n[cols] >= need(self.n[rows].min())) & (need(self.n[cols]) <= self.n[rows].max())]
                if not len(cols):
                    continue
                theirs = self.flat[expand(self.first[cols], self.n[cols])]
                at = np.minimum(np.searchsorted(vocabulary, theirs), len(vocabulary) - 1)
                hit = vocabulary[at] == theirs
                at, col = at[hit], np.repeat(np.arange(len(cols)), self.n[cols])[hit]
                common = np.zeros((len(rows), len(cols)), np.float32)
                used, at = np.unique(at, return_inverse=True)
                back = np.full(len(vocabulary), -1)
                back[used] = np.arange(len(used))
                mine_at = back[spot]
                for c in range(0, len(used), 4096):
                    x, y = np.zeros((len(rows), 4096), np.float32), np.zeros((len(cols), 4096), np.float32)
                    pick = (mine_at >= c) & (mine_at < c + 4096)
                    x[who[pick], mine_at[pick] - c] = 1
                    pick = (at >= c) & (at < c + 4096)
                    y[col[pick], at[pick] - c] = 1
                    common += x @ y.T
                i, j = np.nonzero(linked(common.astype(np.int64), self.n[rows][:, None], self.n[cols][None, :]))
                yield rows[i], cols[j]


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


def windows(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot that each set is at home with, and to which pivots' regions it is copied, by the triangle inequality.

    If x and y are linked and y is at home with p, then d(x, p) <= THETA + d(y, p) <= THETA + d(y, q) <= 2 THETA + d(x, q)
    for any other pivot q.
    """
    return distances.argmin(1), distances - distances.min(1)[:, None] <= 2 * THETA + 1e-9


def choose_pivots(sets: _Sets, most: int = PIVOTS) -> list[int]:
    """Sets whose shingles are the most frequent ones in the group, for their size, none linked with one before it."""
    _, place, count = np.unique(sets.flat, return_inverse=True, return_counts=True)
    weight = np.bincount(sets.owner, weights=np.minimum(count[place] - 1, 1 << 20), minlength=len(sets.n)) / np.maximum(1, sets.n)
    free, chosen = np.ones(len(sets.n), bool), []
    while free.any() and len(chosen) < most:
        chosen.append(int(np.argmax(np.where(free, weight, -1))))
        free &= ~sets.from_pivots([sets.get(chosen[-1])])[1][:, 0]
        free[chosen[-1]] = False
    return chosen


def _compare(sets: _Sets, names: np.ndarray, home: np.ndarray, union: _Union) -> None:
    """Joins each set at home with all that it is linked with; pairs of the largest component need no comparison."""
    roots = np.array([union.root(i) for i in names.tolist()])
    found, count = np.unique(roots, return_counts=True)
    main = roots == found[count.argmax()]
    for left, right in ((home & ~main, np.ones(len(names), bool)), (home & main, ~main)):
        for i, j in sets.links(np.flatnonzero(left), np.flatnonzero(right)):
            for x, y in zip(names[i].tolist(), names[j].tolist(), strict=True):
                union.join(x, y)


def join_region(sets: _Sets, names: np.ndarray, home: np.ndarray, union: _Union) -> None:
    """Joins in ``union`` the linked sets of a region of which at least one is at home; ``names`` are theirs there."""
    # With few sets at home, to compare them with all costs less than new pivots.
    if home.sum() <= LEAF:
        return _compare(sets, names, home, union)
    pivots = choose_pivots(sets)
    distances, near = sets.from_pivots([sets.get(p) for p in pivots])
    for i, p in enumerate(pivots):
        for x in names[near[:, i]].tolist():
            union.join(int(names[p]), x)
    nearest, window = windows(distances)
    for i in range(len(pivots)):
        own, inside = home & (nearest == i), window[:, i]
        # Sets that hang on the pivot are joined already; a region of no other needs nothing more.
        if not own.any() or near[inside, i].all():
            continue
        rows = np.flatnonzero(inside)
        further = join_region if len(rows) <= PARTED * len(names) else _compare
        further(sets.take(rows), names[rows], own[rows], union)


def group_components(sets: _Sets, home: np.ndarray | None = None, hubs: list | None = None) -> np.ndarray:
    """The component of each set of a group, exactly; sets with one hub are joined from the start."""
    union = _Union(len(sets.n))
    first: dict = {}
    for i, hub in enumerate(hubs or []):
        if hub is not None:
            union.join(first.setdefault(hub, i), i)
    join_region(sets, np.arange(len(sets.n)), np.ones(len(sets.n), bool) if home is None else home, union)
    return union.roots()


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, group after group of the first column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def _small_groups(members: DataFrame) -> DataFrame:
    """(k1, k2, low, root): the smallest id and the smallest k1 of each set's component, for groups that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches):
            own = {(r[1], r[2]): r for r in rows}
            rows = list(own.values())
            roots = group_components(_Sets.of([r[4] for r in rows]))
            low: dict[int, int] = {}
            name: dict[int, int] = {}
            for r, root in zip(rows, roots.tolist(), strict=True):
                low[root] = min(low.get(root, r[3]), r[3])
                name[root] = min(name.get(root, r[1]), r[1])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), *[pa.array([of[x] for x in roots.tolist()], pa.int64()) for of in (low, name)]], ["k1", "k2", "low", "root"])

    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("component", "k1", "k2", "id", "shingles").repartition(width, "component").sortWithinPartitions("component")
    return rows.mapInArrow(run, "k1 long, k2 long, low long, root long")


REGION = "region long, k1 long, n long, home boolean, hub long, shingles binary"


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _regions_in_tasks(regions: DataFrame) -> DataFrame:
    """(a, b): links within regions that fit a task, as many as join what is linked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches):
            roots = group_components(_Sets.of([r[4] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([rows[x][1] for x in roots.tolist()], pa.int64())], ["a", "b"])

    rows = regions.select("region", "k1", "home", "hub", "shingles").repartition(_width(regions), "region").sortWithinPartitions("region")
    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def _pivots(large: DataFrame) -> DataFrame:
    """(region, pivot, k1, shingles): up to PIVOTS sets of each region, from a sample of at most LEAF of those off its pivot."""
    # Which sets are pivots only decides how much is left to compare.
    drawn = Window.partitionBy("region").orderBy(F.xxhash64("k1", "region"))
    some = large.where(F.pmod(F.xxhash64("k1", "region"), F.greatest(F.lit(1), F.floor(F.col("off") / LEAF))) == 0).where("hub is null")
    sample = some.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= LEAF).select("region", "k1", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, rows in _by_group(batches):
            chosen = choose_pivots(_Sets.of([r[2] for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([region] * len(chosen)), pa.array(range(len(chosen)), pa.int32()), pa.array([rows[i][1] for i in chosen]), pa.array([rows[i][2] for i in chosen], pa.binary())], ["region", "pivot", "k1", "shingles"])

    return sample.repartition(_width(large), "region").sortWithinPartitions("region").mapInArrow(run, "region long, pivot int, k1 long, shingles binary")


def _divided(large: DataFrame, pivots: DataFrame) -> DataFrame:
    """The rows of the regions around the pivots: each set once for every window that it is in, and the pivot it hangs on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names = None, [], []
        for batch in batches:
            tasks, pivot = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (tasks[1:] != tasks[:-1]) | ((pivot[1:] < 0) != (pivot[:-1] < 0))])).tolist() + [len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if tasks[a] != now:
                    now, held, names = tasks[a], [], []
                raw = part.column(7).to_pylist()
                if pivot[a] >= 0:
                    held += [np.frombuffer(x, U) for x in raw]
                    names += part.column(3).to_pylist()
                    continue
                if not held:
                    # The sample of this region is empty; it comes out whole, and is compared in blocks.
                    region = mix(part.column(1).to_numpy().view(U)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(region), *[part.column(c) for c in (3, 4, 5)], pa.nulls(len(part), pa.int64()), part.column(7), part.column(1)], ["region", "k1", "n", "home", "hub", "shingles", "parent"])
                for c in range(0, len(raw) if held else 0, 512):
                    distances, near = _Sets.of(raw[c : c + 512]).from_pivots(held)
                    nearest, window = windows(distances)
                    who, which = np.nonzero(window)
                    take = pa.array(who + c)
                    region = mix(part.column(1).to_numpy()[who + c].view(U) * MIX_A + which.astype(U) + U(1)).view(np.int64)
                    hubs = pa.array(np.array(names, np.int64)[which], mask=~near[who, which])
                    home = part.column(5).to_numpy(zero_copy_only=False)[who + c] & (nearest[who] == which)
                    yield pa.RecordBatch.from_arrays([pa.array(region), part.column(3).take(take), part.column(4).take(take), pa.array(home), hubs, part.column(7).take(take), part.column(1).take(take)], ["region", "k1", "n", "home", "hub", "shingles", "parent"])

    deal = large.select(F.xxhash64("region", F.pmod(F.xxhash64("k1", F.lit(1)), "parts")).alias("task"), "region", F.lit(-1).alias("pivot"), "k1", "n", "home", "hub", "shingles")
    parts = large.select("region", "parts").distinct()
    copies = pivots.join(parts, "region").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    copies = copies.select(F.xxhash64("region", "part").alias("task"), "region", "pivot", "k1", F.lit(0).cast("long").alias("n"), F.lit(False).alias("home"), F.lit(None).cast("long").alias("hub"), "shingles")
    dealt = deal.unionByName(copies).repartition(_width(large), "task").sortWithinPartitions("task", F.col("pivot") < 0, "pivot")
    return dealt.mapInArrow(run, REGION + ", parent long")


def _in_blocks(regions: DataFrame) -> DataFrame:
    """(a, b): links in regions that pivots don't part: the sets off the pivot, in blocks, against all, in parts."""
    blocks, parts = F.ceil(F.col("off_n") / BLOCK), F.ceil(F.col("weight") / GROUP)
    rows = regions.withColumn("blocks", F.greatest(F.lit(1), blocks)).withColumn("parts", F.greatest(F.lit(1), parts))
    everywhere = rows.select("region", "k1", "shingles", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.expr("pmod(xxhash64(k1, 1), parts)").alias("part"), F.lit(False).alias("query"))
    queries = rows.where("hub is null").select("region", "k1", "shingles", F.expr("pmod(xxhash64(k1, 2), blocks)").alias("block"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(True).alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches):
            sets = _Sets.of([r[3] for r in rows])
            asks = np.array([r[2] for r in rows])
            union = _Union(len(rows))
            same: dict[int, int] = {}
            for i, r in enumerate(rows):
                union.join(same.setdefault(r[1], i), i)
            for i, j in sets.links(np.flatnonzero(asks), np.flatnonzero(~asks)):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    union.join(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([rows[x][1] for x in union.roots().tolist()])], ["a", "b"])

    dealt = everywhere.union(queries).select(F.xxhash64("region", "block", "part").alias("task"), "k1", "query", "shingles")
    dealt = dealt.repartition(_width(regions), "task").sortWithinPartitions("task", F.desc("query"))
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def _large_groups(members: DataFrame) -> DataFrame:
    """The same for groups of any size, over the whole cluster: a round a level of regions."""
    members = written(members, "large-groups")
    regions = members.select(F.col("component").alias("region"), "k1", "n", F.lit(True).alias("home"), F.lit(None).cast("long").alias("hub"), "shingles", F.lit(None).cast("long").alias("parent"))
    before, found = None, []
    for level in range(LEVELS + 1):
        off = F.col("hub").isNull()
        totals = regions.groupBy("region").agg(F.sum("n").alias("weight"), F.sum(F.when(off, F.col("n")).otherwise(0)).alias("off_n"), F.count(F.when(off, 1)).alias("off"), F.max("home").alias("some"), F.max("parent").alias("parent"))
        # Where every set hangs on the pivot, or none is at home, nothing is left to compare.
        totals = totals.where("some and off > 0")
        if before is not None:
            totals = totals.join(before, "parent", "left").withColumn("whole", F.col("weight") > PARTED_FAR * F.col("was"))
        else:
            totals = totals.withColumn("whole", F.lit(False))
        totals = written(totals.select("region", "weight", "off", "off_n", "whole"), "region-sizes")
        sized = regions.drop("parent").join(totals, "region")
        found.append(written(_regions_in_tasks(sized.where(F.col("weight") <= GROUP)), "region-links"))
        large = F.col("weight") > GROUP
        stuck = large & (F.col("whole") if level < LEVELS else F.lit(True))
        if totals.where(stuck).limit(1).count():
            found.append(written(_in_blocks(sized.where(stuck)), "block-links"))
        if not totals.where(large & ~stuck).limit(1).count():
            break
        rest = written(sized.where(large & ~stuck).withColumn("parts", F.ceil(F.col("weight") / GROUP)).select("region", "k1", "n", "home", "hub", "shingles", "off", "parts"), "large-regions")
        pivots = written(_pivots(rest), "pivots")
        before = totals.where(large & ~stuck).select(F.col("region").alias("parent"), F.col("weight").alias("was"))
        regions = written(_divided(rest, pivots), "regions")
        found.append(regions.where("hub is not null").select(F.col("k1").alias("a"), F.col("hub").alias("b")))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    labels = connected(edges.where("a <> b"))
    names = members.select("k1", "k2", "id").join(labels, members.k1 == labels.node, "left").select("k1", "k2", "id", F.coalesce(labels.component, members.k1).alias("root"))
    names = written(names.distinct(), "large-names")
    return names.join(names.groupBy("root").agg(F.min("id").alias("low")), "root").select("k1", "k2", "low", "root")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(key, n_shingles, component_id) of each row: the size of its set, and the smallest key of its component.

    Texts without a word have an empty set, are linked with nothing and are their own component, as are rows with a
    null key (component_id null).  Repeated rows give a row each, in one component.  Other columns are left out.
    """
    return rows_of(docs, key, text, width).select(key, "n_shingles", "component_id")


def rows_of(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``join`` with ``th``, the hash of the text, and ``root``, which names the component.

    Where a key stands for several texts, component_id may be that of several components; root is of one only (null
    for rows with a null key or an empty set).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    keys = written(_sets(docs, key, text, width), "jaccard-sets")
    counted = keys.select(F.explode("sample").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c >= 3")
    tokens = [r.token for r in counted.orderBy(F.desc("c"), "token").limit(FREQUENT).select("token").toLocalIterator()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(tokens, np.int64).view(U)))

    pairs = _meetings(_replicas(docs.where(F.col(key).isNotNull()), text, width, frequent))
    edges = written(pairs.groupBy("a", "b", "need").agg(F.count("*").alias("c")).where("c >= need").select("a", "b", "need"), "jaccard-edges")
    labels = connected(edges)
    nodes = edges.select("a").union(edges.where("need > 0").select("b")).distinct()
    coarse = nodes.join(labels, nodes.a == labels.node).select(F.col("a").alias("k1"), "component")

    sets = written(keys.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("id")), "jaccard-classes")
    grouped = sets.join(coarse, "k1")
    sizes = grouped.groupBy("component").agg(F.sum("n").alias("weight"), F.count("*").alias("members")).where("members > 1")
    chosen = written(grouped.join(sizes, "component").select("id", "k1", "k2", "n", "component", "weight", "members"), "jaccard-chosen")
    if (n_chosen := chosen.count()) == 0:
        found = spark.createDataFrame([], "k1 long, k2 long, low long, root long")
    else:
        few = F.broadcast(chosen) if n_chosen <= BROADCAST_ROWS else chosen
        texts = docs.join(few, docs[key] == chosen.id).select("id", "k1", "k2", "n", "component", "weight", "members", text)
        schema = "id long, k1 long, k2 long, n long, component long, weight long, members long, shingles binary"

        def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(7)):
                    part = batch.slice(a, b - a)
                    values, offsets = shingle_sets(part.column(7), width)
                    raw = values.tobytes()
                    # A key may stand for several texts; only the one that was chosen belongs here.
                    right = (set_keys(values, offsets) == np.stack([part.column(i).to_numpy() for i in (1, 2)], 1)).all(1)
                    packed = pa.array([raw[8 * x : 8 * y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:7], packed], [f.name for f in batch.schema][:7] + ["shingles"]).filter(pa.array(right))

        members = texts.mapInArrow(with_sets, schema)
        found = _small_groups(members.where(F.col("weight") <= GROUP))
        if chosen.where(F.col("weight") > GROUP).limit(1).count():
            found = found.union(_large_groups(members.where(F.col("weight") > GROUP)))
        found = written(found, "jaccard-found")
    classes = sets.join(found, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("low", "id").alias("component_id"), F.coalesce("root", "k1").alias("root"))
    some = F.col("n") > 0
    out = keys.where(some & F.col("id").isNotNull()).join(classes, ["k1", "k2"]).select("id", "n", "component_id", "th", "root")
    alone = keys.where(~some | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"), "th", F.lit(None).cast("long").alias("root"))
    return out.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "th", "root")


#: The same rows by all pairs that share a shingle; for small tables.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select doc_id, len(sh)::bigint as n from s),
e as (select doc_id, unnest(sh) as x from s),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
r(a, b) as (select doc_id, doc_id from n union select r.a, l.b from r join l on r.b = l.a)
select n.doc_id, n.n as n_shingles, min(r.b) as component_id from n join r on r.a = n.doc_id group by n.doc_id, n.n
"""
