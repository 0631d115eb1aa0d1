"""Alignment of two tokenizers' tokens over the same texts, and how often each pair of ids is linked in the corpus.

Both tokenizers cut the bytes of a text, one in tokens A and one in tokens B.  Two tokens are linked if their byte ranges
overlap: a bipartite graph, whose edges are found in one sweep over the ends of all tokens.  Union-find over the edges
gives its components, and these are exactly the smallest groups of neighbouring tokens that both tokenizers end together.

1. Texts are encoded where they are read, and the ids are written: a few bytes a word, whatever comes later.
2. Each task expands the members of its components to links and counts them by id pair; the sums are shuffled, a row a
   pair and task, and the highest count of each B id follows from them.
3. Each document asks for the counts of its links in two tiers: the most frequent pairs, at most FREQUENT of them, are sent
   to all tasks; only the other links are joined with the table of counts, whose keys are rare by then.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import PieceEncoder, like, texts_of
from .support import give_back_memory, written
from .textcodes import expand, slices
from .token_counts import PieceModel
from .token_files import LibraryPieces

#: Pieces that a worker keeps of each tokenizer.
CACHE = 400_000
#: Id pairs whose counts are sent to all tasks, at most, and pairs that a task holds before it sends their counts.
FREQUENT, HELD = 1 << 19, 1 << 21


class Tokens:
    """The bytes of a vocabulary's tokens: one after the other, where each begins, and how many each has."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        return self.flat[expand(self.begin[ids], self.sizes[ids])].tobytes()


def byte_tokens(spec: str) -> Tokens:
    """The tokens of a byte-level vocabulary (.json), decoded."""
    library = LibraryPieces(spec)
    back = {mark: byte for byte, mark in library.marks.items()}
    entries = library.tokenizer.get_vocab(with_added_tokens=True)
    found = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        found[i] = bytes(back.get(ord(c), ord(c) & 0xFF) for c in entry)
    return Tokens(found)


def piece_tokens(model: PieceModel) -> Tokens:
    """The tokens of a piece vocabulary: U+2581 is a blank, and byte tokens are bytes."""
    p = model.processor
    return Tokens([bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.vocab_size())])


def packing(n_tokens: int) -> str:
    """How ids are packed: two bytes each where the vocabulary allows it."""
    return "<u2" if n_tokens <= 1 << 16 else "<u4"


class Encoders:
    """A worker's two encoders, with their caches."""

    def __init__(self, spec: str, model: PieceModel):
        a = LibraryPieces(spec)
        # Special strings are ordinary text: pieces go to the model without a look for them.
        self.a = PieceEncoder(a.encode_pieces, a.dtype, CACHE)
        self.model, self.b = model, PieceEncoder(self._pieces, packing(model.processor.vocab_size()), CACHE, model.starts)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x, self.b.dtype).tobytes() for x in self.model.ids(pieces)]


_encoders: dict[str, Encoders] = {}


def encoded(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, a, b): the ids of blank and text by a byte-level .json vocabulary, and of the text by a piece model.

    Ids are packed as little-endian integers of two bytes, or of four (``packing``).  Texts that are null or empty, and those of which one vocabulary
    doesn't give back blank and text, have none.  ``row`` tells rows apart, whatever their keys.
    """
    with open(a_path, encoding="utf-8") as file:
        spec = file.read()
    with open(b_path, "rb") as file:
        model = PieceModel(file.read())
    shared, name = docs.sparkSession.sparkContext.broadcast((spec, model, byte_tokens(spec), piece_tokens(model))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, model, a_tokens, b_tokens = shared.value
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoders(spec, model)
        encode = _encoders[name]
        for batch in batches:
            for x, y in slices(batch.column(2)):
                part = batch.slice(x, y - x)
                texts = texts_of(part.column(2))
                a, a_offsets = encode.a([" " + t if t else "" for t in texts])
                b, b_offsets = encode.b(model.marked(texts))
                whole = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
                joined = a_tokens.joined(a), b_tokens.joined(b)
                upto = [np.concatenate([[0], np.cumsum(t.sizes[i])])[o].tolist() for t, i, o in ((a_tokens, a, a_offsets), (b_tokens, b, b_offsets))]
                fine = [all(j[u[i] : u[i + 1]] == w for j, u in zip(joined, upto, strict=True)) for i, w in enumerate(whole)]
                packed = [[i[o[k] : o[k + 1]].astype(packing(len(t.sizes))).tobytes() if ok else b"" for k, ok in enumerate(fine)] for t, i, o in ((a_tokens, a, a_offsets), (b_tokens, b, b_offsets))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, pa.binary()) for c in packed]], schema.names)
        give_back_memory()

    schema = T.StructType([T.StructField("row", T.LongType()), like(docs, key, "id"), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    return docs.select(F.monotonically_increasing_id().alias("row"), key, text).mapInArrow(run, schema)


def union_find(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component; all edges are joined at once until none leads further."""
    parent = np.arange(n)
    while True:
        x, y = parent[one], parent[two]
        apart = x != y
        if not apart.any():
            return parent
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = parent[parent]
            if (higher == parent).all():
                break
            parent = higher
        one, two = one[apart], two[apart]


class Alignment:
    """The tokens of several documents, their links, and the groups that these make."""

    def __init__(self, a: pa.Array, b: pa.Array, a_sizes: np.ndarray, b_sizes: np.ndarray):
        (self.a, self.a_offsets), (self.b, self.b_offsets) = _ids(a, packing(len(a_sizes))), _ids(b, packing(len(b_sizes)))
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        length = int(a_ends[-1]) if len(a_ends) else 0
        at_a, at_b = np.zeros(length + 1, bool), np.zeros(length + 1, bool)
        at_a[a_ends], at_b[b_ends] = True, True
        # A link for each stretch between two ends, of whichever side: its tokens are those that end there or later.
        ends = np.flatnonzero(at_a | at_b)
        self.link_a = (np.cumsum(at_a) - at_a)[ends]
        self.link_b = (np.cumsum(at_b) - at_b)[ends]

    def pairs(self) -> np.ndarray:
        """The ids of each link as one integer, in the order of the text."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b].astype(np.int64)

    def link_offsets(self) -> np.ndarray:
        """The first link of each document."""
        return np.searchsorted(self.link_a, self.a_offsets)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of either side; groups count from 0 in the order of the text."""
        n = len(self.a)
        root = union_find(n + len(self.b), self.link_a, n + self.link_b)
        # The smallest node of a component is its first token A, as each has one.
        number = np.cumsum(root[:n] == np.arange(n)) - 1
        return number[root[:n]], number[root[n:]]


def _ids(column: pa.Array, packed: str) -> tuple[np.ndarray, np.ndarray]:
    rows, width = column.to_pylist(), np.dtype(packed).itemsize
    return np.frombuffer(b"".join(rows), packed).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) // width for x in rows])]).astype(np.int64)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about half a MB of ids each; a longer document is one of its own."""
    size = np.cumsum([len(x) for x in batch.column(column).to_pylist()])
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 19), "right")))
        yield batch.slice(at, end - at)
        at = end


def pair_counts(ids: DataFrame, sizes) -> DataFrame:
    """(pair, links, best) of each pair of ids that is linked; best if no other pair of its B id has more links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                new, n = np.unique(Alignment(part.column(0), part.column(1), *sizes.value).pairs(), return_counts=True)
                pairs, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
                if len(pairs) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "links"])
                    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "links"])

    counted = written(ids.select("a", "b").mapInArrow(run, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links")), "id-pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counted.groupBy(b).agg(F.max("links").alias("most"))
    return counted.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def alignments(ids: DataFrame, sizes) -> DataFrame:
    """(row, seq, a array<int>, b array<int>): a row for each group of a document, in the order of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                aligned = Alignment(part.column(1), part.column(2), *sizes.value)
                a_group, b_group = aligned.groups()
                n = int(a_group[-1]) + 1 if len(a_group) else 0
                first = np.searchsorted(a_group, np.arange(n + 1))
                doc = np.searchsorted(aligned.a_offsets, first[:-1], "right") - 1
                seq = np.arange(n) - np.searchsorted(doc, doc)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(i.astype(np.int32))) for at, i in ((first, aligned.a), (np.searchsorted(b_group, np.arange(n + 1)), aligned.b))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(seq.astype(np.int32)), *lists], ["row", "seq", "a", "b"])

    return ids.select("row", "a", "b").mapInArrow(run, "row long, seq int, a array<int>, b array<int>")


class Decimals:
    """Decimal ids with a separator behind each, for many ids at once."""

    def __init__(self, most: int):
        texts = [str(i) for i in range(most)]
        width = len(texts[-1]) + 1 if texts else 1
        self.digits = np.fromiter(map(len, texts), np.int64, most)
        self.table = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode(), np.uint8).reshape(-1, width)

    def joined(self, ids: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text of all ids and the offset behind each separator."""
        rows = self.table[ids]
        rows[np.arange(len(ids)), self.digits[ids]] = separators
        return rows[rows != 0].tobytes(), np.concatenate([[0], np.cumsum(self.digits[ids] + 1)])


def group_texts(aligned: Alignment, decimals: Decimals) -> tuple[list[bytes], np.ndarray]:
    """For each document its groups as ``a1,a2|b1;a3|b2,b3``, and the number of its groups."""
    a_group, b_group = aligned.groups()
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    a_ends, b_ends = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
    # Each token's place where a group's tokens A come first, and then its tokens B.
    ids, separators = np.empty(len(aligned.a) + len(aligned.b), np.int64), np.full(len(aligned.a) + len(aligned.b), ord(","), np.uint8)
    ids[np.arange(len(aligned.a)) + np.append(0, b_ends)[a_group]] = aligned.a
    ids[np.arange(len(aligned.b)) + a_ends[b_group]] = aligned.b
    separators[a_ends + np.append(0, b_ends)[:-1] - 1], separators[a_ends + b_ends - 1] = ord("|"), ord(";")
    text, upto = decimals.joined(ids, separators)
    bounds = upto[aligned.a_offsets + aligned.b_offsets].tolist()
    first = np.append(a_group, n)[aligned.a_offsets]
    return [text[x : max(x, y - 1)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], np.diff(first)


def _frequent(counts: DataFrame) -> tuple[DataFrame, int]:
    """The counts with a band of about a twelfth of their size, and the lowest band of the frequent pairs."""
    banded = written(counts.withColumn("band", F.floor(F.log2("links") * 8).cast("int")), "id-pair-counts")
    held, lowest = 0, 1 << 30
    for band, n in sorted(banded.groupBy("band").count().collect(), reverse=True):
        held += n
        if held > FREQUENT:
            break
        lowest = band
    return banded, lowest


def summaries(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    n_best counts the links whose pair has the highest count of its B id in the corpus, ties among them; count_sum adds
    up the counts of all links.  Null and empty texts, and those that a vocabulary doesn't give back byte for byte, have
    zeros and ''.  Rows that repeat a key or a text are documents each, and count each; null keys stay.  Other columns
    are left out; an empty table gives an empty result.
    """
    ids = written(encoded(docs, a_path, b_path, key, text), "token-ids")
    with open(a_path, encoding="utf-8") as file:
        a_tokens = byte_tokens(file.read())
    with open(b_path, "rb") as file:
        b_tokens = piece_tokens(PieceModel(file.read()))
    context = docs.sparkSession.sparkContext
    sizes = context.broadcast((a_tokens.sizes, b_tokens.sizes))
    counts, lowest = _frequent(pair_counts(ids, sizes))
    frequent = counts.where(F.col("band") >= lowest).select("pair", "links", "best").toArrow().sort_by("pair")
    tier = context.broadcast(tuple(frequent.column(c).to_numpy() for c in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = tier.value
        decimals = Decimals(max(map(len, sizes.value)))
        for batch in batches:
            for part in _parts(batch, 2):
                aligned = Alignment(part.column(2), part.column(3), *sizes.value)
                texts, n_groups = group_texts(aligned, decimals)
                pairs, bounds = aligned.pairs(), aligned.link_offsets()
                at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                total, tops = (np.concatenate([[0], np.cumsum(x)]) for x in (np.where(hit, links[at] if len(known) else 0, 0), np.where(hit, best[at] if len(known) else False, False)))
                rare = np.flatnonzero(~hit)
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, bounds).astype(np.int32)), pa.array(pairs[rare]))
                columns = [np.diff(aligned.a_offsets), np.diff(aligned.b_offsets), n_groups, np.diff(bounds), np.diff(tops[bounds]), np.diff(total[bounds])]
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(digests, pa.string()), rest], schema.names)
        give_back_memory()

    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([T.StructField("row", T.LongType()), like(docs, key, "id"), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("groups_sha256", T.StringType()), T.StructField("rare", T.ArrayType(T.LongType()))])
    rows = written(ids.mapInArrow(run, schema), "alignments")
    rare = rows.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("n"))
    more = rare.join(counts.where(F.col("band") < lowest), "pair")
    more = more.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
    out = rows.drop("rare").join(more, "row", "left")
    whole = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", *whole, "groups_sha256")
