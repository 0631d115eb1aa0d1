"""Token counts of whole texts by a piece vocabulary, without any shuffle of pre-tokens.

A pre-token here is a longest run in which each pair of neighbouring characters occurs inside some piece of the
vocabulary: merges can't cross any other place, so the counts of the runs add up to the text's.  Lookup is in two
tiers: a compact hash table of the lengths of frequent pre-tokens, fitted on a bounded sample and broadcast, then a
cache in each worker for the rest.  The sample only says which lengths are held ready; every count is exact.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import LONGEST_KEPT, like, texts_of
from .textcodes import TwoAgeCache, code_points, distinct, equal_pieces, piece_hashes, slices

#: Documents of the sample and entries of the broadcast table (20 bytes and the pre-token each), at most.
SAMPLE_DOCS, FREQUENT = 4_000, 65_536
#: Entries that all tasks send of the sample, and that one sends at least (20 bytes and the pre-token each).
SENT, LEAST_SENT = 1 << 20, 512
CACHE = 1_000_000
BLANK = 0x2581


class PieceModel:
    """A vocabulary whose texts are taken as they are, with a blank put before each."""

    def __init__(self, proto: bytes):
        self.proto = proto
        self._open()

    def _open(self) -> None:
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        if p.decode(p.encode(probe := "x  ﬁ½\tA ")) != probe:
            raise ValueError("the vocabulary normalises texts; counts by pre-token wouldn't add up")
        pieces = [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        pairs = {ord(a) << 21 | ord(b) for piece in pieces for a, b in zip(piece, piece[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.near = np.zeros(1 << 20, bool)
        low = [(x >> 21, x & 0x1FFFFF) for x in pairs]
        self.near[[a << 10 | b for a, b in low if a < 1024 and b < 1024]] = True

    def __getstate__(self) -> bytes:
        return self.proto

    def __setstate__(self, proto: bytes) -> None:
        self.proto = proto
        self._open()

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The marked texts joined and as codes, starts, ends and hashes of their pre-tokens, and the first one of each text."""
        marked = self.marked(texts)
        codes, offsets = code_points(marked)
        codes = codes.astype(np.int64)
        starts = self.starts(codes, offsets)
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        return "".join(marked), codes, starts, ends, piece_hashes(codes, starts, ends), np.searchsorted(starts, offsets)

    def marked(self, texts: list[str]) -> list[str]:
        return ["▁" + t.replace(" ", "▁") if t else "" for t in texts]

    def starts(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of marked texts."""
        codes = codes.astype(np.int64)
        start = np.ones(len(codes), bool)
        if len(codes):
            a, b = codes[:-1], codes[1:]
            # The mark of a blank stands at its own place in the small table.
            a, b = np.where(a == BLANK, 0, a), np.where(b == BLANK, 0, b)
            small = (a < 1024) & (b < 1024)
            bound = np.zeros(len(a), bool)
            bound[small] = self.small()[(a[small] << 10) | b[small]]
            rest = np.flatnonzero(~small)
            bound[rest] = np.isin(codes[:-1][rest] << 21 | codes[1:][rest], self.pairs)
            start[1:] = ~bound
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(start)

    def small(self) -> np.ndarray:
        """The table of pairs below 1024, with the mark of a blank as 0 (texts may hold the code 0: it is no piece)."""
        if not hasattr(self, "_small"):
            table = self.near.copy()
            for x in self.pairs.tolist():
                a, b = x >> 21, x & 0x1FFFFF
                if BLANK in (a, b) and (a == BLANK or a < 1024) and (b == BLANK or b < 1024):
                    table[(0 if a == BLANK else a) << 10 | (0 if b == BLANK else b)] = True
            self._small = table
        return self._small

    def ids(self, pieces: list[str]) -> list[list[int]]:
        """Tokens of each pre-token: encoded after a newline, which nothing merges with, so that no blank is put before it."""
        return [x[2:] for x in self.processor.encode(["\n" + p for p in pieces], num_threads=1)] if pieces else []

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.ids(pieces)]


class Frequent:
    """Lengths of frequent pre-tokens: found by a 64-bit hash in sorted arrays, then compared with the pre-token kept there."""

    def __init__(self, pieces: list[str], lengths: np.ndarray):
        codes, offsets = code_points(pieces)
        hashes = piece_hashes(codes, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[order], lengths[order].astype(np.int32)
        self.codes, self.starts, self.sizes = codes, offsets[:-1][order].astype(np.int32), np.diff(offsets)[order].astype(np.int16)

    def find(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The lengths, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            near = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == ends - starts))
            near = near[equal_pieces(codes, starts[near], self.codes, self.starts[at[near]], (ends - starts)[near])]
            found[near] = self.lengths[at[near]]
        return found


def frequent_pieces(docs: DataFrame, model: PieceModel, key: str, text: str) -> Frequent:
    """The most frequent pre-tokens of at most about SAMPLE_DOCS documents, chosen by the hash of their key.

    Each task sends one row, its own most frequent pre-tokens with their counts and lengths; the rows are added up on the
    driver, and a task sends the fewer the more tasks there are.  No pre-token is shuffled.
    """
    rows, tasks = docs.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    chosen = docs.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows // SAMPLE_DOCS)))) == 0)
    most = max(LEAST_SENT, min(FREQUENT, SENT // max(1, tasks)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for a, b in slices(batch.column(0)):
                joined, codes, starts, ends, hashes, _ = shared.value.pieces(texts_of(batch.column(0).slice(a, b - a)))
                if len(starts):
                    one, place = distinct(codes, starts, ends, hashes)
                    for s, e, n in zip(starts[one].tolist(), ends[one].tolist(), np.bincount(place).tolist(), strict=True):
                        if e - s <= LONGEST_KEPT:
                            counts[joined[s:e]] += n
        if counts:
            top = counts.most_common(most)
            pieces = [p for p, _ in top]
            packed = [np.array([n for _, n in top], np.int64).tobytes(), np.array(shared.value.lengths(pieces), np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([pieces]), *[pa.array([x], pa.binary()) for x in packed]], ["pieces", "counts", "lengths"])

    sent = chosen.select(text).mapInArrow(run, "pieces array<string>, counts binary, lengths binary").collect()
    total: Counter[str] = Counter()
    length: dict[str, int] = {}
    for row in sent:
        for piece, n, size in zip(row.pieces, np.frombuffer(row.counts, np.int64).tolist(), np.frombuffer(row.lengths, np.int32).tolist(), strict=True):
            total[piece] += n
            length[piece] = size
    top = sorted(total, key=lambda p: (-total[p], p))[:FREQUENT]
    return Frequent(top, np.array([length[p] for p in top], np.int32))


_caches: dict[str, TwoAgeCache] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row; null texts count as empty ones.

    Repeated rows give a row each; other columns are left out; an empty table gives an empty result.
    """
    with open(model_path, "rb") as file:
        model = PieceModel(file.read())
    pairs = docs.select(key, text)
    context = docs.sparkSession.sparkContext
    shared, name = context.broadcast((model, frequent_pieces(pairs, model, key, text))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent = shared.value
        if name not in _caches:
            _caches.clear()
            _caches[name] = TwoAgeCache(CACHE)
        cache = _caches[name]
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = texts_of(batch.column(1).slice(a, b - a))
                joined, codes, starts, ends, hashes, first = model.pieces(texts)
                counts = np.zeros(len(texts), np.int64)
                if len(starts):
                    one, place = distinct(codes, starts, ends, hashes)
                    lengths = frequent.find(hashes[one], codes, starts[one], ends[one])
                    left = np.flatnonzero(lengths < 0)
                    pieces = [joined[s:e] for s, e in zip(starts[one[left]].tolist(), ends[one[left]].tolist(), strict=True)]
                    found = [cache.lookup(p) for p in pieces]
                    new = [i for i, x in enumerate(found) if x is None]
                    for i, n in zip(new, model.lengths([pieces[i] for i in new]), strict=True):
                        found[i] = n
                        if len(pieces[i]) <= LONGEST_KEPT:
                            cache.add(pieces[i], n)
                    lengths[left] = found
                    upto = np.concatenate([[0], np.cumsum(lengths[place])])
                    counts = np.diff(upto[first])
                n_bytes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], schema.names)

    schema = T.StructType([like(docs, key), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return pairs.mapInArrow(run, schema)
