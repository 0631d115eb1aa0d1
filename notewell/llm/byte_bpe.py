"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a token as a whole costs one probe.
Tier two merges the bytes of any other pre-token: they form a linked list, and a heap holds the rank of each
adjacent pair, so a piece of n bytes takes O(n log n) even where a text is one long run of letters.

Both tiers run map-side within Arrow batches; nothing is shuffled.  Each worker keeps a cache of bounded size for
the short pieces it has met.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import PieceEncoder, like, texts_of
from .support import give_back_memory
from .textcodes import expand, slices

#: Cached pieces a worker; about 30 bytes each.
CACHE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class MinimalPerfectHash:
    """Hash and displace: n keys to the slots 0 .. n-1 without a gap; one displacement for each bucket of keys.

    Buckets are placed from the largest on; a bucket's displacement is the first with which all its keys fall on
    free slots.  Whether a key belongs to the set at all is told by the key kept in its slot.
    """

    PER_BUCKET = 4

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.n_buckets = self.n // self.PER_BUCKET + 1
        self.displacement = array("q", bytes(8 * self.n_buckets))
        self.keys: list[bytes | None] = [None] * self.n
        buckets: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in keys:
            bucket, low, step = self._hash(key)
            buckets.setdefault(bucket, []).append((low, step, key))
        free = None
        for bucket, members in sorted(buckets.items(), key=lambda item: (-len(item[1]), item[0])):
            if len(members) == 1:
                # The single keys come last; each takes the next free slot.
                if free is None:
                    free = iter([i for i, key in enumerate(self.keys) if key is None])
                self.displacement[bucket] = (next(free) - members[0][0]) % self.n
            else:
                self.displacement[bucket] = self._displacement(members)
            for low, step, key in members:
                self.keys[self._place(low, step, self.displacement[bucket])] = key

    def _place(self, low: int, step: int, displacement: int) -> int:
        turn, shift = divmod(displacement, self.n)
        return (low + turn * step + shift) % self.n

    def _displacement(self, members: list[tuple[int, int, bytes]]) -> int:
        """The first with which all members fall on free slots: a turn spreads them anew, then they shift together."""
        at = 0
        while True:
            slots = {self._place(low, step, at) for low, step, _ in members}
            if len(slots) == len(members) and all(self.keys[s] is None for s in slots):
                return at
            # A few shifts a turn; keys whose slots clash need another turn.
            at = at + 1 if at % self.n < 40 and len(slots) == len(members) else (at // self.n + 1) * self.n

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.n_buckets, h >> 64, (h >> 32 & 0x7FFFFFFF) % (self.n - 1 or 1) + 1

    def slot(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it isn't one of the keys."""
        bucket, low, step = self._hash(key)
        at = self._place(low, step, self.displacement[bucket])
        return at if self.keys[at] == key else -1


class Codec:
    """The vocabulary in the forms that encoding and decoding use; small, so that it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int]):
        self.dtype = "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"
        self.whole = MinimalPerfectHash(list(ranks))
        self.rank_of_slot = [ranks.get(key, -1) for key in self.whole.keys]
        self.byte_rank = [ranks.get(bytes([b]), -1) for b in range(256)]
        # after[a][b]: the token that the tokens a and b merge to, side by side.
        self.after: list[dict[int, int]] = [{} for _ in range(max(ranks.values(), default=-1) + 1)]
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if token[:cut] in ranks and token[cut:] in ranks:
                    self.after[ranks[token[:cut]]][ranks[token[cut:]]] = rank
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.lengths) - self.lengths
        width = len(str(len(tokens))) + 1
        self.decimals = np.frombuffer("".join(f"{i} ".ljust(width, "\0") for i in range(len(tokens))).encode(), np.uint8).reshape(-1, width)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token as a whole."""
        ids = [self.byte_rank[b] for b in piece]
        n, joins = len(ids), self.after
        right_of, left_of = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << 32 | i for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := joins[x].get(y)) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, left = top >> 32, top & 0xFFFFFFFF
            right = right_of[left]
            # An entry is stale if its pair has changed since.
            if right >= n or (x := ids[left]) < 0 or joins[x].get(ids[right]) != rank:
                continue
            ids[left], ids[right] = rank, -1
            right_of[left] = beyond = right_of[right]
            if beyond < n:
                left_of[beyond] = left
                if (r := joins[rank].get(ids[beyond])) is not None:
                    heapq.heappush(heap, r << 32 | left)
            if (back := left_of[left]) >= 0 and (r := joins[ids[back]].get(rank)) is not None:
                heapq.heappush(heap, r << 32 | back)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: bytes) -> list[int]:
        slot = self.whole.slot(piece)
        return [self.rank_of_slot[slot]] if slot >= 0 else self.merge(piece)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        kind = "H" if self.dtype == "<u2" else "I"
        return [array(kind, self.encode_piece(p.encode("utf-8", "surrogatepass"))).tobytes() for p in pieces]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and the offsets of the texts in them."""
        each = self.lengths[ids]
        upto = np.concatenate([[0], np.cumsum(each)])
        return self.flat[expand(self.begin[ids], each)], upto[offsets]

    def decimal_texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """For each text its ids as decimals joined by one blank."""
        rows = self.decimals[ids]
        used = rows != 0
        upto = np.concatenate([[0], np.cumsum(used.sum(1))])[offsets]
        flat = rows[used].tobytes()
        return [flat[a : max(a, b - 1)] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


_encoders: dict[str, PieceEncoder] = {}


def _encoder(name: str, codec: Codec) -> PieceEncoder:
    """This worker's encoder, with its cache, for the query ``name``."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = PieceEncoder(codec.encode_pieces, codec.dtype, CACHE)
    return _encoders[name]


def _mapped(docs: DataFrame, key: str, text: str, ranks_path: str, schema: T.StructType, columns) -> DataFrame:
    """``columns(codec, ids, offsets)`` for each slice of each batch of (key, text)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        encode = _encoder(name, codec)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, offsets = encode(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(codec, ids, offsets)], schema.names)
        give_back_memory()

    return docs.select(key, text).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the ids of each whole text; a null text has none.  One row a row, in any order."""

    def columns(codec: Codec, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _mapped(docs, key, text, ranks_path, T.StructType([like(docs, key), T.StructField("ids", T.ArrayType(T.IntegerType()))]), columns)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary) of a table of ids; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path)))
    schema = T.StructType([like(encoded, key), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            data, upto = shared.value.decode(flat, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.binary())], schema.names)

    return encoded.select(key, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, its ids decoded, both as digests.

    Null and empty texts have no tokens; repeated rows give a row each; other columns are left out, so their
    names can't clash; an empty table gives an empty result.
    """

    def columns(codec: Codec, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        data, upto = codec.decode(ids, offsets)
        raw = data.tobytes()
        return [
            pa.array(np.diff(offsets)),
            pa.array([hashlib.sha256(x).hexdigest() for x in codec.decimal_texts(ids, offsets)], pa.string()),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.string()),
        ]

    schema = T.StructType([like(docs, key), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _mapped(docs, key, text, ranks_path, schema, columns)
