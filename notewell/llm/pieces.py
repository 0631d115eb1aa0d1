"""Tokenizing a batch of texts piece by piece: each distinct piece of a batch is looked up once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textcodes import code_points, distinct, equal_pieces, expand, piece_hashes, pretokens

#: Pieces longer than this are encoded whenever they come, so that no cache holds long texts.
LONGEST_KEPT = 64


class _Store:
    """Ids of pieces, found by the pieces' hashes and then compared: sorted arrays, a buffer of ids, one of the pieces."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
        begin, at, order = np.cumsum(counts) - counts, np.cumsum(lengths) - lengths, np.argsort(hashes)
        self.hashes, self.counts, self.begin, self.flat = hashes[order], counts[order], begin[order], flat
        self.lengths, self.at, self.codes = lengths[order], at[order], codes
        self.used = np.zeros(len(order), bool)

    def find(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces, and which of them are there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = (self.hashes[at] == hashes) & (self.lengths[at] == lengths)
        near = np.flatnonzero(hit)
        hit[near] = equal_pieces(codes, starts[near], self.codes, self.at[at[near]], lengths[near])
        self.used[at[hit]] = True
        return at, hit

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of some places, one after the other."""
        counts = self.counts[at]
        return counts, self.flat[expand(self.begin[at], counts)]

    def pieces(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and codes of the pieces at some places."""
        lengths = self.lengths[at]
        return lengths, self.codes[expand(self.at[at], lengths)]

    def with_rows(self, hashes: np.ndarray, rows: tuple[np.ndarray, np.ndarray], pieces: tuple[np.ndarray, np.ndarray], keep: np.ndarray | None = None) -> _Store:
        at = np.arange(len(self.hashes)) if keep is None else np.flatnonzero(keep)
        both = [np.concatenate(x) for x in zip((*self.rows(at), *self.pieces(at)), (*rows, *pieces), strict=True)]
        return _Store(np.concatenate([self.hashes[at], hashes]), *both)


class PieceEncoder:
    """Token ids of whole batches from a function that encodes a list of distinct pieces.

    ``encode_pieces`` gets pieces and returns for each its ids as packed little-endian integers of ``dtype``.  What it
    returned is kept for up to about ``cache_size`` pieces, in arrays that a whole batch is looked up in at once: new
    pieces in a young store, older ones in an old store, from which those not asked for lately go first.  ``split`` gives
    the starts of the pieces of texts, which no token may cross.
    """

    YOUNG = 1 << 15

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], dtype: str, cache_size: int, split: Callable[[np.ndarray, np.ndarray], np.ndarray] = pretokens):
        self.encode_pieces, self.dtype, self.most, self.split = encode_pieces, np.dtype(dtype), cache_size, split
        self.young, self.old = self._empty(), self._empty()

    def _empty(self) -> _Store:
        return _Store(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, hashes: np.ndarray, rows: tuple[np.ndarray, np.ndarray], pieces: tuple[np.ndarray, np.ndarray]) -> None:
        self.young = self.young.with_rows(hashes, rows, pieces)
        if len(self.young.hashes) > self.YOUNG:
            full = len(self.old.hashes) + len(self.young.hashes) > self.most
            every = np.arange(len(self.young.hashes))
            self.old = self.old.with_rows(self.young.hashes, self.young.rows(every), self.young.pieces(every), self.old.used if full else None)
            if len(self.old.hashes) > self.most:
                # All of them were asked for: the store begins anew.
                self.old = self._empty()
            self.young = self._empty()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the offsets of the texts."""
        codes, offsets = code_points(texts)
        starts = self.split(codes, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(codes))
        hashes = piece_hashes(codes, starts, ends)
        one, place = distinct(codes, starts, ends, hashes)
        asked, lengths = hashes[one], ends[one] - starts[one]
        at_old, in_old = self.old.find(asked, codes, starts[one], lengths)
        at_young, in_young = self.young.find(asked, codes, starts[one], lengths)
        new = np.flatnonzero(~in_old & ~in_young)
        joined = "".join(texts)
        found = self.encode_pieces([joined[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)]) if len(new) else []
        counts_new = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat_new = np.frombuffer(b"".join(found), self.dtype)
        # The distinct pieces' ids: those from the old store, those from the young one, the new ones.
        rows = [np.flatnonzero(in_old), np.flatnonzero(in_young & ~in_old), new]
        parts = [self.old.rows(at_old[rows[0]]), self.young.rows(at_young[rows[1]]), (counts_new, flat_new)]
        counts, flat = np.concatenate([c for c, _ in parts]), np.concatenate([f for _, f in parts])
        where = np.empty(len(one), np.int64)
        where[np.concatenate(rows)] = np.arange(len(one))
        begin = np.cumsum(counts) - counts
        each = where[place]
        ids = flat[expand(begin[each], counts[each])]
        upto = np.concatenate([[0], np.cumsum(counts[each])])
        short = lengths[new] <= LONGEST_KEPT
        if short.any():
            kept = new[short]
            self._keep(asked[kept], (counts_new[short], flat_new[np.repeat(short, counts_new)]), (lengths[kept], codes[expand(starts[one[kept]], lengths[kept])]))
        return ids, upto[np.searchsorted(starts, offsets)]


def texts_of(column: pa.Array) -> list[str]:
    return (column.fill_null("") if column.null_count else column).to_pylist()


def like(docs: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The field of ``column`` for the schema of a result."""
    return T.StructField(name or column, docs.schema[column].dataType)
