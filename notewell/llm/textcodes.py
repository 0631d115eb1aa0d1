"""Whole batches of texts as numpy code arrays: word and pre-token boundaries, and 64-bit hashes of the pieces.

Every function takes all texts of a batch at once, so that the cost a document is a few vector steps, not a loop
over its words.  A piece's hash is the sum of a mixed value of each code with its place in the piece, then mixed with
the length: no letter's weight at one place is a multiple of that at another, as it is in a polynomial.  Where a result
must be exact, equal hashes are only a hint: ``distinct`` and the stores compare the pieces themselves.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over all others (bijective)."""
    h = (h ^ (h >> U(30))) * MIX_A
    h = (h ^ (h >> U(27))) * MIX_B
    return h ^ (h >> U(31))


def piece_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of codes[starts[i]:ends[i]] for each i, whatever its position; the pieces follow one another."""
    total = np.zeros(len(codes) + 1, U)
    lengths = (ends - starts).astype(U)
    if len(starts):
        # Places count from the start of the piece; codes between two pieces belong to none and are not summed.
        place = np.arange(len(codes), dtype=U)
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(codes)))).astype(U)
        np.cumsum(mix((place + U(1)) << U(21) | codes.astype(U)), out=total[1:])
    return mix(total[ends] - total[starts] + lengths * MIX_B)


def equal_pieces(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[a_starts[i]:][:lengths[i]] and b[b_starts[i]:][:lengths[i]] are the same codes, for each i."""
    same = np.ones(len(lengths), bool)
    differ = np.flatnonzero(a[expand(a_starts, lengths)] != b[expand(b_starts, lengths)])
    same[np.searchsorted(np.cumsum(lengths), differ, "right")] = False
    return same


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the offsets of the texts; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about ``most`` bytes each; one long text is a range of its own."""
    _, offsets = utf8_column(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in UTF-8 bytes, and how many words each text has."""
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    # The code points with the property White_Space.
    table[[*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def pretokens(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens that the published split pattern of byte-level BPE vocabularies finds.

    The pattern takes contractions, then an optional blank with a run of letters, of numbers or of others, then
    white space up to the last one before a word.  As boundaries: a run of one class begins a piece; the last
    white space before something else begins one; a blank there also takes the run that follows.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last_space = space & np.concatenate([~space[1:] & ~first[1:n], [False]])
    after_blank = np.zeros(n, bool)
    after_blank[1:] = last_space[:-1] & (codes[:-1] == 0x20)
    start = (change & ~after_blank) | last_space
    quotes = np.flatnonzero((codes == 0x27) & start)
    if len(quotes):
        ends_of_text = offsets[np.searchsorted(offsets, quotes, "right")]
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        one = np.where(quotes + 1 < ends_of_text, one, 0)
        two = np.where(quotes + 2 < ends_of_text, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        start[quotes[hit] + 1] = False
        end = quotes[hit] + np.where(short[hit], 2, 3)
        start[end[end < ends_of_text[hit]]] = True
    return np.flatnonzero(start)


def distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of one piece of each kind, and each piece's place among these; pieces with equal hashes are compared."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(new) - 1
    one, lengths = order[new], ends - starts
    same = lengths == lengths[one[place]]
    at = np.flatnonzero(same)
    same[at] = equal_pieces(codes, starts[at], codes, starts[one[place[at]]], lengths[at])
    if not same.all():
        # Pieces that share a hash and no more: each kind of them gets a place of its own.
        more: dict[bytes, int] = {}
        odd = np.flatnonzero(~same)
        first = []
        for i in odd.tolist():
            name = codes[starts[i] : ends[i]].tobytes()
            if name not in more:
                more[name] = len(one) + len(more)
                first.append(i)
            place[i] = more[name]
        one = np.concatenate([one, np.array(first, one.dtype)])
    return one, place


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class TwoAgeCache(dict):
    """A cache of bounded size: when the young half is full it becomes the old half, and the old one goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def lookup(self, key):
        value = self.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.add(key, value)
        return value

    def add(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
