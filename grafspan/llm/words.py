"""Words of UTF-8 text as 64-bit numbers, for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: As SPACE, and ASCII punctuation separates words too.
MARKS = SPACE.copy()
MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_PLACES = 64
#: One random number for each byte at each place: two words share a sum with a chance of 2**-64.
_ZOBRIST = np.random.default_rng(20_240_501).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)
_FAR = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; a null is an empty text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def hashed(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text) of all words; A-Z count as a-z. Words end where a text ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = ~gaps[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offs[:-1][offs[:-1] < len(data)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    at = np.flatnonzero(inside)
    word = np.cumsum(first[at]) - 1
    place = at - start[word]
    value = _ZOBRIST[place % _PLACES, LOWER[data[at]]]
    if place.max() >= _PLACES:
        value = value * (np.uint64(1) + _FAR * (place // _PLACES).astype(np.uint64) * np.uint64(2))
    cut = np.searchsorted(word, np.arange(len(start)))
    h = mix64(np.add.reduceat(value, cut))
    count = np.diff(np.append(cut, len(at)))
    return h, start, start + count, np.searchsorted(offs, start, side="right") - 1


class Lookup:
    """Places of 64-bit numbers in a fixed list: two tries in open tables, and a search for the few that fit in neither."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.bits = max(10, int(len(keys)).bit_length() + 4)
        self.tables, left = [], np.arange(len(keys))
        for t in range(2):
            table = np.full(1 << self.bits, len(keys), np.int32)
            slot = self._slot(keys[left], t)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        self.rest = left[np.argsort(keys[left])]

    def _slot(self, h: np.ndarray, t: int) -> np.ndarray:
        return ((h >> np.uint64(64 - self.bits)) if t == 0 else (h & np.uint64((1 << self.bits) - 1))).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each number, or -1."""
        out = np.full(len(h), -1, np.int32)
        for t, table in enumerate(self.tables):
            at = table[self._slot(h, t)]
            hit = (self.keys[at] == h) & (at < len(self.keys) - 1)
            out[hit] = at[hit]
        if len(self.rest):
            keys = self.keys[self.rest]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[hit] = self.rest[at[hit]]
        return out


_STEP = np.random.default_rng(20_240_502).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The shingles of k words of one text, in order; a shorter text is one shingle."""
    if len(h) == 0:
        return h
    if len(h) < k:
        return mix64(np.array([(h * _STEP[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j : j + n] * _STEP[j]
    return mix64(total)


def sets(texts: pa.Array, k: int, batch_bytes: int = 1 << 20):
    """Yields the sorted distinct shingles of each text."""
    lens = np.diff(buffers(texts)[1])
    i = 0
    while i < len(texts):
        j, room = i, 0
        while j < len(texts) and (j == i or room + lens[j] <= batch_bytes):
            room += lens[j]
            j += 1
        data, offs = buffers(texts.slice(i, j - i))
        h, _, _, text = hashed(data, offs)
        cut = np.searchsorted(text, np.arange(j - i + 1))
        for d in range(j - i):
            yield np.unique(shingles(h[cut[d] : cut[d + 1]], k))
        i = j
