"""Language-model scores by online logistic context mixing over bits.

A text is its words with A-Z in lower case and then one empty word, its end. The ``CODED`` most frequent words have a
Huffman code, so that a word is a few binary choices, each at a node of the code's tree; one code stands for all
other words, which are then spelled in bytes, by a Huffman code of bytes, up to a closing space.

1. Every training word is counted; the counts give the codes and the unigram base score.
2. Hashed-context predictors count zeros and ones of each choice over all training texts. Of a word's choices: ``ORDERS``
   contexts, the word before and the two words before (without context, the counts of words give them exactly). Of a byte's: two and
   three bytes back, and the whole word so far. There are as many slots a context as there are training words, up to 2**``SLOT_BITS``; partial tables are summed by range of slots.
3. One more predictor counts the choices of the text itself so far.
4. A mixer adds the predictors' log-odds with weights that a gate selects: how often the contexts were seen. Starting weights are
   those of the greatest likelihood of all choices of all training texts (of bytes: of all different training words), each choice's own
   occurrence left out: choices are counted by their inputs, whose log-odds are rounded beyond three occurrences, and the driver sees
   these counts only. While a text is read, its own copy of the weights is refined by the errors made, after every ``BLOCK`` words, and after every ``LATER`` ones beyond the
   first ``EARLY``; its own counts grow with every word. The score is the log10 probability of the whole text; bits_per_byte is that in bits by its bytes.

All sums over texts are of integers, so scores don't depend on partitions or cores.
Words among the ``HOT`` most frequent are looked up in a table of that bounded size. Any other is
rare, so that its count comes by a join without hot keys.

Defined cases: a null text is empty and scores its end alone; a null doc_id is held out; repeated
rows are scored each for itself; very long texts are scored whole, and their own counts and weights start again after every
``SEGMENT`` words; words of equal counts are ordered by their bytes; without training documents
all counts are 0; an empty table gives an empty result. Only doc_id and text are read, so extra columns don't matter.
"""

from __future__ import annotations

import heapq
import os
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Stage
from .words import mix64

ORDERS, BYTES, SLOT_BITS = 2, 3, 20
HOT, CODED = 1 << 18, 1 << 16
BLOCK, EARLY, LATER, SEGMENT = 16, 256, 256, 1 << 16
RATE = 0.02
PLACES, GATES = 4, 4 * (BYTES + 1)
_CHUNKS = 64
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PREFIX = np.random.default_rng(20_240_505).integers(0, 2**64, (64, 256), dtype=np.uint64)
_SALT = np.random.default_rng(20_240_506).integers(0, 2**64, 8, dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    room = 0
    for b in batches:
        for t in b.column("text").cast(pa.binary()):
            text = t.as_py() or b""
            seen.update(text.lower().split())
            seen[b""] += 1
            room += len(text)
            if room > 64 << 20 or len(seen) > 400_000:  # what is held is part of the bytes read
                yield out()
                seen.clear()
                room = 0
    yield out()


class Code:
    """A Huffman code: for each symbol the nodes on its path from the root and the branches taken."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
        heap = [(int(w) + 1, s) for s, w in enumerate(weights)]
        heapq.heapify(heap)
        node = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], parent[j], side[j] = node, node, 1
            heapq.heappush(heap, (a + b, node))
            node += 1
        # All symbols climb together, a step at a time.
        at, steps = np.arange(n), []
        while (moving := at < node - 1).any():
            steps.append((np.where(moving, parent[at] - n, -1), side[at]))
            at = np.where(moving, parent[at], at)
        self.length = sum((s[0] >= 0).astype(np.int64) for s in steps) if steps else np.zeros(n, np.int64)
        self.first = np.append(0, np.cumsum(self.length)[:-1])
        self.node, self.bit = np.zeros(int(self.length.sum()), np.int64), np.zeros(int(self.length.sum()), np.int8)
        for k, (on, bit) in enumerate(steps):
            s = np.flatnonzero(on >= 0)
            place = self.first[s] + self.length[s] - 1 - k
            self.node[place], self.bit[place] = on[s], bit[s]
        self.nodes = max(1, n - 1)
        self.name = self.node.astype(np.uint64) * _GOLD * _ODD
        #: Of each symbol its bits, the first one lowest, and a one above them; of each node the nodes that zero and one lead to.
        self.word, self.root = np.ones(n, np.int64), self.nodes - 1
        for k, (on, bit) in enumerate(steps):
            self.word = np.where(on >= 0, self.word << 1 | bit, self.word)
        self.child = np.zeros(2 * self.nodes, np.int64)
        inner = np.arange(n, 2 * n - 2)
        self.child[2 * (parent[inner] - n) + side[inner]] = inner - n

    def choices(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first choice of each symbol, how many it has, places of all choices in the code)."""
        size = self.length[symbols]
        start = np.append(0, np.cumsum(size)[:-1])
        entry = np.repeat(self.first[symbols] - start, size)
        entry += np.arange(len(entry))
        return start, size, entry

    def slots(self, contexts: list[np.ndarray], size: np.ndarray, entry: np.ndarray, bits: int) -> list[np.ndarray]:
        """Each choice's slot in the table of each context."""
        name, out = self.name[entry], []
        for k, c in enumerate(contexts):
            s = np.repeat(c * _ODD, size)
            s += name
            s >>= np.uint64(64 - bits)
            s += np.uint64(k << bits)
            out.append(s.view(np.int64))
        return out


# --- words spelled in bytes ---


def spelled(batch: list[bytes], code: Code, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(first bit of each word, slots of each bit for each context, branches, place of the byte) of all words."""
    c = np.frombuffer(b" ".join(batch) + b" ", np.uint8)
    sizes = np.array([len(w) + 1 for w in batch])
    begin = np.append(0, np.cumsum(sizes)[:-1])
    word = np.repeat(np.arange(len(batch)), sizes)
    place = np.arange(len(c)) - begin[word]
    back = []
    for k in (1, 2, 3):
        b = np.zeros(len(c), np.uint64)
        b[k:] = c[:-k]
        b[place < k] = 256  # before the word
        back.append(b)
    own = _PREFIX[np.minimum(place, 63), c]
    run = np.cumsum(own) - own
    prefix = run - run[begin[word]]
    contexts = [back[0] | back[1] << np.uint64(9), back[0] | back[1] << np.uint64(9) | back[2] << np.uint64(18), prefix]
    contexts = [mix64(x ^ s) for x, s in zip(contexts, _SALT[:BYTES], strict=True)]
    start, size, entry = code.choices(c)
    return start[begin], code.slots(contexts, size, entry, bits), code.bit[entry], np.repeat(np.minimum(place, PLACES - 1), size)


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 4000) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.column("word").slice(i, size).to_pylist(), b.column("c").slice(i, size).to_numpy()


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(256)
    for some, c in _pieces(batches):
        n += np.bincount(np.frombuffer(b" ".join(some) + b" ", np.uint8), np.repeat(c, [len(w) + 1 for w in some]), 256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n.astype(np.int64))], ["byte", "n"])


def _chunks(n: np.ndarray, kind: type = np.int32) -> Iterator[pa.RecordBatch]:
    """A table's ranges that are not empty."""
    for i, part in enumerate(np.array_split(n, _CHUNKS)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.astype(kind).tobytes()], pa.binary())], ["chunk", "n"])


def _spelled_tables(code: Code, bits: int):
    """Counted words to ranges of the table: zeros before ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = np.zeros(2 * BYTES << bits, np.int64), BYTES << bits
        for some, c in _pieces(batches):
            first, slots, bit, _ = spelled(some, code, bits)
            weight = np.repeat(c, np.diff(np.append(first, len(bit))))
            for s in slots:
                np.add.at(n, s + bit.astype(np.int64) * size, weight)
        yield from _chunks(np.minimum(n, 2**31 - 1))

    return run


def _added(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column("chunk").to_pylist(), b.column("n"), strict=True):
                part = np.frombuffer(n.as_buffer(), kind).astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.minimum(n, np.iinfo(kind).max).astype(kind).tobytes()], pa.binary())], ["chunk", "n"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """The same rows in few tasks, as each one leaves a table; two for each core."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _table(parts: DataFrame, size: int, kind: type = np.int32) -> np.ndarray:
    """The sum of partial tables: ``size`` numbers, which is bounded."""
    out = np.zeros(size, kind)
    ranges = np.array_split(out, _CHUNKS)  # views
    for r in parts.repartition(_CHUNKS // 4, "chunk").mapInArrow(_added(kind), "chunk long, n binary").toLocalIterator():
        ranges[r["chunk"]][:] = np.frombuffer(r["n"], kind)
    return out


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -8, 8)


def log1p(x: np.ndarray) -> np.ndarray:
    """log(1 + x) of single-precision numbers, without losing small ones to rounding; faster than numpy's."""
    u = 1 + x
    out = np.log(u)
    u -= 1
    np.maximum(u, np.float32(1e-30), out=u)
    out *= x / u
    return out


# Starting weights. A choice is seen from the branch taken: ahead and against are how often its context went there and elsewhere.
# States: each pair of counts up to ``FEW`` together is one, beyond that log-odds in ``RUNGS`` steps, finer near zero.
FEW, RUNGS, PLAIN = 3, 33, 17
STATES = (FEW + 1) * (FEW + 2) // 2 + RUNGS


def rungs(n: int, bend: float) -> np.ndarray:
    """n log-odds from -8 to 8."""
    return 8 * np.sinh(bend * np.linspace(-1, 1, n)) / np.sinh(bend)


def rung(x: np.ndarray, n: int, bend: float) -> np.ndarray:
    """The place of log-odds among ``rungs``."""
    return n // 2 + np.rint(np.arcsinh(x / 8 * np.sinh(bend)) / bend * (n // 2)).astype(np.int64)


BEND, PLAIN_BEND = 3.2, 4.4


def state(ahead: np.ndarray, against: np.ndarray) -> np.ndarray:
    n = ahead + against
    return np.where(n <= FEW, n * (n + 1) // 2 + against, STATES - RUNGS + rung(odds(against, ahead), RUNGS, BEND)).astype(np.uint8)


def others(zeros: np.ndarray, ones: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ahead, against) of a choice of zero, and of one, without itself."""
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    return [(np.maximum(zeros - 1, 0), ones), (np.maximum(ones - 1, 0), zeros)]


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The state of each slot for a choice of zero, then for one."""
    return np.concatenate([state(*c) for c in others(zeros, ones)])


_PAIRS = [(n - b, b) for n in range(FEW + 1) for b in range(n + 1)]
STATE_ODDS = np.append([odds(np.float64(b), np.float64(a)) for a, b in _PAIRS], rungs(RUNGS, BEND))
STATE_SEEN = np.append([a + b for a, b in _PAIRS], np.full(RUNGS, FEW + 1))
#: Counts of a text itself: exact up to 63, then eight steps for each doubling.
_STEP = np.arange(SEGMENT + 1)
_STEP[64:] = 64 + np.floor(8 * np.log2(_STEP[64:] / 64)).astype(np.int64)
_STEPS = int(_STEP[-1]) + 1
_STEP_ONES = _STEP * _STEPS
_LEAST = np.searchsorted(_STEP, np.arange(_STEPS))
#: States of a choice of zero, then of one, by steps of ones and of zeros.
_OWN = np.concatenate([state(_LEAST[None, :], _LEAST[:, None]).reshape(-1), state(_LEAST[:, None], _LEAST[None, :]).reshape(-1)])


def best_weights(n: np.ndarray, x: np.ndarray, gate: np.ndarray, gates: int) -> np.ndarray:
    """Weights (gates x inputs) of the greatest likelihood of n choices with inputs x towards the branch taken, by Newton's steps; 0.3 without any."""
    k = x.shape[1]
    w = np.full((gates, k), 0.3)

    def loss(w: np.ndarray) -> np.ndarray:
        return np.bincount(gate, n * np.logaddexp(0, -np.einsum("ij,ij->i", x, w[gate])), gates) + ((w - 0.3) ** 2).sum(axis=1) / 2

    now = loss(w)
    for _ in range(40):
        q = 1 / (1 + np.exp(np.einsum("ij,ij->i", x, w[gate])))
        slope = np.stack([np.bincount(gate, n * q * x[:, i], gates) for i in range(k)], axis=1) - (w - 0.3)
        bend = np.empty((gates, k, k))
        for i in range(k):
            for j in range(i + 1):
                bend[:, i, j] = bend[:, j, i] = np.bincount(gate, n * q * (1 - q) * x[:, i] * x[:, j], gates) + (i == j)
        step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        for _ in range(30):
            then = loss(w + step)
            worse = then > now
            if not worse.any():
                break
            step[worse] /= 2
        step[then > now] = 0
        w, now = w + step, np.minimum(then, now)
        if np.abs(step).max() < 1e-7:
            break
    return w


SPELLED_CELLS = PLACES * 2 * STATES**BYTES


def _spelled_cells(code: Code, bits: int, known: np.ndarray):
    """Different words to how many of their choices have each place, branch and states, each word's own occurrence left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SPELLED_CELLS, np.int64)
        for some, _ in _pieces(batches, 10_000):
            _, slots, bit, place = spelled(some, code, bits)
            side = bit.astype(np.int64) * (BYTES << bits)
            cell = place * 2 + bit
            for s in slots:
                cell *= STATES
                cell += known[s + side]
            np.add.at(n, cell, 1)
        yield from _chunks(n, np.int64)

    return run


def spelled_weights(n: np.ndarray) -> np.ndarray:
    cell = np.flatnonzero(n)
    of, place = [cell // STATES**k % STATES for k in reversed(range(BYTES))], cell // STATES**BYTES
    x = np.stack([*(STATE_ODDS[s] for s in of), np.where(place % 2, 0.3, -0.3)], axis=1)
    return best_weights(n[cell], x, place // 2 * (BYTES + 1) + sum((s > 0).astype(np.int64) for s in of), GATES)


class Speller:
    """What the byte model needs to score a word."""

    def __init__(self, code: Code, bits: int, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray):
        self.code, self.bits, self.weights = code, bits, weights.astype(np.float32)
        self.odds, self.known = np.rint(odds(zeros, ones) * 15).astype(np.int8), ((zeros.astype(np.int64) + ones) > 0).astype(np.int8)

    def score(self, some: list[bytes]) -> np.ndarray:
        """Natural log probability of each word."""
        out = np.empty(len(some))
        for i in range(0, len(some), 4000):
            part = some[i : i + 4000]
            first, slots, bit, place = spelled(part, self.code, self.bits)
            gate = place * (BYTES + 1) + sum(self.known[s] for s in slots)
            z = (0.3 * self.weights[:, BYTES])[gate]
            for k, s in enumerate(slots):
                z += (self.weights[:, k] / 15)[gate] * self.odds[s].astype(np.float32)
            z *= 1 - 2 * bit.astype(np.float32)
            out[i : i + len(part)] = -np.add.reduceat(log1p(np.exp(np.clip(z, -30, 30))), first, dtype=np.float64)
        return out


# --- words in context ---

INPUTS = ORDERS + 2
LEVELS = 3
WORD_GATES = LEVELS**3


#: A text's own counts end with its segment.
_LOG = np.log(np.arange(SEGMENT + 1) + 0.4).astype(np.float32)


def level(n: np.ndarray) -> np.ndarray:
    """Never seen, a few times, more often."""
    return (n > 0).astype(np.int8) + (n > FEW)


def word_contexts(before: np.ndarray, before2: np.ndarray) -> list[np.ndarray]:
    """Numbers of each word's contexts."""
    one = mix64(before.astype(np.uint64) ^ _SALT[4])
    return [one, mix64(one + before2.astype(np.uint64) * _ODD)]


def word_slots(contexts: list[np.ndarray], word: np.ndarray, node: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """As ``Code.slots``, of choices of some words at some nodes; contexts are multiplied by ``_ODD`` before."""
    name = node.view(np.uint64) * _GOLD
    name *= _ODD
    for k, c in enumerate(contexts):
        s = c[word]
        s += name
        s >>= np.uint64(64 - bits)
        out = s.view(np.int64)
        if k:
            out += k << bits
        yield out


def node_counts(code: Code, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of each node, of as many words as there are of each symbol."""
    weight = np.repeat(many.astype(float), code.length)
    both = np.bincount(code.node * 2 + code.bit, weight, 2 * code.nodes).astype(np.int64)
    return both[::2], both[1::2]


def descend(code: Code, symbols: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All choices, by their depth in the tree: (words, nodes, bits, zeros and ones that the node had before in the word's text).

    ``begin`` is the place of the first word of each word's text. Words that meet at a node stand side by side, in the order of the text;
    from one depth to the next all that took zero move before all that took one. So nothing is sorted."""
    word = np.arange(len(symbols) if len(code.node) else 0)  # a code of one symbol has no choices
    rest, first, node = code.word[symbols[word]], begin[word], np.full(len(word), code.root)
    while len(word):
        bit = rest & 1
        ones = np.cumsum(bit)
        ones -= bit
        n1 = ones - ones[first]
        n0 = np.arange(len(word))
        n0 -= first
        n0 -= n1
        more, one = rest > 3, bit > 0  # the others have no bits left
        zeros = np.flatnonzero(more > one)
        at = np.concatenate((zeros, np.flatnonzero(more & one)))
        low = len(zeros)
        # A word has as many others of its next node before it as took its branch before.
        start, own, down, rest = np.arange(len(at)), n0[at], node[at], rest[at]
        own[low:] = n1[at[low:]]
        start -= own
        down <<= 1
        down[low:] += 1
        rest >>= 1
        yield word, node, bit, n0, n1
        word, first, node = word[at], start, code.child[down]


def turn_of(place):  # noqa: ANN001, ANN201
    """The turn at which the word at a place of its text is read."""
    return np.where(place < EARLY, place // BLOCK, EARLY // BLOCK + (place - EARLY) // LATER)


def rate_at(turn: int, rate: float) -> float:
    """A long block's errors are summed at a lower rate."""
    return rate if turn < EARLY // BLOCK else rate * 4 * BLOCK / LATER


#: Log-odds that slots of a table have.
SLOT_ODDS = (np.append([np.rint(odds(np.float64(n - b), np.float64(b)) * 15) for n in range(FEW + 1) for b in range(n + 1)], np.arange(-120, 122)) * np.float32(1 / 15)).astype(np.float32)


#: What is known of a choice: states of its slots in two contexts, log-odds without context and in the text itself; text, gate and bit in one number.
CHOICE = np.dtype([("one", np.int16), ("two", np.int16), ("plain", np.float32), ("own", np.float32), ("key", np.int32)])
GROUP = 40_000


class Reader:
    """What the word model needs: code, tables of odds and levels, and starting weights. Its size is bounded."""

    def __init__(self, code: Code, bits: int, many: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray, rate: float = RATE):
        self.code, self.bits, self.weights, self.rate = code, bits, weights, rate
        self.plain = odds(*node_counts(code, many)).astype(np.float32)
        #: Of each slot one of 252 numbers, which name its log-odds in fifteenths and its level: small counts each have their own.
        seen = zeros.astype(np.int64) + ones
        self.table = np.where(seen <= FEW, seen * (seen + 1) // 2 + ones, len(_PAIRS) + 120 + np.rint(odds(zeros, ones) * 15)).astype(np.uint8)

    def inputs(self, symbols: np.ndarray, before: np.ndarray, before2: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``CHOICE`` of all choices of some words; ``place`` is that of each word's first one."""
        out = np.empty(int(self.code.length[symbols].sum()), CHOICE)
        whole = out.view(np.complex128)  # a row at once
        low = 0
        while low < len(starts) - 1:  # a few texts at a time, which stay in a processor's cache
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + GROUP, side="right")) - 1)
            i, j = starts[low], starts[high]
            sizes = np.diff(starts[low : high + 1])
            contexts = [c * _ODD for c in word_contexts(before[i:j], before2[i:j])]
            text = np.repeat(np.arange(low, high) * WORD_GATES, sizes)
            for depth, (word, node, bit, n0, n1) in enumerate(descend(self.code, symbols[i:j], np.repeat(starts[low:high] - i, sizes))):
                some, gate = np.empty(len(word), CHOICE), np.zeros(len(word), np.int8)
                for name, s in zip(("one", "two"), word_slots(contexts, word, node, self.bits), strict=True):
                    some[name] = seen = self.table[s]
                    gate *= LEVELS
                    gate += seen > 0
                    gate += seen >= len(_PAIRS)
                some["plain"] = self.plain[node]
                own = _LOG[n1]
                own -= _LOG[n0]
                np.clip(own, -8, 8, out=some["own"])
                n0 += n1
                gate *= LEVELS
                gate += level(n0)
                of = text[word]
                of += gate
                of <<= 1
                of += bit
                some["key"] = of
                at = place[i:j][word]
                at += depth
                whole[at] = some.view(np.complex128)
            low = high
        return out

    def score(self, symbols: np.ndarray, before: np.ndarray, before2: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log probability of each text's choices. All texts advance together, a block at a time; longer ones stand first."""
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        by_size = np.argsort(np.repeat(rank, sizes), kind="stable")
        symbols, before, before2, sizes = symbols[by_size], before[by_size], before2[by_size], sizes[order]
        starts = np.append(0, np.cumsum(sizes))
        turn = turn_of(np.arange(len(symbols)) - np.repeat(starts[:-1], sizes))
        by_turn = np.argsort(turn, kind="stable")
        choices = np.append(0, np.cumsum(self.code.length[symbols[by_turn]]))
        place = np.empty(len(symbols), np.int64)
        place[by_turn] = choices[:-1]
        all_choices = self.inputs(symbols, before, before2, starts, place)
        cut = choices[np.searchsorted(turn[by_turn], np.arange(int(turn.max()) + 2))] if len(turn) else [0]
        w = [np.tile(self.weights[:, k].astype(np.float32), len(sizes)) for k in range(INPUTS)]  # of each input, texts x gates
        away, of = np.empty(len(all_choices), np.float32), np.empty(len(all_choices), np.int64)
        for t, (low, high) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if low == high:
                continue
            some, key = all_choices[low:high], of[low:high]
            key[:] = some["key"]
            sign = (key & 1).astype(np.float32)
            sign *= 2
            sign -= 1
            key >>= 1
            x = [SLOT_ODDS[some["one"]], SLOT_ODDS[some["two"]], some["plain"].copy(), some["own"].copy()]
            z = w[0][key]
            z *= x[0]
            for k in range(1, INPUTS):
                a = w[k][key]
                a *= x[k]
                z += a
            z *= -sign
            np.clip(z, -30, 30, out=z)
            part = np.exp(z, out=away[low:high])
            error = part / (1 + part)  # 1 - p of the branch taken
            error *= sign
            error *= np.float32(rate_at(t, self.rate))
            n = int(key.max()) + 1
            for k in range(INPUTS):
                x[k] *= error
                w[k][:n] += np.bincount(key, x[k], n)
        of //= WORD_GATES
        return -np.bincount(of, log1p(away), len(sizes))[rank]


class _Ids(dict):
    """Numbers of words: those of the hot table, then new ones as they come."""

    def __init__(self, hot: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(hot))
        self.hot, self.new = len(hot), []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = self.hot + len(self.new)
        self.new.append(word)
        return i

    def forget(self) -> None:
        for w in self.new:
            del self[w]
        self.new = []


def _numbered(hot: list[bytes]):
    """Texts to the numbers of their words in the hot table, and those words that aren't in it, so that later passes don't cut texts into words again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, room = {w: i for i, w in enumerate(hot)}, [], 0

        def rows() -> pa.RecordBatch:
            kinds = pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "numbers", "rare"])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                text = t.as_py() or b""
                tokens = text.lower().split()
                tokens.append(b"")
                numbers = np.fromiter(map(ids.get, tokens, repeat(len(hot))), np.int32, len(tokens))
                out.append((d, len(text), numbers.tobytes(), [tokens[i] for i in np.flatnonzero(numbers == len(hot))]))
                room += len(tokens)
                if room > 1 << 20:
                    yield rows()
                    out, room = [], 0
        if out:
            yield rows()

    return run


def texts_of(batches: Iterator[pa.RecordBatch], ids: _Ids | dict, room: int = 80_000) -> Iterator[list[tuple]]:
    """Lists of (doc_id, word numbers, how many of them stand before, bytes of the text), texts in segments, with some ``room`` of words each.

    Batches hold texts, or word numbers as ``_numbered`` makes them, with the same hot table."""
    # A plain dict gives all other words one number; else they get numbers until the list is done.
    other = isinstance(ids, _Ids)
    find = (lambda part: map(ids.__getitem__, part)) if other else (lambda part: map(ids.get, part, repeat(len(ids))))

    def texts(b: pa.RecordBatch) -> Iterator[tuple]:
        """(doc_id, bytes, number of words, its numbers from one place to another)."""
        names = b.column("doc_id").to_pylist() if "doc_id" in b.schema.names else repeat(None, b.num_rows)
        if "text" in b.schema.names:
            for d, t in zip(names, b.column("text").cast(pa.binary()), strict=True):
                tokens = (t.as_py() or b"").lower().split()
                tokens.append(b"")
                yield d, len(t.as_py() or b""), len(tokens), lambda i, j: np.fromiter(find(tokens[i:j]), np.int64, min(j, len(tokens)) - i)  # noqa: B023
            return
        sizes, lists = (b.column("n_bytes").to_pylist(), b.column("rare")) if other else (repeat(0, b.num_rows), repeat(None, b.num_rows))
        for d, size, x, some in zip(names, sizes, b.column("numbers"), lists, strict=True):
            numbers = np.frombuffer(x.as_buffer(), np.int32)
            if not other or not len(some):
                yield d, size, len(numbers), lambda i, j: numbers[i:j].astype(np.int64)  # noqa: B023
                continue
            rare, at = some.as_py(), np.flatnonzero(numbers == ids.hot)

            def part(i: int, j: int) -> np.ndarray:
                out = numbers[i:j].astype(np.int64)  # noqa: B023
                low, high = np.searchsorted(at, (i, j))  # noqa: B023
                out[at[low:high] - i] = [ids[w] for w in rare[low:high]]  # noqa: B023
                return out

            yield d, size, len(numbers), part

    held, n = [], 0
    for b in batches:
        for d, size, many, part in texts(b):
            for i in range(0, many, SEGMENT):
                some = part(max(0, i - 2), i + SEGMENT)  # with the two words before
                held.append((d, some, min(i, 2), 0 if i else size))
                n += len(some)
                if n > room:
                    yield held
                    held, n = [], 0
                    if other:
                        ids.forget()
    if held:
        yield held
        if other:
            ids.forget()


def sequence(held: list[tuple], coded: int) -> tuple[np.ndarray, ...]:
    """(word numbers, symbols, numbers of the words before and two before, starts) of some texts."""
    none = coded + 1  # before a text; coded: any word without a code
    own = [np.concatenate(([none] * (2 - lead), np.minimum(x, coded))) for _, x, lead, _ in held]
    numbers = np.concatenate([x[lead:] for _, x, lead, _ in held])
    starts = np.append(0, np.cumsum([len(x) - 2 for x in own]))
    before = np.concatenate([x[1:-1] for x in own]).astype(np.int64)
    before2 = np.concatenate([x[:-2] for x in own]).astype(np.int64)
    return numbers, np.minimum(numbers, coded), before, before2, starts


def _word_tables(code: Code, bits: int, hot: list[bytes], coded: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, side = np.zeros(2 * ORDERS << bits, np.int64), code.bit.astype(np.int64) * (ORDERS << bits)
        now, room = np.zeros(len(n), np.int32), 2**31 - 1  # smaller numbers are counted faster
        for held in texts_of(batches, {w: i for i, w in enumerate(hot)}, 150_000):
            _, symbols, before, before2, _ = sequence(held, coded)
            _, size, entry = code.choices(symbols)
            up = side[entry]
            room -= len(entry)
            if room < 0:
                n += now
                now[:], room = 0, 2**31 - 1 - len(entry)
            for s in code.slots(word_contexts(before, before2), size, entry, bits):
                s += up
                np.add.at(now, s, np.int32(1))
        yield from _chunks(np.minimum(n + now, 2**31 - 1))

    return run


WORD_CELLS = STATES ** (ORDERS + 1) * PLAIN


def plain_states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """As ``states``, of log-odds without context."""
    return np.concatenate([rung(odds(b, a), PLAIN, PLAIN_BEND).astype(np.uint8) for a, b in others(zeros, ones)])


def _word_cells(code: Code, bits: int, seen: np.ndarray, plain: np.ndarray, hot: list[bytes], coded: int):
    """Training texts to how many of their choices have each combination of states, each choice's own occurrence left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(WORD_CELLS, np.int64)
        for held in texts_of(batches, {w: i for i, w in enumerate(hot)}):
            _, symbols, before, before2, starts = sequence(held, coded)
            contexts = [c * _ODD for c in word_contexts(before, before2)]
            for word, node, bit, n0, n1 in descend(code, symbols, np.repeat(starts[:-1], np.diff(starts))):
                up = bit * (ORDERS << bits)
                cell = np.zeros(len(word), np.int64)
                for s in word_slots(contexts, word, node, bits):
                    s += up
                    cell *= STATES
                    cell += seen[s]
                own = bit * _STEPS**2
                own += _STEP[n0]
                own += _STEP_ONES[n1]
                cell *= STATES
                cell += _OWN[own]
                cell *= PLAIN
                bit *= code.nodes
                bit += node
                cell += plain[bit]
                np.add.at(n, cell, 1)
        yield from _chunks(n, np.int64)

    return run


def word_weights(n: np.ndarray) -> np.ndarray:
    cell = np.flatnonzero(n)
    of, gate = [cell // PLAIN // STATES**k % STATES for k in reversed(range(ORDERS + 1))], 0
    for s in of:
        gate = gate * LEVELS + level(STATE_SEEN[s]).astype(np.int64)
    x = np.stack([*(STATE_ODDS[s] for s in of[:ORDERS]), rungs(PLAIN, PLAIN_BEND)[cell % PLAIN], STATE_ODDS[of[ORDERS]]], axis=1)
    return best_weights(n[cell], x, gate, WORD_GATES)


def _scorer(reader: Reader, speller: Speller, hot: list[bytes], hot_spelled: np.ndarray, hot_base: np.ndarray, coded: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(hot)
        for held in texts_of(batches, ids):
            numbers, symbols, before, before2, starts = sequence(held, coded)
            score = reader.score(symbols, before, before2, starts)
            new = speller.score(ids.new) if ids.new else np.zeros(0)
            spelling = np.concatenate((np.zeros(coded), hot_spelled, new))[numbers]
            known = numbers < len(hot)
            base = np.where(known, hot_base[np.where(known, numbers, 0)] if len(hot) else 0.0, 0.0)
            score, base, n_known = ((a + np.add.reduceat(b, starts[:-1])) for a, b in ((score, spelling), (0, base), (0, known.astype(np.int64))))
            rare = [[ids.new[i - len(hot)] for i in x[lead:][x[lead:] >= len(hot)].tolist()] for _, x, lead, _ in held]
            names = ["uid", "doc_id", "n_bytes", "n_tokens", "n_known", "base_score", "score", "rare"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_uids(held), pa.binary()), pa.array([d for d, _, _, _ in held], pa.int64()), pa.array([size for *_, size in held], pa.int64()), pa.array(np.diff(starts)), pa.array(n_known), pa.array(base), pa.array(score / np.log(10)), pa.array(rare, pa.list_(pa.binary()))], names)

    last = [b""]

    def _uids(held: list[tuple]) -> list[bytes]:
        """A number for each text, which its segments share."""
        out = []
        for _, _, lead, _ in held:
            last[0] = last[0] if lead else os.urandom(12)
            out.append(last[0])
        return out

    return run


def score(docs: DataFrame, stage: Stage | None = None, hot: int = HOT, coded: int = CODED, slot_bits: int = SLOT_BITS) -> DataFrame:
    """doc_id and text to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    stage = stage or Stage(docs.sparkSession, "lm")
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = stage.write(training.mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    # The least count that at most ``hot`` words reach: from the number of words of each count, so nothing is sorted.
    upto = counts.groupBy("c").agg(F.count("*").alias("_words")).withColumn("_upto", F.sum("_words").over(Window.orderBy(F.desc("c"))))
    least = upto.where(F.col("_upto") <= hot).agg(F.min("c")).first()[0]
    top = counts.where(F.col("c") >= least if least is not None else F.lit(False)).toPandas()  # at most ``hot`` rows
    top = top.assign(minus=-top["c"]).sort_values(["minus", "word"], ignore_index=True)
    words, many = [bytes(w) for w in top["word"]], top["c"].to_numpy(np.int64)
    coded = min(coded, len(words))
    below = n + 0.1 * (v + 1)
    base = np.log10((many + 0.1) / below) if below else np.zeros(0)

    # Bytes: the tables count every word, weights are learned from all different ones.
    bits = min(slot_bits, max(14, int(n).bit_length()))
    byte_bits = min(bits, 18)
    of_byte = np.zeros(256, np.int64)
    for r in counts.mapInArrow(_histogram, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        of_byte[r["byte"]] = r["n"]
    bytes_code = Code(of_byte)
    zeros, ones = _table(_few(counts).mapInArrow(_spelled_tables(bytes_code, byte_bits), "chunk long, n binary"), 2 * BYTES << byte_bits).reshape(2, -1)
    cells = _table(_few(counts).mapInArrow(_spelled_cells(bytes_code, byte_bits, states(zeros, ones)), "chunk long, n binary"), SPELLED_CELLS, np.int64)
    speller = Speller(bytes_code, byte_bits, zeros, ones, spelled_weights(cells))

    # Words: one symbol more, for those that are spelled.
    symbols = np.append(many[:coded], n - many[:coded].sum())
    code = Code(symbols)
    numbered = stage.write(docs.mapInArrow(_numbered(words), "doc_id long, n_bytes long, numbers binary, rare array<binary>"), "numbered")
    training = numbered.where(~held_out(F.col("doc_id"))).select("numbers")
    zeros, ones = _table(_few(training).mapInArrow(_word_tables(code, bits, words[:coded], coded), "chunk long, n binary"), 2 * ORDERS << bits).reshape(2, -1)
    cells = _word_cells(code, bits, states(zeros, ones), plain_states(*node_counts(code, symbols)), words[:coded], coded)
    cells = _table(_few(training).mapInArrow(cells, "chunk long, n binary"), WORD_CELLS, np.int64)
    reader = Reader(code, bits, symbols, zeros, ones, word_weights(cells))

    schema = "uid binary, doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    scored = stage.write(numbered.mapInArrow(_scorer(reader, speller, words, speller.score(words[coded:]) if words[coded:] else np.zeros(0), base, coded), schema), "scored")
    stage.drop(numbered)
    each = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(below)))
    rare = scored.select("uid", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("uid").agg(F.sum(each).alias("_sum"), F.sum((F.coalesce("c", F.lit(0)) > 0).cast("long")).alias("_known"))
    whole = scored.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known", "base_score", "score")]).join(rare, "uid", "left")
    return whole.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                        (F.col("base_score") + F.coalesce("_sum", F.lit(0.0))).alias("base_score"), "score", (F.col("score") * F.lit(-np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
