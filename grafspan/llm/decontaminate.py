"""Benchmark decontamination by latent semantic retrieval and subsequence checks.

1. Terms are the words of the benchmark; their document frequencies are counted over all documents.
2. Benchmark items are cut into passages. A randomised SVD of their TF-IDF matrix gives a latent
   space: partial products of row blocks are made on the executors and summed by Spark; only
   matrices of (terms x rank) meet on the driver.
3. What a document can cover of an item is bounded by the weight of the item's words that it has anywhere; documents and
   items with less than ``PART`` are out, exactly. Every other document is read in half-overlapping windows. A window with ``SHARE`` of its squared TF-IDF
   length in the benchmark's terms, and ``SHARE`` of its length in the latent space, is a candidate
   for the items whose passages have a cosine of ``COSINE`` or more to it there. Both shares are less for
   an item shorter than a window, in proportion. Words outside the benchmark, whose frequency isn't
   counted, weigh as much as the median term that documents have, so shares don't depend on the corpus' size.
4. Around a candidate window, where the same bound holds again, the longest common subsequence of words with the whole item is found.
   A document leaks an item if that covers ``COVER`` of the item's words, or ``PART`` of them with
   ``ANSWER`` of its last quarter (where a question's answer stands), words counted by their weight.

Items are a stated query set: they are taken in blocks of ``block`` characters of text, each block
against all documents, so what is sent to executors is bounded by a block and its longest item, however long items are.
Frequencies are counted in one scan for all blocks, up to ``VOCABULARY`` terms a scan.

Defined cases: null and blank texts leak nothing, items of null or blank text are never leaked; an item with a null item_id
is reported with a null; repeated rows of documents give one row, and so do rows without an id; items of equal text and
different ids are each reported; very long texts are read whole, in all their windows; of windows with equal
cover the larger cosine, then the longer subsequence is reported; a document shorter than
a window is one window; empty tables give an empty result. Only the document's key, text and item_id are read, so extra columns
of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words
from .shared import Stage, draw, running_sum

WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE, POWER = 256, 32, 2
SHARE, COSINE, COVER, PART, ANSWER = 0.12, 0.45, 0.60, 0.45, 0.70
BATCH_BYTES = 1 << 20
VOCABULARY = 1 << 22
_CHUNKS = 16


def passages(h: np.ndarray) -> list[np.ndarray]:
    """An item's words to windows; the last one ends with the item."""
    if len(h) <= WINDOW:
        return [h] if len(h) else []
    starts = list(range(0, len(h) - WINDOW, STRIDE)) + [len(h) - WINDOW]
    return [h[s : s + WINDOW] for s in starts]


def _texts(part: pa.RecordBatch, column: str):
    """(first row, hashes, cuts) of slices of bounded size."""
    lens = np.diff(words.buffers(part.column(column))[1])
    i = 0
    while i < part.num_rows:
        j, room = i, 0
        while j < part.num_rows and (j == i or room + lens[j] <= BATCH_BYTES):
            room += lens[j]
            j += 1
        h, _, _, text = words.hashed(*words.buffers(part.column(column).slice(i, j - i)), gaps=words.MARKS)
        yield i, h, np.searchsorted(text, np.arange(j - i + 1)), text
        i = j


def _frequencies(vocab: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, df, n = words.Lookup(vocab), np.zeros(len(vocab), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, h, _, text in _texts(b, "text"):
                term = find(h)
                known = term >= 0
                both = np.unique(text[known] * len(vocab) + term[known])
                df += np.bincount(both % len(vocab), minlength=len(vocab))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], ["term", "df"])

    return run


def weights_of(df: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights of the terms, and of a word that is none: the median of those that documents have."""
    idf = np.log((n + 1) / (df + 1)) + 0.01
    return idf, float(np.median(idf[df > 0])) if (df > 0).any() else 0.01


def _rows(h_lists: list[np.ndarray], find: words.Lookup, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages to (passage, term, value) of rows of unit length."""
    p, t, v = [], [], []
    for i, h in enumerate(h_lists):
        term, tf = np.unique(find(h), return_counts=True)
        value = tf * idf[term]
        p.append(np.full(len(term), i))
        t.append(term)
        v.append(value / max(1e-12, np.sqrt((value**2).sum())))
    return np.concatenate(p), np.concatenate(t), np.concatenate(v)


def _product(vocab: np.ndarray, idf: np.ndarray, basis: np.ndarray, gram: bool):
    """Row blocks A to A'(A basis), or (A basis)'(A basis), in ranges of that matrix' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = words.Lookup(vocab)
        out = np.zeros((basis.shape[1] if gram else len(vocab), basis.shape[1]))
        for b in batches:
            cut = [x for _, h, at, _ in _texts(b, "text") for i in range(len(at) - 1) for x in passages(h[at[i] : at[i + 1]])]
            if cut:
                p, t, v = _rows(cut, find, idf)
                y = np.zeros((len(cut), basis.shape[1]))
                np.add.at(y, p, v[:, None] * basis[t])
                if gram:
                    out += y.T @ y
                else:
                    np.add.at(out, t, v[:, None] * y[p])
        for i, part in enumerate(np.array_split(out, _CHUNKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["chunk", "values"])

    return run


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices whose rows the executors sent: (terms x rank) or (rank x rank) numbers."""
    out = np.zeros(shape)
    ranges = np.array_split(out, _CHUNKS)  # views
    for r in parts.repartition(_CHUNKS, "chunk").mapInArrow(_added, PARTS).toLocalIterator():
        ranges[r["chunk"]][:] = np.frombuffer(r["values"]).reshape(-1, shape[1])
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, v in zip(b.column("chunk").to_pylist(), b.column("values"), strict=True):
            part = np.frombuffer(v.as_buffer())
            sums[i] = sums[i] + part if i in sums else part
    for i, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["chunk", "values"])


PARTS = "chunk long, values binary"


def randomised_svd(items: DataFrame, vocab: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 8) -> np.ndarray:
    """(terms x rank): the leading right singular vectors of the items' passages."""
    wide = min(rank + OVERSAMPLE, len(vocab))
    basis = np.random.default_rng(seed).standard_normal((len(vocab), wide))
    for _ in range(POWER):
        basis = np.linalg.qr(_summed(items.mapInArrow(_product(vocab, idf, basis, False), PARTS), (len(vocab), wide)))[0]
    gram = _summed(items.mapInArrow(_product(vocab, idf, basis, True), PARTS), (basis.shape[1], basis.shape[1]))
    value, vector = np.linalg.eigh(gram)
    keep = np.argsort(-value)[:rank]
    keep = keep[value[keep] > 1e-9 * max(value.max(), 1e-300)]
    return basis @ vector[:, keep]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of one longest common subsequence of a and b, a being the shorter."""
    mask: dict[int, int] = {}
    for i, x in enumerate(a):
        mask[x] = mask.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, steps = full, []
    for x in b:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
        steps.append(v)
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:  # a zero bit marks where the length grows
        if steps[j] >> i & 1:
            i -= 1
        elif j and not steps[j - 1] >> i & 1:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def _search(kind: pa.DataType, vocab: np.ndarray, idf: np.ndarray, unknown: float, latent: np.ndarray, ids: list, items: list[np.ndarray]):
    """Documents to (key, item_id, cosine, lcs, item_words, cover, answer); kind is the key's."""
    cut = [(i, x) for i, h in enumerate(items) for x in passages(h)]
    find = words.Lookup(vocab)
    p, t, v = _rows([x for _, x in cut], find, idf)
    target = np.zeros((len(cut), latent.shape[1]))
    np.add.at(target, p, v[:, None] * latent[t])
    target = (target / np.maximum(np.sqrt((target**2).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32).T
    owner = np.array([i for i, _ in cut])
    weights = [idf[find(h)] for h in items]
    lists = [h.tolist() for h in items]
    short = np.array([min(1.0, len(h) / WINDOW) for h in items])
    least, needed = SHARE * short.min(), (SHARE * short[owner]).astype(np.float32)
    vectors, squares = (latent * idf[:, None]).astype(np.float32), np.append(idf**2, unknown**2).astype(np.float32)

    of_item = [find(h) for h in items]
    needs = np.array([PART * w.sum() * (1 - 1e-9) for w in weights])
    post_item = np.repeat(np.arange(len(items)), [len(t) for t in of_item])
    post_term = np.concatenate(of_item)
    by_term = np.argsort(post_term, kind="stable")
    post_item, first_post = post_item[by_term], np.searchsorted(post_term[by_term], np.arange(len(vocab) + 1))

    def possible(term: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Texts and items, as text * items + item, of which a text has enough words."""
        known = term >= 0
        both = np.unique(text[known] * len(vocab) + term[known])
        of, term = both // len(vocab), both % len(vocab)
        size = first_post[term + 1] - first_post[term]
        at = np.arange(size.sum()) + np.repeat(first_post[term] - np.append(0, np.cumsum(size)[:-1]), size)
        key, place = np.unique(np.repeat(of, size) * len(items) + post_item[at], return_inverse=True)
        return key[np.bincount(place, np.repeat(idf[term], size), len(key)) >= needs[key % len(items)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, here = words.Lookup(vocab), np.zeros(len(vocab) + 1, bool)  # the last place is for words that are no terms

        def can(term: np.ndarray, item: int):  # noqa: ANN202
            def region(low: int, high: int) -> bool:
                here[term[low:high]] = True
                here[-1] = False
                enough = weights[item][here[of_item[item]]].sum() >= needs[item]
                here[term[low:high]] = False
                return enough

            return region

        for b in batches:
            found: list[tuple] = []
            for first, h, at, text in _texts(b, "text"):
                if not len(h):
                    continue
                term = find(h)
                pairs = possible(term, text)
                if not len(pairs):
                    continue
                able = np.zeros(len(at), bool)
                able[pairs // len(items)] = True
                pairs = set(pairs.tolist())
                within = np.arange(len(h)) - at[text]
                begins = np.flatnonzero(within % STRIDE == 0)  # blocks of STRIDE words; a window is two of them
                same = np.append(text[begins[1:]] == text[begins[:-1]], False)
                square = squares[term]
                pair = lambda x: x + np.where(same.reshape(-1, *[1] * (x.ndim - 1)), np.append(x[1:], x[:1] * 0, axis=0), 0)
                whole = pair(np.add.reduceat(square, begins))
                own = pair(np.add.reduceat(np.where(term >= 0, square, 0), begins))
                near = (own >= least * whole) & able[text[begins]]
                if not near.any():
                    continue
                # Vectors are summed for the blocks of near windows alone.
                used = np.flatnonzero(near | np.append(False, near[:-1] & same[:-1]))
                size = np.diff(np.append(begins, len(h)))[used]
                flat = np.repeat(begins[used] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                first_of = np.append(0, np.cumsum(size))
                blocks = np.zeros((len(used), vectors.shape[1]), np.float32)
                for s in range(0, len(used), 2048):
                    at_once = term[flat[first_of[s] : first_of[min(s + 2048, len(used))]]]
                    rows = vectors[np.maximum(at_once, 0)] * (at_once >= 0)[:, None]
                    blocks[s : s + 2048] = np.add.reduceat(rows, first_of[s : min(s + 2048, len(used))] - first_of[s], axis=0)
                place = np.full(len(begins), -1)
                place[used] = np.arange(len(used))
                w = np.flatnonzero(near)
                x = blocks[place[w]] + np.where(same[w, None], blocks[np.where(same[w], place[np.minimum(w + 1, len(begins) - 1)], 0)], 0)
                norm = np.sqrt((x**2).sum(axis=1))
                share = np.minimum(own[w] / whole[w], norm / np.sqrt(whole[w]))
                inside = (norm > 0) & (share >= least)
                w, x, norm, share = w[inside], x[inside], norm[inside], share[inside]
                best: dict[tuple[int, int], list] = {}
                for s in range(0, len(w), 2048):
                    cosine = x[s : s + 2048] @ target / norm[s : s + 2048, None]
                    for i, j in zip(*np.nonzero((cosine >= COSINE) & (share[s : s + 2048, None] >= needed)), strict=True):
                        key = (int(text[begins[w[s + i]]]), int(owner[j]))
                        best.setdefault(key, []).append((float(cosine[i, j]), int(begins[w[s + i]])))
                for (d, item), spots in best.items():
                    if d * len(items) + item in pairs and (leak := check(h, at[d], at[d + 1], spots, lists[item], weights[item], can(term, item))) is not None:
                        found.append((b.column("key")[first + d].as_py(), ids[item], *leak))
            names = ["key", "item_id", "cosine", "lcs", "item_words", "cover", "answer"]
            kinds = [kind, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    return run


def check(h: np.ndarray, low: int, high: int, spots: list, item: list[int], weight: np.ndarray, can: Callable[[int, int], bool] | None = None) -> tuple | None:
    """The item's best subsequence around its candidate windows, if that is a leak. ``can`` tells whether a region has words enough."""
    best, done = None, -1
    tail = len(item) - max(3, len(item) // 4)
    total, end = weight.sum(), weight[max(0, tail):].sum()
    for cosine, at in sorted(spots, key=lambda s: s[1]):
        if at < done:  # the region of the last window held this one with all of the item
            continue
        begin, end_ = max(low, at - len(item)), min(high, at + WINDOW + len(item))
        done = at + STRIDE if len(item) > WINDOW else at
        if can and not can(begin, end_):
            continue
        region = h[begin:end_].tolist()
        place = common(item, region)
        cover = weight[place].sum() / total if total else len(place) / len(item)
        answer = weight[[i for i in place if i >= tail]].sum() / end if end else 0.0
        if (cover >= COVER or (cover >= PART and answer >= ANSWER)) and len(place) >= min(len(item), 5) and (best is None or cover > best[3]):
            best = (cosine, len(place), len(item), float(cover), float(answer))
    return best


def frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are."""
    df, n = np.zeros(len(vocab), np.int64), 0
    for at in range(0, len(vocab), VOCABULARY):
        some = vocab[at : at + VOCABULARY]
        for r in docs.select("text").mapInArrow(_frequencies(some), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            if r["term"] < 0:
                n = r["df"]
            else:
                df[at + r["term"]] = r["df"]
    return df, n


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = 1 << 20, key: str = "doc_id", stage: Stage | None = None) -> DataFrame:
    """One row for each document and item that it leaks: the document's key, item_id, cosine, lcs, item_words, cover, answer."""
    spark = docs.sparkSession
    stage = stage or Stage(spark, "leaks")
    docs = docs.select(F.col(key).alias("key"), F.lower("text").alias("text"))
    kind = docs.schema["key"].dataType
    schema = f"key {kind.simpleString()}, item_id long, cosine double, lcs long, item_words long, cover double, answer double"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text is not null").withColumn("_size", F.length("text"))
    items = items.withColumn("_draw", draw(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.md5("text")))
    items = running_sum(items, [], ["_draw", "item_id", "text"], "_size", "_upto", spread="_draw").withColumn("_block", F.floor((F.col("_upto") - F.col("_size")) / block))
    items = stage.write(items.select("_block", "item_id", "text"), "items")
    numbers = sorted(r["_block"] for r in items.select("_block").distinct().collect())

    def read(number: int) -> tuple[list, list[np.ndarray]]:
        """Ids and words of a block's items."""
        rows = sorted(((r["item_id"], r["text"]) for r in items.where(F.col("_block") == number).collect()), key=lambda r: (r[0] is not None, r))
        cut = [(i, words.hashed(*words.buffers(pa.array([t])), gaps=words.MARKS)[0]) for i, t in rows]
        return [i for i, h in cut if len(h)], [h for _, h in cut if len(h)]

    every = np.zeros(0, np.uint64)
    for k in numbers:
        every = np.union1d(every, np.concatenate([every, *read(k)[1]]))
    if not len(every):
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    df, n = frequencies(docs, every)
    out = None
    for k in numbers:
        ids, texts = read(k)
        if not ids:
            continue
        vocab = np.unique(np.concatenate(texts))
        idf, unknown = weights_of(df[np.searchsorted(every, vocab)], n)
        latent = randomised_svd(items.where(F.col("_block") == k), vocab, idf)
        hits = docs.mapInArrow(_search(to_arrow_type(kind), vocab, idf, unknown, latent, ids, texts), schema)
        out = hits if out is None else out.unionByName(hits)
    best = F.max_by(F.struct("cosine", "lcs", "item_words", "cover", "answer"), F.struct("cover", "cosine", "lcs")).alias("b")
    return out.groupBy("key", "item_id").agg(best).select(F.col("key").alias(key), "item_id", "b.*")
