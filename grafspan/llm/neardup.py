"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Every text becomes its set of word shingles, a digest of that set (its class) and a MinHash
   signature. Texts with equal sets share a class, so copies are settled by one aggregation.
2. Bands of the signature put classes into buckets. Shingles that only one of these classes has are
   counted: they bound what a class can share, and a pair or class whose bound is below the
   threshold is out, exactly. In each bucket all members are paired with the one that has the
   fewest shingles of its own, so a bucket of m members gives m - 1 candidates.
3. A candidate's signatures are compared a batch of hashes at a time. It is pruned as soon as the
   posterior probability of reaching the threshold (uniform prior: a Beta tail) falls below the
   chosen miss probability.
4. Survivors are verified on their full sets, exactly.
5. Components of the verified links; then classes of a bucket that are still in different
   components are paired by an exact prefix filter on their rarest shingles and verified too, so
   that no chain is lost for want of a leader.

A link of similarity s is missed if no band agrees, (1 - s**ROWS)**BANDS (3e-6 at 0.8), or if it is
pruned (MISS at most, in each batch).

Defined cases: a null or blank text has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; repeated rows are one class; rows with a null doc_id
take part, and a component's id is its smallest known doc_id; an empty table gives an empty
result. Very long texts are compared on all their shingles; of equal candidates the class of the smaller digest leads. Extra
columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .components import components
from .shared import WORD, Stage, packed

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the chance that a batch loses a true link.
BATCH, MISS = 32, 1e-9
_RNG = np.random.default_rng(20_240_503)
_FLIP = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        y = (x[i : i + 2048, None] ^ _FLIP) * _ODD
        y ^= y >> np.uint32(15)
        np.minimum(low, y.min(axis=0), out=low)
    return low


def digest(s: np.ndarray) -> bytes:
    return np.array([words.mix64(s + np.uint64(1)).sum(), words.mix64(s ^ np.uint64(0x5555555555555555)).sum()], np.uint64).tobytes()


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(1, b.num_rows), 2000):
                part = b.slice(at, 2000)
                n, cls, sig = [], [], []
                for s in words.sets(part.column("text"), k):
                    n.append(len(s))
                    cls.append(digest(s) if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "row", "n_shingles", "cls", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = np.random.default_rng(20_240_504).integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in batches:
        for at in range(0, b.num_rows, 4000):
            part = b.slice(at, 4000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = words.mix64((words.mix64(sig + np.uint64(7)) * odd).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), part.column("cls").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))], ["bucket", "cls"])


@cache
def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among n hashes for which P(similarity >= threshold | matches) is at least ``miss``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alive = np.arange(b.num_rows)
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
                match = np.zeros(b.num_rows, np.int64)
                for at in range(0, HASHES, BATCH):
                    match[alive] += (left[alive, at : at + BATCH] == right[alive, at : at + BATCH]).sum(axis=1)
                    alive = alive[match[alive] >= least_matches(min(at + BATCH, HASHES), threshold, miss)]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(alive)) for c in ("a", "b")], ["a", "b"])

    return run


class _Sets:
    """The shingle sets of the texts seen last, by class: rows of one group tend to stand together."""

    def __init__(self, k: int, room: int = 8 << 20):
        self.k, self.room, self.held, self.size = k, room, {}, 0

    def __call__(self, cls: bytes, text: pa.Array) -> np.ndarray:
        if (s := self.held.pop(cls, None)) is None:
            s = next(words.sets(text, self.k))
            self.size += s.nbytes
            while self.size > self.room and self.held:
                self.size -= self.held.pop(next(iter(self.held))).nbytes
        self.held[cls] = s
        return s


def _exact(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(k)
        for b in batches:
            good, a, c = [], b.column("a").to_pylist(), b.column("b").to_pylist()
            for i in range(b.num_rows):
                one, two = sets(a[i], b.column("text_a").slice(i, 1)), sets(c[i], b.column("text_b").slice(i, 1))
                both = np.concatenate((one, two))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([b.column(x).take(pa.array(good, pa.int64())) for x in ("a", "b")], ["a", "b"])

    return run


def _spread(k: int):
    """Texts to (shingle, owner), the class by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners = b.column("owner").to_numpy(zero_copy_only=False)
            part, mine = [], []
            for i, s in enumerate(words.sets(b.column("text"), k)):
                part.append(s.view(np.int64))
                mine.append(np.full(len(s), owners[i]))
                if sum(map(len, part[-1:])) and sum(map(len, part)) > 1 << 18 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(np.concatenate(mine))], ["shingle", "owner"])
                    part, mine = [], []

    return run


def verify(pairs: DataFrame, signs: DataFrame, texts: DataFrame, k: int, percent: int, stage: Stage, name: str) -> DataFrame:
    """Pairs (a, b) of classes to those that reach the threshold, as a written table."""
    one = pairs.join(signs.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), "a").join(signs.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b")), "b")
    left = stage.write(one.mapInArrow(_prune(percent / 100, MISS), "a binary, b binary"), f"{name}-survivors")
    both = left.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    links = stage.write(both.mapInArrow(_exact(k, percent), "a binary, b binary"), f"{name}-links")
    stage.drop(left)
    return links


def common_prefixes(apart: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots among classes (cls, n, root) that may reach the threshold, exactly.

    With the shingles of every class in one order, rarest first, two similar sets have one in common among the
    first n - ceil(percent * n / 100) + 1 of each; and from the first common one on, enough must be left of both.
    What makes a text different is rare and stands first, so that variants that are too far from each other
    meet nowhere early enough.
    """
    spread = texts.join(apart.select("cls"), "cls", "left_semi").mapInArrow(_spread(k), "shingle long, owner long")
    df = spread.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = spread.join(df, "shingle").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    # Shingles that no other class has come before all of these.
    named = shared.join(apart.join(texts.select("cls", "owner"), "cls"), "owner")
    alone = F.col("n") - F.size("s")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    rows = named.where(prefix > 0).select("cls", "n", "root", alone.alias("alone"), F.posexplode(F.transform(F.slice("s", F.lit(1), prefix.cast("int")), lambda x: x["shingle"])).alias("at", "shingle"))
    rows = rows.withColumn("left", F.col("n") - F.col("alone") - F.col("at"))
    x, y = rows.alias("x"), rows.alias("y")
    enough = F.least("x.left", "y.left") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & enough)
    return pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def cluster(docs: DataFrame, k: int = 5, percent: int = 80, stage: Stage | None = None) -> DataFrame:
    """doc_id and text to doc_id, n_shingles, component_id, kept, row (see row_key) and root, the component's own key."""
    stage = stage or Stage(docs.sparkSession, "neardup")
    docs = docs.select("doc_id", "text")
    signed = stage.write(docs.withColumn("row", row_key()).mapInArrow(_sign(k), "doc_id long, row string, n_shingles long, cls binary, sig binary"), "signed")
    known = signed.where("cls is not null")
    classes = known.groupBy("cls").agg(F.min("doc_id").alias("low"), F.min("n_shingles").alias("n"))
    signs = stage.write(known.select("cls", "sig").dropDuplicates(["cls"]), "signs", codec="none")

    bands = signs.mapInArrow(_bands, "bucket long, cls binary")
    often = bands.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    shared = stage.write(bands.join(often, "bucket"), "buckets")
    # One text of each class in a bucket with others: any row of its smallest doc_id whose set is that class.
    want = shared.select("cls").distinct().join(classes, "cls").select("cls", F.col("low").alias("_id"))
    rows = docs.join(want, F.col("doc_id").eqNullSafe(F.col("_id"))).select("cls", "text")
    texts = rows.mapInArrow(_same(k), "cls binary, text string").dropDuplicates(["cls"])
    texts = stage.write(texts.withColumn("owner", F.monotonically_increasing_id()), "texts")  # unique in the table as written

    # Shingles that no other class has can't be common ones. With s others at most, a pair needs
    # min(s) >= percent * (n + n') / (100 + percent); a class with s < percent * n / 100 has no partner.
    single = texts.mapInArrow(_spread(k), "shingle long, owner long").groupBy("shingle").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo = hi")
    alone = stage.write(single.groupBy(F.col("lo").alias("owner")).agg(F.count("*").alias("alone")), "alone")
    sizes = texts.select("cls", "owner").join(classes.select("cls", "n"), "cls")
    sizes = sizes.join(alone, "owner", "left").select("cls", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")).where(F.col("s") * 100 >= F.col("n") * percent)
    members = stage.write(shared.join(stage.write(sizes, "sizes"), "cls"), "members")
    stage.drop(shared)

    # The leader has the fewest shingles of its own.
    lead = members.groupBy("bucket").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "cls", "n", "s")).alias("l"), F.count("*").alias("m")).where("m > 1").select("bucket", "l")
    able = lambda s1, n1, s2, n2: F.least(s1, s2) * (100 + percent) >= (n1 + n2) * percent
    pairs = members.join(lead, "bucket").where((F.col("cls") != F.col("l.cls")) & able(F.col("s"), F.col("n"), F.col("l.s"), F.col("l.n"))).select(F.col("cls").alias("a"), F.col("l.cls").alias("b")).distinct()
    tried = stage.write(pairs, "star-pairs")
    links = verify(tried, signs, texts, k, percent, stage, "star")
    roots = components(links, stage)

    # Members of one bucket that are still apart.
    marked = stage.write(members.join(roots, F.col("cls") == F.col("node"), "left").select("bucket", "cls", "n", "s", F.coalesce("root", "cls").alias("root")), "marked")
    apart = marked.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("bucket")
    apart = stage.write(marked.join(apart, "bucket").select("cls", "n", "root").distinct(), "apart")
    rest = stage.write(common_prefixes(apart, texts, k, percent).join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"), "rest-pairs")
    more = verify(rest, signs, texts, k, percent, stage, "rest")
    if not more.isEmpty():
        roots = components(links.unionByName(more), stage)
    for t in (members, marked, signs, texts):
        stage.drop(t)
    named = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    named = stage.write(named, "named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = named.join(least, "root").select("cls", "root", "component_id")
    out = signed.select("doc_id", "row", "n_shingles", "cls").join(of_class, "cls", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"), "row", "root")


def row_key() -> Column:
    """Stands for a row's doc_id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id, and all rows without words."""
    stage, docs = Stage(docs.sparkSession, "neardup"), packed(docs, "doc_id", "text")
    found = cluster(docs, k, percent, stage)
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("f")).select(F.col("f.row").alias("_row"))
    keep = stage.write(first.distinct(), "keep")
    rows = docs.withColumn("_row", row_key()).join(keep, "_row").withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).where("_nth = 1").select(*docs.columns)
    return rows.unionByName(docs.where(~F.coalesce("text", F.lit("")).rlike(WORD))).select("_doc.*")


def _same(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = b.column("cls").to_pylist()
            yield b.take(pa.array([i for i, s in enumerate(words.sets(b.column("text"), k)) if len(s) and digest(s) == cls[i]], pa.int64()))

    return run
