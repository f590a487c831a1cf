"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

A batch holds changes (op, doc_id, source, lang, text or counts, and seq if their order matters). Its signed rows
make its ledger: an insert adds what the document counts for, a delete takes back what it counted so far,
and a revision does both. Totals are additive, so the ledger's sums by key are added to the totals of the batch before.

What documents count for now is kept in ``buckets`` folders by the hash of doc_id. A batch reads and rewrites
those of its documents alone; neither earlier ledgers nor other buckets are read. A batch is committed by one file of the log,
made under another name and renamed to the batch's number, which fails if the number is taken: the writer then
starts again on top of the other's state. The log names the batch, its tables, and the folder of each bucket, so a reader
sees all of a batch or nothing. Committing a batch id again changes nothing, and a run that broke off leaves
a folder that nothing names. (On a store without a rename that refuses to overwrite, let one writer commit at a time.)

Tokenizer versions are named column expressions (words; pieces: letters, digits and marks apart),
counted in the JVM. ``encoded`` makes one from a public vocabulary file, whose path is a parameter.

Defined cases: a null text has no tokens; a null source or language is a key of its own; deleting a
document that is not there changes nothing; inserting one that is there revises it. Of a document's rows in a batch, those of
the largest seq count (null is the smallest), and of these inserts and revisions before deletes: without seq, a delete beside
an insert makes it a revision. Several rows that count are repeated documents of one id, and are taken back together. A null doc_id
counts, and can't be named again; an empty batch commits and changes nothing; totals that fall to no documents vanish; very long
texts are counted whole; extra columns of any name aren't read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, shared_dir

KEYS = ["source", "lang", "tokenizer"]
PIECES = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"

TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
    "pieces-1": lambda text: F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).cast("long"),
}


def encoded(path: str) -> Callable[[Column], Column]:
    """A tokenizer from a ``tokenizers`` JSON file at a path that every executor can open."""

    def counts(text: Column) -> Column:
        @F.pandas_udf("long")
        def run(batch):  # noqa: ANN001, ANN202
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            return batch.fillna("").map(lambda x: len(t.encode(x, add_special_tokens=False).ids))

        return run(text)

    return counts


class Rollup:
    """A log, ledgers, totals and current counts in one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, tokenizers: dict[str, Callable[[Column], Column]] | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", buckets
        self.tokenizers = tokenizers or TOKENIZERS
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("log").getFileSystem(self._conf)
        self._fs.mkdirs(self._at("log"))

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def log(self) -> list[dict]:
        """What is committed, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("log"))]
        names = sorted(n for n in names if n.endswith(".json") and n[0].isdigit())
        if not names:
            return []
        rows = self.spark.read.text([f"{self.path}/log/{n}" for n in names], wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["number"])

    def committed(self) -> list[tuple[int, str]]:
        """(number, batch id) of what is committed, in order."""
        return [(e["number"], e["batch"]) for e in self.log()]

    def _publish(self, entry: dict) -> bool:
        """Puts an entry into the log under its number; False if another writer has taken that."""
        draft, final = self._at(f"log/_draft-{uuid.uuid4().hex}"), self._at(f"log/{entry['number']:06d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs
        context = files.FileContext.getFileContext(draft.toUri(), self._conf)
        once = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        once[0] = files.Options.Rename.NONE
        try:
            context.rename(draft, final, once)
        except Py4JJavaError:
            if not self._fs.exists(final):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens after the last committed batch."""
        return self._totals(self.log())

    def _totals(self, log: list[dict]) -> DataFrame:
        if log:
            return self.spark.read.parquet(f"{self.path}/{log[-1]['data']}/totals")
        return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")

    def ledger(self) -> DataFrame | None:
        """All signed rows so far: doc_id, source, lang, tokenizer, docs, tokens. Commits don't read it."""
        paths = [f"{self.path}/{e['data']}/ledger" for e in self.log()]
        return self.spark.read.parquet(*paths) if paths else None

    def counted(self, docs: DataFrame) -> DataFrame:
        """One row for each document and tokenizer version; counts that docs bring along are taken as they are."""
        each = F.col("counts") if "counts" in docs.columns else self.counts(F.col("text"))
        return docs.select("doc_id", "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("docs"), "c.tokens")

    def counts(self, text: Column) -> Column:
        """array<struct<tokenizer, tokens>>: what a changes table may carry in ``counts`` in place of the text."""
        return F.array(*[F.struct(F.lit(k).alias("tokenizer"), f(text).alias("tokens")) for k, f in self.tokenizers.items()])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _last(changes: DataFrame) -> DataFrame:
        """The rows that count: of each document those of its largest seq."""
        named = changes.where("doc_id is not null")
        last = named.groupBy("doc_id").agg(F.max(F.struct("seq")).alias("_last"))
        kept = named.join(last, "doc_id").where(F.col("seq").eqNullSafe(F.col("_last.seq"))).select(*changes.columns)
        return kept.unionByName(changes.where("doc_id is null"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: op (insert, delete, revise), doc_id, source, lang, text or counts, and perhaps seq. False if the batch was there already."""
        log = self.log()
        if batch in [e["batch"] for e in log]:
            return False
        data = f"data/{uuid.uuid4().hex}"
        read = ["op", "doc_id", "source", "lang", "counts" if "counts" in changes.columns else "text", *(["seq"] if "seq" in changes.columns else [])]
        changes = changes.select(*read)
        changes = self._last(changes) if "seq" in read else changes
        # New rows, and one for each document that is named: a null tokenizer marks it.
        added = self.counted(changes.where("op in ('insert', 'revise')"))
        named = changes.where("doc_id is not null").select("doc_id", *[F.lit(None).cast("string").alias(k) for k in KEYS], F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens")).distinct()
        added.unionByName(named).write.parquet(f"{self.path}/{data}/changes")
        rows = self.spark.read.parquet(f"{self.path}/{data}/changes")
        new, named = rows.where("tokenizer is not null"), rows.where("tokenizer is null").select("doc_id")
        touched = sorted(r["b"] for r in named.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
        while True:
            if self._apply(batch, log, data, new, named, touched):
                return True
            log, data = self.log(), f"data/{uuid.uuid4().hex}"
            if batch in [e["batch"] for e in log]:
                return False

    def _apply(self, batch: str, log: list[dict], data: str, new: DataFrame, named: DataFrame, touched: list[int]) -> bool:
        """Writes the batch's tables on top of the log's state, and commits them."""
        where = dict(log[-1]["buckets"]) if log else {}
        paths = [f"{self.path}/{where[str(b)]}/bucket={b}" for b in touched if str(b) in where]
        at, sums = f"{self.path}/{data}", [F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")]
        now, taken = new.where("doc_id is not null"), None
        if paths:
            state = self.spark.read.schema(new.schema).parquet(*paths)
            taken = state.join(named, "doc_id", "left_semi")
            now = now.unionByName(state.join(named, "doc_id", "left_anti"))
        signed = new if taken is None else new.unionByName(taken.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))
        signed.write.parquet(f"{at}/ledger")
        now = now.groupBy("doc_id", *KEYS).agg(*sums).withColumn("bucket", self._bucket())
        now.repartition("bucket", F.pmod(F.shiftright(F.xxhash64("doc_id"), 32), F.lit(4))).write.partitionBy("bucket").parquet(f"{at}/state")
        delta = self.spark.read.schema(new.schema).parquet(f"{at}/ledger").groupBy(*KEYS).agg(*sums)
        self._totals(log).unionByName(delta).groupBy(*KEYS).agg(*sums).where("docs <> 0").write.parquet(f"{at}/totals")
        made = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(self._at(f"{data}/state")) if "bucket=" in s.getPath().getName()}
        for b in map(str, touched):
            where.pop(b, None)
            if b in made:
                where[b] = f"{data}/state"
        number = log[-1]["number"] + 1 if log else 1
        return self._publish({"number": number, "batch": batch, "data": data, "buckets": where})
