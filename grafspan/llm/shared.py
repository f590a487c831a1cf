"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import importable

#: A word: a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a local master gets a folder of its own; any other must name one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="grafspan-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


class Stage:
    """Written tables of one run in the shared folder. A table that is no longer read can be dropped at once."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """The table as written: lineage ends there, and a lost executor costs no more than one read."""
        self.n += 1
        path = f"{self.at}/{self.n:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and getattr(df, "staged_at", None):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and _doc, a struct of all columns: whatever their names are, ``_doc.*`` brings them back."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def clear(df: DataFrame, *made: str) -> DataFrame:
    """df without columns that an operator makes itself, and without names that begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_") or c in made])


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, UPPER, LOWER)


def draw(*parts: Column) -> Column:
    """A uniform integer of 32 bits that depends on nothing but the parts; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, to: str, spread: str, bits: int = 14) -> DataFrame:
    """Adds column ``to``: the sum of ``value`` over the rows of the same keys up to and with this one.

    A window over a key alone would send a third of all rows to one task when the key is hot.
    The first of the order columns must be an integer of 32 bits, ``spread``, drawn uniformly:
    its upper bits cut every key into 2**bits ranges. Ranges are summed first (with partial sums
    on the map side), a window over the range totals gives each range its start, and rows are
    then numbered within their range.
    """
    cut = F.shiftright(F.col(spread), 32 - bits)
    rows = df.withColumn("_range", cut)
    totals = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    same = F.lit(True)
    left, right = rows.alias("l"), starts.alias("r")
    for k in [*keys, "_range"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, same).select("l.*", "r._start")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(to, F.col("_start") + F.sum(value).over(inside)).drop("_range", "_start")
