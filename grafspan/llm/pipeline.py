"""From raw documents to a sharded training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and reread as the next stage's docs. All but the last return the columns of
``documents``; the last returns the manifest of the shards, one row for each document of the mix.

Defined cases, in every stage: rows pass whole, as structs, so columns of any name (``_x``, ``n_words``, ``kept``) keep their values;
a document is known by doc_id and text, so rows without an id stand or fall by their own text; repeated rows share their
fate, but for near_dedup, which leaves one of them; a null or blank text fails the quality rules, and passes the others
(mixing never takes it: it has no words); very long texts are judged whole; ties are broken as the operators say;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, neardup, quality, sharding
from .shared import Stage, packed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality.judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity of 0.8 or more."""
    return neardup.one_of_each(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    rows = packed(docs, "doc_id", "text").withColumn("_row", neardup.row_key())
    found = decontaminate.leaks(rows.select("_row", "text"), table(spark, sf_dir, "benchmark"), key="_row")
    leaking = Stage(spark, "leaks").write(found.select("_row").distinct(), "rows")
    return rows.join(leaking, "_row", "left_anti").select("_doc.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    stage = Stage(spark, "mixing")
    taken = mixing.mix(docs, stage=stage).where("times > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_text", "times").distinct()
    taken = stage.write(taken, "taken")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.md5(F.coalesce("text", F.lit("")).cast("binary")) == F.col("_text"))
    return packed(docs, "doc_id", "source", "text").join(taken, same).select("_doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_doc.*")


def balanced_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest: doc_id, size, text_crc32, law, shard, slot, grown_shard, n_cut; copies of a text stay together."""
    return sharding.shard(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("balanced_shards", balanced_shards),
]

#: Components and label propagation don't go into one SQL statement; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage.write(function(spark, docs, sf_dir), name)
    return docs
