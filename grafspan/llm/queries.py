"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline as stages
from . import decontaminate, language_model, line_templates, mixing, neardup, quality, secrets, sharding, token_counts, url_filter
from .shared import Stage, table

WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents; that batch once more; documents labelled toxic deleted;
    those labelled of poor quality revised to their text without the symbols #*$%&|<>."""
    rollup = token_counts.Rollup(spark)
    clean = F.when(F.col("text").rlike(r"[#*$%&|<>]"), rollup.counts(F.regexp_replace("text", r"[#*$%&|<>]+", "")))
    # Texts are counted in one scan, and joins see counts only.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", rollup.counts(F.col("text")).alias("counts"), clean.alias("clean"))
    docs = Stage(spark, "token-counts").write(docs, "counted")
    labels = table(spark, sf_dir, "labels")
    load = docs.drop("clean").withColumn("op", F.lit("insert"))
    rollup.commit("load", load)
    rollup.commit("load", load)
    toxic, poor = labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0 and toxic = 0").select("doc_id")
    rollup.commit("takedown", docs.drop("clean").join(toxic, "doc_id", "left_semi").withColumn("op", F.lit("delete")))
    rollup.commit("cleaned", docs.join(poor, "doc_id", "left_semi").withColumn("counts", F.coalesce("clean", "counts")).drop("clean").withColumn("op", F.lit("revise")))
    return rollup.totals()


OP1_SQL = f"""
WITH t AS (
  SELECT d.doc_id, source, lang, CASE WHEN l.quality = 0 THEN regexp_replace(text, '[#*$%&|<>]+', '', 'g') ELSE text END AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0),
c AS (SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, {WORD_SQL})), 0) AS n FROM t
      UNION ALL SELECT source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}+|[^\\s\\x0B\\p{{L}}\\p{{N}}]+')), 0) FROM t)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM c GROUP BY ALL
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD_SQL})), 0)::BIGINT AS size, md5(coalesce(text, '')) AS h,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, (n % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w) AS free FROM l WHERE cap >= w * level),
g AS (SELECT source, source_size, CASE WHEN free IS NULL OR cap < w * free THEN cap ELSE w * free END AS target FROM l, f),
q AS (SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, h) AS cum
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT q.*, k, (k * source_size + cum) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0 AND k * source_size + cum - size < target),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, draw, doc_id NULLS FIRST, h, k) AS upto FROM o),
t AS (SELECT doc_id, h, count(*) FILTER (upto <= (SELECT sum(target) FROM g)) AS times FROM c GROUP BY doc_id, h)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, (q.size * coalesce(t.times, 0))::BIGINT AS taken
FROM q LEFT JOIN t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.h = t.h
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


STOPS_SQL = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD_SQL}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD_SQL})) AS l, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: length(x) > 2 AND upper(x) = x AND lower(x) <> x AND NOT contains(x, 'ß'))) AS shout,
         len(list_filter(w, lambda x: x = '|')) AS bars, len(list_filter(w, lambda x: lower(x) IN ({STOPS_SQL}))) AS stops,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS echo
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
r AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, greatest(n_words, 1) AS n,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols / n > 0.25 OR shout / n > 0.3 OR (n_dup_lines / greatest(len(l), 1) > 0.5 AND n_words >= 40)
            OR echo / n > 0.3 OR bars / n > 0.2 OR word_chars / n > 30 OR word_chars / n < 2 OR (stops / n < 0.005 AND n_words >= 200)) AS kept
FROM r
"""


#: The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every sixteenth canonical URL of the table, by its digest. Pages of one host differ, variants of one URL don't."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")) != "").select(url_filter.canonical(F.col("url")).alias("canonical")).where(F.md5("canonical").startswith("7"))
    return url_filter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(host, '^(www|m|blog)\.([^.]+\.)', '\2'), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE host <> '' AND starts_with(md5('=' || canonical), '7')),
r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, q, v)),
m AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, m.rule,
       coalesce(m.v, CASE WHEN c.host <> '' AND c.canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m ON c.page_id = m.page_id
"""


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_language_model": op6_language_model,
    "op7_neardup": op7_neardup,
    "op8_decontaminate": op8_decontaminate,
    "op9_sharding": op9_sharding,
    "op10_line_templates": op10_line_templates,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_token_counts": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op5_quality": OP5_SQL,
}
