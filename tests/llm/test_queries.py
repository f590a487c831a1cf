"""The registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import collections
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from grafspan.llm import decontaminate, quality
from grafspan.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import WORD, brute_components

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, expected = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(expected.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, expected))
    assert len(a) == len(b) and (a == b).all().all()


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns that stages use or make themselves, nulls in any column, no ids, repeated and blank rows, and long texts."""
    rng = random.Random(17)
    text = lambda n: " ".join(rng.choice("the of and a in house river cloud stone bright walk seven paper window".split()) + str(rng.randrange(90)) * (rng.random() < 0.7) for _ in range(n))
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 150").first()["text"]
    one, long = text(80), text(9000)
    rows = [(i, text(60 + i), "en", f"s{i % 3}") for i in range(30)] + [(40, one, None, None), (41, one + " end", "en", "s0"), (41, one + " end", "en", "s0"), (42, None, "en", "s1"), (43, "", "en", None), (44, long, "de", "s2")]
    rows += [(None, text(70), "en", "s1"), (None, f"{text(40)} {item} {text(40)}", "en", "s2"), (None, None, None, None)]
    rows = [(*r, len(r[1] or ""), f"x{n}", n, n % 2 == 0, "d", -1, None) for n, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _x string, n_words int, kept boolean, _doc string, shard int, `a.b` string"), item


def test_stages_with_odd_columns(spark, odd):
    from grafspan.llm import pipeline as p

    docs, item = odd
    given, before = {tuple(r) for r in docs.collect()}, None
    for name, function in p.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(function(spark, docs, DIR).collect(), docs.schema)
        assert docs.columns == before.columns
        rows = [tuple(r) for r in docs.collect()]
        assert set(rows) <= given, name  # every column as it was
        texts = {r[1] for r in rows}
        if name == "quality_rules":
            assert len(rows) == 36 and None not in texts and "" not in texts
        elif name == "near_dedup":
            assert len(rows) == 34 and sum(r[0] in (40, 41) for r in rows) == 1 and sum(r[0] is None for r in rows) == 2
        elif name == "benchmark_decontamination":
            assert len(rows) == 33 and not any(item in t for t in texts) and sum(r[0] is None for r in rows) == 1
        else:
            count = collections.Counter(rows)
            assert max(count.values()) <= 3 and len(count) >= 20
    got = p.balanced_shards(spark, docs, DIR).collect()
    assert len(got) == docs.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_without_rows(spark, odd, stage):
    from grafspan.llm import pipeline as p

    docs = odd[0].limit(0)
    out = p.STAGES[stage][1](spark, docs, DIR)
    assert out.count() == 0 and (stage == 4 or out.columns == docs.columns)
    # Rows without text or id alone.
    none = odd[0].where("text is null or text = ''")
    out = p.STAGES[stage][1](spark, none, DIR)
    assert out.count() == (0, 3, 3, 0, 3)[stage]


def test_pipeline(spark):
    from grafspan.llm import pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    step, left, seen = docs, set(rows), []
    for name, function in p.STAGES:
        out = function(spark, step, DIR)
        got = out.collect()
        if name != "balanced_shards":
            assert out.columns == docs.columns
        if name == "quality_rules":
            left = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
            assert {i for i in rows if len(WORD.findall(rows[i])) < 20}.isdisjoint(left)
        elif name == "near_dedup":
            left = {c for _, _, c in brute_components([(i, rows[i]) for i in sorted(left)], 5, 80)}
        elif name == "benchmark_decontamination":
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            assert not any(t in " ".join(rows[r["doc_id"]].split()) for r in got for t in items)
            left -= {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
        elif name == "source_mixing":
            count = collections.Counter(r["doc_id"] for r in got)
            assert set(count) <= left and max(count.values()) <= 3
            total = sum(len(WORD.findall(rows[i])) for i in left)
            assert abs(sum(len(WORD.findall(rows[i])) * n for i, n in count.items()) - total) < 0.1 * total
            left = set(count)
            seen = sorted(count.elements())
        else:
            assert sorted(r["doc_id"] for r in got) == seen
            by = collections.Counter(r["shard"] for r in got)
            assert max(by.values()) - min(by[s] for s in range(24)) <= 1
        assert {r["doc_id"] for r in got} == left, name
        step = spark.createDataFrame(got, out.schema)
    assert p.ORACLE_SQL is None
    assert QUERIES["pipeline"](spark, DIR).agg(F.count("*")).first()[0] == len(seen)
