"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from grafspan import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def same(got, expected):
    cols = sorted(got.columns)
    assert cols == sorted(expected.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, expected))
    assert len(a) == len(b)
    assert (a == b).all().all(), a[(a != b).any(axis=1)].head(3).to_string() + "\n" + b[(a != b).any(axis=1)].head(3).to_string()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLES:
        same(got, duck.execute(catalog.ORACLES[name]).df())


def test_did_you_mean_is_difflib(spark):
    from difflib import SequenceMatcher

    got = catalog.QUERIES["did_you_mean"](spark, DIR).toPandas()
    for r in got.itertuples():
        assert r.similarity == pytest.approx(SequenceMatcher(None, "blu sprocet", r.normalized).ratio())
    assert got.similarity.is_monotonic_decreasing


def test_entry_survives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "grafspan", tmp_path / "grafspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact_by_depth' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
