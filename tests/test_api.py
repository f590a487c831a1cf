"""The five calls over an index built from a small source tree."""

import pytest

from grafspan import api
from tests.test_sources import JAVA


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    (at / "src" / "svc" / "p").mkdir(parents=True)
    (at / "src" / "svc" / "pom.xml").write_text("<project/>")
    (at / "src" / "svc" / "p" / "A.java").write_bytes(JAVA)
    assert api.init(spark, str(at / "src"), str(at / "index")) == 1
    with pytest.raises(FileExistsError):
        api.init(spark, str(at / "src"), str(at / "index"))
    found = api.Index.open(spark, str(at / "index"))
    object.__setattr__(found, "path", str(at / "index"))
    return found


def test_calls(index):
    assert index.resolve("p.Repo").status == "one"
    assert {r["fqn"] for r in index.search("find repo").rows} == {"p.Repo"}
    assert index.search("Zzyzxqwk").status == "not_in_project"
    found = index.find(where={"role": "CONTROLLER"}, detail="brief")
    assert [r["fqn"] for r in found.rows] == ["p.A"] and not found.truncated
    assert index.describe("p.A").rows[0]["edge_summary"]["INJECTS"]["out"] == 1
    a = index.resolve("p.A").rows[0]["id"]
    assert [r["edge_type"] for r in index.neighbors([a], ["DECLARES.EXPOSES"]).rows] == ["DECLARES.EXPOSES"] * 2
    assert {r["depth"] for r in index.callers("p.Repo#find(Long)").rows} == {1}
    assert [r["fqn"] for r in index.impact("p.Repo").rows] == ["p.A"]
    assert index.overview("svc").rows and index.status().rows[0]["types"] >= 4
    review = index.review("--- a/svc/p/A.java\n+++ b/svc/p/A.java\n@@ -13,1 +13,1 @@\n-x\n+y\n").rows[0]
    assert review["changed"] and review["band"] in ("low", "medium", "high")


def test_command_line(spark, index, capsys):
    import json

    from grafspan.__main__ import main

    assert main(["implementations", "Face", "--index", index.path], spark) == 0
    assert [r["fqn"] for r in json.loads(capsys.readouterr().out)["rows"]] == ["p.A"]
    assert main(["topics", "--index", index.path], spark) == 1
    assert json.loads(capsys.readouterr().out)["status"] == "empty"
    assert main(["meta", "--index", index.path], spark) == 0
    with pytest.raises(ValueError):
        main(["erase", "--index", index.path], spark)


def test_watch(spark, tmp_path):
    """A stream of changed files asks for one rebuild after a quiet gap."""
    import time

    from pyspark.sql import functions as F

    from grafspan.streaming import incremental

    at = tmp_path / "events"
    at.mkdir()
    (at / "1.json").write_text('{"path": "a/A.java", "ts": "2024-01-01T00:00:00Z"}\n{"path": "README.md", "ts": "2024-01-01T00:00:00Z"}\n{"path": "z/B.java", "ts": "2024-01-01T00:10:00Z"}\n')
    events = spark.readStream.schema("path string, ts timestamp").json(str(at)).select("path", F.col("ts"))
    asked = []
    q = incremental.watch(events, lambda _, kinds: asked.append(kinds), str(tmp_path / "state"))
    try:
        for _ in range(60):
            q.processAllAvailable()
            if asked:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    assert asked == [{"vectors", "graph"}]
