"""Operators on small literal inputs with hand-computed results."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from grafspan.functions import keys as K
from grafspan.functions import text as X
from grafspan.graph import CodeGraph, Store, single_writer
from grafspan.operators import aggregates, analytics, lookups, matching, ranking, retrieval, traversal
from grafspan.operators.filters import EdgeFilter, NodeFilter
from grafspan.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def diamond(spark):
    """A controller that injects a service, which injects two repositories; a -> b, c -> d with a cycle back."""
    symbols = [("A", "class", "A", "p.A", "CONTROLLER", "s1", ""), ("B", "class", "B", "p.B", "SERVICE", "s1", ""), ("C", "class", "C", "p.C", "REPOSITORY", "s1", ""), ("D", "class", "D", "p.D", "REPOSITORY", "s2", ""), ("I", "interface", "I", "p.I", "OTHER", "s1", "")]
    symbols += [(f"{t.lower()}1", "method", f"{t.lower()}1", f"p.{t}#{t.lower()}1()", "", "s2" if t == "D" else "s1", t) for t in "ABCD"]
    s = spark.createDataFrame(symbols, "id string, kind string, name string, fqn string, role string, microservice string, parent_id string").withColumns({"resolved": F.lit(True), "signature": F.concat("name", F.lit("()")), "filename": F.lit("F.java"), "start_line": F.monotonically_increasing_id() * 0 + 1, "end_line": F.lit(10).cast("long")})
    e = lambda rows, ddl="src string, dst string": spark.createDataFrame(rows, ddl)
    calls = e([("a1", "b1", 1, 10, 0.9, "x"), ("a1", "c1", 2, 20, 0.5, "x"), ("b1", "d1", 3, 30, 0.8, "y"), ("c1", "d1", 4, 40, 0.95, "y"), ("d1", "a1", 5, 50, 1.0, "y"), ("a1", "b1", 7, 70, 0.9, "x")], "src string, dst string, call_site_line long, call_site_byte long, confidence double, strategy string")
    edges = {"CALLS": calls, "INJECTS": e([("A", "B"), ("B", "C"), ("B", "D")]), "IMPLEMENTS": e([("B", "I")]), "DECLARES": e([(t, f"{t.lower()}1") for t in "ABCD"]), "EXPOSES": e([("a1", "r1")])}
    route = spark.createDataFrame([("r1", "http_endpoint", "GET", "/x/{id}", "/x/{}", "s1"), ("r2", "http_endpoint", "GET", "/y", "/y", "s1")], "id string, kind string, method string, path string, path_template string, microservice string")
    client = spark.createDataFrame([("c:1", "rest", "s1", "/x/{}", "/x/{}", "GET", "d1")], "id string, client_kind string, target_service string, path string, path_template string, method string, member_id string")
    return CodeGraph.of(spark, s, edges, route=route, client=client)


def test_identifiers(spark):
    assert one(spark, X.split_identifier(F.lit("HTTPClient"))) == ["h", "t", "t", "p", "client"]
    assert one(spark, X.split_identifier(F.lit("get_userName"))) == ["get", "user", "name"]
    assert one(spark, X.camel_tokens(F.lit("HTTPClientPool"))) == ["http", "client", "pool"]
    assert one(spark, X.query_tokens(F.lit("How does the JoinOperator work?"))) == ["joinoperator", "work"]
    assert one(spark, X.search_tokens(F.lit("DistributionChunk chunk x"))) == ["distribution", "chunk"]
    assert one(spark, X.qgrams(F.lit("ab"))) == ["ab"]
    assert one(spark, X.qgrams(F.lit("abcd"))) == ["abc", "bcd"]
    assert one(spark, X.qgrams(F.lit(""))) == []
    assert one(spark, X.looks_like_identifier(F.lit("FooBar"))) and not one(spark, X.looks_like_identifier(F.lit("how to")))
    assert one(spark, X.is_external(F.lit("java.util.List#add(E)")))
    assert one(spark, X.normalize_name(F.lit("Foo<T>#bar(X)"))) == "foo"


def test_paths(spark):
    assert one(spark, K.path_template(F.lit("api/users/{id:\\d+}/"))) == "/api/users/{}"
    assert one(spark, K.path_regex(F.lit("/api/users/{id:\\d+}"))) == "^/api/users/\\d+/?$"
    assert one(spark, K.path_regex(F.lit("/a.b/{x}"))) == "^/a\\.b/[^/]+/?$"
    assert one(spark, K.path_template(F.lit(""))) == "" and one(spark, K.path_template(F.lit("/"))) == "/"
    assert one(spark, K.compose_paths(F.lit("/api/"), F.lit("x"))) == "/api/x"


def test_scores(spark):
    assert one(spark, X.l2_to_score(F.lit(1.0))) == 0.5
    assert one(spark, X.role_weight(F.lit("controller"))) == 0.10 and one(spark, X.role_weight(F.lit(None).cast("string"))) == 0.0
    bonus = X.symbol_bonus(F.array(F.lit("processOrder(Order)"), F.lit("x()")), F.lit("p.OrderService"), F.array(F.lit("order")))
    assert one(spark, bonus) == pytest.approx(0.03 + 0.02 + 0.05)
    assert one(spark, X.import_heavy(F.lit("import a;\nimport b;\nimport c;\nx")))


def test_metrics(spark):
    r, e = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bd"))
    assert one(spark, ranking.recall_at(r, e, 3)) == 0.5 and one(spark, ranking.recall_at(r, e, 1)) == 0.0
    assert one(spark, ranking.recall_at(r, X.empty(), 3)) == 0.0
    assert one(spark, ranking.reciprocal_rank(r, e)) == 0.5
    assert one(spark, ranking.path_match(r, r)) == 1.0
    assert one(spark, ranking.set_match(r, e)["f1"]) == pytest.approx(0.4)
    assert one(spark, ranking.names_in(F.lit("see FooBar and foo, FooBar or X1"))) == ["FooBar", "X1"]
    pairs = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "a int, b int")
    assert ranking.cohen_kappa(pairs, "a", "b").first()["kappa"] == pytest.approx(0.5)


def test_fusion(spark):
    a = spark.createDataFrame([("f", 1), ("g", 2)], "k string, o int")
    b = spark.createDataFrame([("g", 1), ("h", 2)], "k string, o int")
    got = {r["k"]: r["rrf"] for r in ranking.rrf([a, b], ["k"], ["o"]).collect()}
    assert got == pytest.approx({"f": 1 / 61, "g": 1 / 62 + 1 / 61, "h": 1 / 62})


def test_filters(spark):
    s = spark.createDataFrame([("1", None), ("2", "DTO"), ("3", "SERVICE")], "id string, role string")
    assert {r["id"] for r in s.where(NodeFilter.of({"exclude_roles": ["DTO"]}).column()).collect()} == {"1", "3"}
    with pytest.raises(ValueError):
        NodeFilter.of({"nonsense": 1})
    with pytest.raises(ValueError):
        NodeFilter(role="X").column("route")
    with pytest.raises(ValueError):
        EdgeFilter(include_strategies=("a",), exclude_strategies=("b",))


def test_traversal(diamond):
    g = diamond
    seeds = g.symbol.where("id = 'd1'").select("id")
    got = {r["id"]: r["depth"] for r in traversal.reach(traversal.directed(g.edge("CALLS"), "in"), seeds, 5).collect()}
    assert got == {"b1": 1, "c1": 1, "a1": 2}
    best = {r["id"]: (r["score"], r["hops"]) for r in traversal.bottleneck(g.edge("CALLS"), g.symbol.where("id = 'a1'").select("id"), 2).collect()}
    assert best == {"b1": (0.9, 1), "c1": (0.5, 1), "d1": (0.8, 2)}
    edges = traversal.callers(g, "p.D#d1()", depth=2).collect()
    assert [(r["src"], r["dst"], r["depth"]) for r in edges] == [("b1", "d1", 1), ("c1", "d1", 1), ("a1", "b1", 2), ("a1", "b1", 2), ("a1", "c1", 2)]
    assert {r["fqn"]: r["depth"] for r in traversal.impact(g, "p.D", 3).collect()} == {"p.B": 1, "p.A": 2}
    flow = {r["fqn"]: r["stage"] for r in traversal.trace_flow(g, ["p.A"], depth=2).collect()}
    assert flow == {"p.A": "seed", "p.B": "service", "p.C": "data", "p.D": "data"}
    assert {(r["direction"], r["id"]) for r in traversal.request_flow(g, "r1", 1).collect()} >= {("inbound", "d1"), ("handler", "a1"), ("origin", "b1"), ("outbound", "b1")}


def test_lookups(diamond):
    g = diamond
    assert [r["fqn"] for r in lookups.implementors(g, "I").collect()] == ["p.B"]
    assert [r["id"] for r in lookups.routes(g, server_exposed=True).collect()] == ["r1"]
    calls = lookups.neighbors(g, ["a1"], ["CALLS"], dedup_calls=True).collect()
    assert [(r["other"], r["call_site_count"], r["call_site_lines"]) for r in calls] == [("b1", 2, [1, 7]), ("c1", 1, [2])]
    composed = lookups.neighbors(g, ["A"], ["DECLARES.EXPOSES"]).collect()
    assert [r["other"] for r in composed] == ["r1"]
    assert lookups.by_name_or_wider(g, "p.").count() == 9
    with pytest.raises(ValueError):
        lookups.neighbors(g, ["a1"], ["DECLARES"], edge_where={"min_confidence": 0.5})


def test_summaries_and_resolution(diamond):
    g = diamond
    counts = {(r["id"], r["edge_type"]): (r["n_in"], r["n_out"]) for r in aggregates.edge_counts(g).collect()}
    assert counts[("a1", "CALLS")] == (1, 3) and counts[("B", "INJECTS")] == (1, 2)
    assert analytics.resolve(g, "p.B").status == "one"
    assert analytics.resolve(g, "nothing").status == "none"
    assert analytics.resolve(g, "GET /x/{id}").rows[0]["reason"] == "route_method_path"
    d = analytics.describe(g, "A").rows[0]
    assert d["edge_summary"]["INJECTS"] == {"in": 0, "out": 1} and d["edge_summary"]["DECLARES.EXPOSES"]["out"] == 1
    assert analytics.diagnose(g, "java.util.List").status == "external"
    assert analytics.diagnose(g, "Zzyzxqwk").status == "not_in_project"
    hunks = g.spark.createDataFrame([("F.java", "F.java", 1, 2, 1, 3)], "source_path string, target_path string, source_start int, source_len int, target_start int, target_len int")
    changed = analytics.changed_symbols(g, hunks)
    assert changed.count() == 9 and changed.first()["lines"] == [1, 2, 3]
    risk = analytics.risk(g, g.symbol.where("id = 'd1'")).first()
    # B and A depend on D; two calls of d1 come from another service.
    assert (risk["blast"], risk["cross_service"], risk["interface"], risk["routes"], risk["route_callers"], risk["band"]) == (2, 2, 0, 0, 0, "low")
    assert risk["score"] == pytest.approx(0.4 * 2 / 100 + 0.3 * 2 / 20)


@pytest.mark.parametrize(("calls", "score"), [(0, 0.02), (1, 0.22), (6, 1.0)])
def test_risk_of_a_route_with_callers_elsewhere(spark, diamond, calls, score):
    """One call from another service adds 0.2; the sum stops at 1."""
    g = diamond
    ends = [(f"c:{i}", "r1", "cross_service") for i in range(calls)] + [("c:9", "r1", "intra_service")]
    g = g.with_edges(HTTP_CALLS=spark.createDataFrame(ends, "src string, dst string, match string"), DECLARES_CLIENT=spark.createDataFrame([("d1", f"c:{i}") for i in range(10)], "src string, dst string"))
    g = replace(g, symbol=g.symbol.where("id = 'a1'"))  # nothing else depends on it
    risk = analytics.risk(g, g.symbol).first()
    assert risk["route_callers"] == calls and risk["routes"] == 1 and risk["score"] == pytest.approx(score)


def test_walks_have_no_deepest_level(spark):
    from grafspan.operators import traversal

    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0.9) for i in range(14)], "src string, dst string, confidence double")
    seeds = spark.createDataFrame([("n0",)], "id string")
    assert {r["id"]: r["depth"] for r in traversal.reach(chain, seeds, 12).collect()} == {f"n{i}": i for i in range(1, 13)}
    assert traversal.reach(chain, seeds, 40).count() == 14 and traversal.bottleneck(chain, seeds, 11).count() == 11
    assert traversal.ancestors(chain).count() == 14 * 15 // 2 and traversal.ancestors(chain, 2).count() == 14 + 13


def test_knn_join_takes_blocks(spark):
    from grafspan.operators import retrieval

    v = spark.range(300).select(F.col("id"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 5)]).alias("embedding"))
    q = v.select(F.col("id").alias("query_id"), "embedding")
    rows = lambda most: sorted((r["query_id"], r["rank"], r["id"]) for r in retrieval.knn_join(v, q, 3, most=most).collect())
    assert rows(50) == rows(1000) and len(rows(50)) == 900


def test_first_of_each_with_a_hot_key(spark):
    from grafspan.operators import ranking

    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("o"))
    got = {r["k"]: (r["id"], r["collapsed"]) for r in ranking.first_of_each(df, "k", [F.desc("o"), "id"]).collect()}
    rows = [tuple(r) for r in df.collect()]
    assert len(got) == 501 and got[-1] == (min((-o, i) for k, i, o in rows if k == -1)[1], 4499) and got[20] == (20, 0)


@pytest.mark.parametrize(("call", "outcome"), [
    (("rest", "http", "", "/x/1", "GET", "", "", True, "other"), "cross_service"),
    (("rest", "http", "", "/x/1", "GET", "", "", True, "s1"), "intra_service"),
    (("rest", "http", "", "/both", "GET", "", "", True, "s1"), "ambiguous"),
    (("rest", "http", "", "/none/1/2", "GET", "", "", True, "s1"), "phantom"),
    (("rest", "http", "", "", "", "", "", False, "s1"), "unresolved"),
    (("kafka", "async", "", "", "", "t", "kafka", True, "s2"), "cross_service"),
    (("feign_method", "http", "named", "", "", "", "", True, "s9"), "cross_service"),
])
def test_matching(spark, call, outcome):
    calls = spark.createDataFrame([call], "client_kind string, channel string, feign_target_name string, path_template_call string, method_call string, topic_call string, broker_call string, resolved boolean, microservice string")
    rows = [("1", "http_endpoint", "GET", "^/x/[^/]+/?$", "/x/{}", "s1", "", "", ""), ("2", "http_endpoint", "", "^/both/?$", "/both", "s1", "", "", ""), ("3", "http_endpoint", "GET", "^/both/?$", "/both", "s2", "", "", ""), ("4", "kafka_topic", "", "", "", "s1", "t", "kafka", ""), ("5", "http_endpoint", "", "", "", "s1", "", "", "named")]
    routes = spark.createDataFrame(rows, "id string, kind string, method string, path_regex string, path_template string, microservice string, topic string, broker string, feign_name string")
    assert matching.match_calls(calls, routes).first()["match"] == outcome


def test_vocabulary(spark):
    names = spark.createDataFrame([(1, "OrderService"), (2, "OrderServer"), (3, "Xyz")], "id int, name string")
    index = retrieval.vocabulary(names)
    assert [r["id"] for r in retrieval.closest(index, "orderservice").collect()][0] == 1
    assert retrieval.did_you_mean(index, "qqq").count() == 3


def test_increment_and_store(spark, diamond, tmp_path):
    old = incremental.hashes(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string"))
    new = incremental.hashes(spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "3")], "path string, content string"))
    assert {tuple(r) for r in incremental.difference(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    store = Store(spark, str(tmp_path / "index"))
    assert not store.exists()
    assert store.write(diamond) == 1 and store.write(diamond) == 2
    assert store.read(1).symbol.count() == diamond.symbol.count()
    with pytest.raises(ValueError):
        store.erase()
    with single_writer(tmp_path / "index"), pytest.raises(RuntimeError), single_writer(tmp_path / "index"):
        pass


def test_bursts(spark):
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:01", "b"), (1, "2024-01-01 00:01:00", "a")]
    e = spark.createDataFrame(rows, "u int, t string, k string").withColumn("t", F.to_timestamp("t"))
    assert [(r["n"], r["kinds"]) for r in incremental.bursts(e, "t", "k", "5 seconds", ["u"]).orderBy("start").collect()] == [(2, ["a", "b"]), (1, ["a"])]
    kinds = spark.createDataFrame([("x/A.java",), ("src/main/resources/application-dev.yml",), ("README.md",)], "p string").select(incremental.kinds_of(F.col("p")).alias("k")).collect()
    assert [r["k"] for r in kinds] == [["vectors", "graph"], ["vectors"], []]
