"""The registered queries and their SQL for DuckDB. Each applies library operators to whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys as K
from .functions import text as X
from .operators import aggregates, analytics, lookups, matching, ranking, retrieval, traversal
from .operators.filters import NodeFilter
from .sources import star
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SYMBOL_SQL = """
place AS (SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT * FROM customer JOIN place ON c_nationkey = n_nationkey),
symbol AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS id, 'package' AS kind, r_name AS name, r_name AS fqn, '' AS module, r_name AS microservice, '' AS role, '' AS parent_id, []::VARCHAR[] AS annotations, []::VARCHAR[] AS capabilities, []::VARCHAR[] AS modifiers, '' AS filename, 0::BIGINT AS start_line, 0::BIGINT AS end_line FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'interface', n_name, r_name || '.' || n_name, '', r_name, 'CONFIG', 'region:' || n_regionkey, [], [], [], '', 0, 0 FROM place
  UNION ALL SELECT 'customer:' || c_custkey, 'class', c_name, n_name || '.' || c_name, c_mktsegment, r_name,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'CONTROLLER' WHEN 'AUTOMOBILE' THEN 'SERVICE' WHEN 'MACHINERY' THEN 'COMPONENT' WHEN 'HOUSEHOLD' THEN 'REPOSITORY' WHEN 'FURNITURE' THEN 'CLIENT' ELSE 'OTHER' END, 'nation:' || c_nationkey, [], [], [], '', 0, 0 FROM cust
  UNION ALL SELECT 'supplier:' || s_suppkey, 'class', s_name, n_name || '.' || s_name, 'SUPPLY', r_name, 'ENTITY', 'nation:' || s_nationkey, [], [], [], '', 0, 0 FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'order:' || o_orderkey, 'method', 'Order' || o_orderkey, n_name || '.' || c_name || '#Order' || o_orderkey, c_mktsegment, r_name, '', 'customer:' || o_custkey, [], CASE WHEN o_orderkey % 11 = 0 THEN ['MESSAGE_LISTENER'] ELSE [] END, CASE WHEN o_orderstatus = 'F' THEN ['private'] ELSE [] END, 'src/c' || o_custkey || '.java', 1 + o_orderkey % 100 * 10, 10 + o_orderkey % 100 * 10
    FROM orders JOIN cust ON o_custkey = c_custkey
  UNION ALL SELECT 'part:' || p_partkey, 'record', p_name, p_brand || '.' || p_name, p_brand, '', 'OTHER', '', [p_brand, p_type], [p_type], [], '', 0, 0 FROM part),
declares AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders),
calls AS MATERIALIZED (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_linenumber::BIGINT AS line, l_suppkey AS byte, round(1 - l_discount, 6) AS confidence, l_returnflag AS strategy FROM lineitem
  UNION ALL SELECT 'order:' || o_orderkey, 'order:' || (o_orderkey // 3), 0, 0, 0.97, 'N' FROM orders WHERE o_orderkey % 2 = 0),
overrides AS (SELECT 'order:' || o_orderkey AS src, 'order:' || (o_orderkey // 2) AS dst FROM orders WHERE o_orderkey % 4 = 0),
extends AS (SELECT 'customer:' || c_custkey AS src, 'customer:' || (c_custkey // 10) AS dst FROM customer WHERE c_custkey >= 10),
supp AS (SELECT s_suppkey AS k, s_name, n_name, r_name FROM supplier JOIN place ON s_nationkey = n_nationkey),
route AS (
  SELECT 'route:' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'http_endpoint' ELSE 'kafka_topic' END AS kind, CASE WHEN c_custkey % 5 > 0 THEN 'kafka' WHEN c_custkey % 2 = 0 THEN 'spring_mvc' ELSE 'webflux' END AS framework,
    CASE WHEN c_custkey % 5 = 0 THEN 'GET' ELSE '' END AS method, CASE WHEN c_custkey % 5 = 0 THEN '/c/' || c_custkey ELSE '' END AS path, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 't' || c_custkey % 50 END AS topic, r_name AS microservice, c_mktsegment AS module
  FROM cust WHERE c_custkey % 5 < 2),
exposes AS (SELECT 'order:' || o_orderkey AS src, 'route:' || o_custkey AS dst FROM orders WHERE o_orderkey % 7 = 0 AND o_custkey % 5 < 2),
client AS (
  SELECT 'client:' || k AS id, CASE WHEN k % 2 = 0 THEN 'feign_method' ELSE 'rest_template' END AS client_kind, CASE WHEN k % 2 = 0 THEN r_name ELSE '' END AS target_service, '/c/' || (k * 5) AS path, 'GET' AS method, n_name || '.' || s_name AS member_fqn,
    'order:' || k AS member_id, r_name AS microservice FROM supp),
producer AS (SELECT 'producer:' || k AS id, 't' || k % 50 AS topic, n_name || '.' || s_name AS member_fqn, 'order:' || (k + 1) AS member_id, r_name AS microservice FROM supp WHERE k % 2 = 0),
declares_client AS (SELECT 'order:' || k AS src, 'client:' || k AS dst FROM supp),
declares_producer AS (SELECT 'order:' || (k + 1) AS src, 'producer:' || k AS dst FROM supp WHERE k % 2 = 0),
http_calls AS (SELECT 'client:' || k AS src, 'route:' || (k * 5) AS dst, round(0.5 + k % 5 / 10, 6) AS confidence, ['cross_service', 'intra_service', 'ambiguous'][k % 3 + 1] AS match FROM supp),
async_calls AS (SELECT 'producer:' || k AS src, 'route:' || (k * 5 + 1) AS dst, 0.75 AS confidence, ['cross_service', 'intra_service', 'ambiguous'][k % 3 + 1] AS match FROM supp WHERE k % 2 = 0),
site AS (SELECT 'site:' || l_orderkey || ':' || l_suppkey AS id, 'order:' || l_orderkey AS caller_id, l_linenumber::BIGINT AS line, l_suppkey AS byte, 'p' || l_partkey % 10 AS callee_simple, l_returnflag AS reason FROM lineitem WHERE l_linenumber = 7),
injects AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem),
implements AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer),
edges AS (SELECT 'DECLARES' AS edge_type, src, dst FROM declares UNION ALL SELECT 'CALLS', src, dst FROM calls UNION ALL SELECT 'INJECTS', src, dst FROM injects UNION ALL SELECT 'IMPLEMENTS', src, dst FROM implements
  UNION ALL SELECT 'OVERRIDES', src, dst FROM overrides UNION ALL SELECT 'EXTENDS', src, dst FROM extends UNION ALL SELECT 'EXPOSES', src, dst FROM exposes UNION ALL SELECT 'DECLARES_CLIENT', src, dst FROM declares_client
  UNION ALL SELECT 'DECLARES_PRODUCER', src, dst FROM declares_producer UNION ALL SELECT 'HTTP_CALLS', src, dst FROM http_calls UNION ALL SELECT 'ASYNC_CALLS', src, dst FROM async_calls)
"""


def query(sql: str | None = None, graph: bool = False):
    """Registers a function under its name, with its SQL; graph puts the star graph's tables before it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {SYMBOL_SQL}{',' if not sql.lstrip().upper().startswith('SELECT') else ''} {sql}" if graph else sql
        return f

    return register


# --- traversal ---


@query("""
seed AS (SELECT id FROM symbol WHERE name = 'red widget' AND kind = 'record'),
e AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE edge_type IN ('CALLS', 'DECLARES')),
d1 AS (SELECT DISTINCT e.dst AS id FROM e JOIN seed ON e.src = seed.id WHERE e.dst NOT IN (SELECT id FROM seed)),
d2 AS (SELECT DISTINCT e.dst AS id FROM e JOIN d1 ON e.src = d1.id WHERE e.dst NOT IN (SELECT id FROM seed UNION SELECT id FROM d1)),
d3 AS (SELECT DISTINCT e.dst AS id FROM e JOIN d2 ON e.src = d2.id WHERE e.dst NOT IN (SELECT id FROM seed UNION SELECT id FROM d1 UNION SELECT id FROM d2))
SELECT depth, kind, count(*)::BIGINT AS n FROM (SELECT 1 AS depth, id FROM d1 UNION ALL SELECT 2, id FROM d2 UNION ALL SELECT 3, id FROM d3) JOIN symbol USING (id) GROUP BY ALL
""", graph=True)
def impact_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who reaches the red widgets against CALLS and DECLARES, by depth and kind."""
    g = star.graph(spark, sf_dir)
    seeds = g.symbol.where("name = 'red widget' and kind = 'record'").select("id")
    found = traversal.reach(traversal.directed(g.all_edges(("CALLS", "DECLARES")), "in"), seeds, 3)
    return g.symbol.join(found, "id").groupBy("depth", "kind").agg(F.count("*").alias("n"))


@query("""
seed AS (SELECT id FROM symbol WHERE fqn = 'ASIA.NATION_2'),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges WHERE edge_type = 'DECLARES' UNION ALL SELECT dst, src FROM edges WHERE edge_type = 'DECLARES')),
d1 AS (SELECT DISTINCT e.dst AS id FROM e JOIN seed ON e.src = seed.id),
d2 AS (SELECT DISTINCT e.dst AS id FROM e JOIN d1 ON e.src = d1.id WHERE e.dst NOT IN (SELECT id FROM seed UNION SELECT id FROM d1))
SELECT id, fqn, depth FROM (SELECT id, 1 AS depth FROM d1 UNION ALL SELECT id, 2 FROM d2) JOIN symbol USING (id) ORDER BY depth, id LIMIT 500
""", graph=True)
def neighbors_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.neighbors_within(star.graph(spark, sf_dir), "ASIA.NATION_2", 2, ("DECLARES",), "both", limit=500).select("id", "fqn", "depth")


@query("""
e AS (SELECT src, dst, line, byte, confidence FROM calls WHERE confidence >= 0.95 AND src IN (SELECT id FROM symbol)),
seed AS (SELECT id FROM symbol WHERE name = 'small ring' AND module IN ('Brand#3', 'Brand#7')),
h1 AS (SELECT * FROM e WHERE dst IN (SELECT id FROM seed)),
h2 AS (SELECT * FROM e WHERE dst IN (SELECT src FROM h1) AND dst NOT IN (SELECT id FROM seed))
SELECT src, dst, line AS call_site_line, byte AS call_site_byte, min(d) AS depth, arg_min(confidence, d) AS confidence FROM (SELECT 1 AS d, * FROM h1 UNION ALL SELECT 2, * FROM h2) GROUP BY ALL ORDER BY 5, 1, 2, 3, 4 LIMIT 500
""", graph=True)
def callers_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    seeds = g.symbol.where("name = 'small ring' and module in ('Brand#3', 'Brand#7')").select("id")
    return traversal.walk_calls(g, seeds, "callers", 2, limit=500, min_confidence=0.95).select("src", "dst", "call_site_line", "call_site_byte", "depth", "confidence")


@query("""
e AS (SELECT src, dst, max(confidence) AS c FROM (SELECT src, dst, confidence FROM calls UNION ALL SELECT dst, src, confidence FROM calls) GROUP BY src, dst),
seed AS (SELECT 'order:1' AS id),
h1 AS (SELECT dst AS id, max(c) AS s FROM e JOIN seed ON src = seed.id GROUP BY dst),
h2 AS (SELECT dst AS id, max(least(s, c)) AS s FROM e JOIN h1 ON src = h1.id GROUP BY dst),
h3 AS (SELECT dst AS id, max(least(s, c)) AS s FROM e JOIN h2 ON src = h2.id GROUP BY dst)
SELECT id, round(max(s), 6) AS score, min(hop) AS hops FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) WHERE id <> 'order:1' GROUP BY id
""", graph=True)
def best_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    e = g.edge("CALLS").select("src", "dst", "confidence")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    seeds = spark.range(1).select(F.lit("order:1").alias("id"))
    return traversal.bottleneck(both, seeds, 3).select("id", F.round("score", 6).alias("score"), "hops")


# --- counts ---


@query("SELECT id, edge_type, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS id, edge_type, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, edge_type, 1, 0 FROM edges) GROUP BY id, edge_type", graph=True)
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.edge_counts(star.graph(spark, sf_dir))


@query("SELECT d.src AS origin, count(*)::BIGINT AS n, count(DISTINCT c.dst)::BIGINT AS targets FROM declares d JOIN calls c ON d.dst = c.src GROUP BY d.src", graph=True)
def member_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the members of each declaring type call: DECLARES, then CALLS."""
    g = star.graph(spark, sf_dir)
    two = lookups.walk(g, "DECLARES").select("origin", F.col("other").alias("src")).join(g.edge("CALLS").select("src", "dst"), "src")
    return two.groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("targets"))


@query("SELECT CASE WHEN microservice = '' THEN '(unscoped)' ELSE microservice END AS scope, kind, count(*)::BIGINT AS n FROM symbol WHERE kind IN ('class', 'interface', 'record') GROUP BY ALL", graph=True)
def map_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.map_of(star.graph(spark, sf_dir))


@query("SELECT module, count(*)::BIGINT AS n FROM symbol WHERE kind IN ('class', 'interface', 'record') GROUP BY module", graph=True)
def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.scope_counts(star.graph(spark, sf_dir), "module")


@query("SELECT 'role' AS what, role AS value, count(*)::BIGINT AS n FROM symbol WHERE kind IN ('class', 'interface', 'record') GROUP BY role UNION ALL SELECT 'framework', framework, count(*)::BIGINT FROM route GROUP BY framework", graph=True)
def conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.conventions(star.graph(spark, sf_dir))


@query("SELECT role AS value, count(*)::BIGINT AS n FROM symbol WHERE contains(lower(name), 'customer#0000000') GROUP BY role ORDER BY 2 DESC, 1 LIMIT 10", graph=True)
def tally_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.tally(star.graph(spark, sf_dir).symbol, "role", "Customer#0000000")


# --- lookups ---


@query("SELECT id, fqn, role FROM symbol WHERE kind <> 'package' AND role NOT IN ('OTHER', 'CONFIG') AND module = 'BUILDING' AND (microservice = 'ASIA') ORDER BY id LIMIT 50 OFFSET 10", graph=True)
def filtered_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"exclude_roles": ["OTHER", "CONFIG"], "module": "BUILDING", "microservice": "ASIA"}
    return lookups.find(star.graph(spark, sf_dir), "symbol", where, limit=50, offset=10).select("id", "fqn", "role")


@query("SELECT id, name, fqn FROM symbol WHERE list_contains(annotations, 'PROMO') AND module = 'Brand#3' ORDER BY id LIMIT 500", graph=True)
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_annotation(star.graph(spark, sf_dir), "PROMO", module="Brand#3", limit=500).select("id", "name", "fqn")


@query("SELECT id, fqn FROM symbol WHERE (contains(name, 'Supplier#0000000') OR contains(fqn, 'Supplier#0000000')) AND kind NOT IN ('file', 'package') ORDER BY fqn, id LIMIT 500", graph=True)
def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_name(star.graph(spark, sf_dir), "Supplier#0000000", mode="contains", limit=500).select("id", "fqn")


@query("SELECT DISTINCT s.id, s.fqn FROM implements i JOIN symbol s ON i.src = s.id JOIN symbol t ON i.dst = t.id WHERE t.name = 'NATION_7' ORDER BY s.fqn, s.id LIMIT 500", graph=True)
def implementors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.implementors(star.graph(spark, sf_dir), "NATION_7", limit=500).select("id", "fqn")


@query("SELECT s.id AS s_id, t.id AS t_id, t.name AS t_name FROM injects i JOIN symbol s ON i.src = s.id JOIN symbol t ON i.dst = t.id WHERE t.name = 'blue gear' ORDER BY 1, 2 LIMIT 500", graph=True)
def injectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.injectors(star.graph(spark, sf_dir), "blue gear", limit=500).select("s_id", "t_id", "t_name")


@query("""
SELECT src AS origin, dst AS other, min(line) AS call_site_line, count(*)::BIGINT AS call_site_count, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines
FROM calls WHERE confidence >= 0.92 AND strategy <> 'N' GROUP BY src, dst
""", graph=True)
def deduplicated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.filters import EdgeFilter

    g = star.graph(spark, sf_dir)
    e = EdgeFilter.of({"min_confidence": 0.92, "exclude_strategies": ["N"]}).column()
    out = lookups.dedup_call_edges(lookups.walk(g, "CALLS").where(e).select("origin", "other", "call_site_line", "call_site_byte", "confidence"))
    return out.select("origin", "other", "call_site_line", "call_site_count", F.array_join(F.transform("call_site_lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT c.line AS call_site_line, c.byte AS call_site_byte, s.id, s.name, c.confidence FROM calls c JOIN symbol s ON c.dst = s.id WHERE c.src = 'order:7' ORDER BY 1, 2, 3", graph=True)
def calls_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.calls_of(star.graph(spark, sf_dir), "order:7").select("call_site_line", "call_site_byte", "id", "name", "confidence")


@query("""
SELECT id, reason, score FROM (
  SELECT id, reason, round(1 - (row_number() OVER (ORDER BY p, s DESC, id) - 1) / count(*) OVER (), 6) AS score FROM (
    SELECT id, reason, p, s, row_number() OVER (PARTITION BY id ORDER BY p, s DESC) AS k FROM (
      SELECT id, 'exact_fqn' AS reason, 1 AS p, 10 AS s FROM symbol WHERE fqn = 'small ring'
      UNION ALL SELECT id, 'fqn_suffix', 8, length(fqn) FROM symbol WHERE fqn = 'small ring' OR ends_with(fqn, '.small ring')
      UNION ALL SELECT id, 'short_name', 12, 10 FROM symbol WHERE name = 'small ring')) WHERE k = 1) ORDER BY score DESC LIMIT 10
""", graph=True)
def resolved_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.resolved(star.graph(spark, sf_dir), "small ring").select("id", "reason", F.round("score", 6).alias("score"))


# --- joins ---


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*?([^./?#]+)(?:[/?#]|$)', 1) AS domain, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages),
r AS (SELECT DISTINCT domain, string_split(path, '/')[2] AS seg FROM p WHERE regexp_matches(path, '^/[a-z]+/[0-9]+')),
c AS (SELECT page_id, domain, path, page_id % 4 = 0 AS feign, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS verb FROM p),
m AS (SELECT page_id, count(*) AS n, min(r.domain) AS d FROM c JOIN r ON regexp_matches(path, '^/' || seg || '/[0-9]+/?$') AND verb = 'GET' AND (NOT feign OR c.domain = r.domain) AND (NOT feign OR path <> '') GROUP BY page_id)
SELECT c.page_id AS call_id, coalesce(m.n, 0)::BIGINT AS candidates,
       CASE WHEN coalesce(m.n, 0) = 0 THEN 'phantom' WHEN m.n > 1 THEN 'ambiguous' WHEN m.d = c.domain THEN 'intra_service' ELSE 'cross_service' END AS match,
       round(0.9 * CASE WHEN coalesce(m.n, 0) = 0 THEN 0.4 WHEN m.n > 1 THEN 0.5 WHEN m.d = c.domain THEN 0.6 ELSE 1.0 END, 6) AS confidence
FROM c LEFT JOIN m USING (page_id)
""")
def matched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as outgoing calls against route patterns."""
    out = matching.match_calls(star.outgoing(spark, sf_dir), star.routes(spark, sf_dir))
    return out.select("call_id", F.col("candidates").cast("long").alias("candidates"), "match", F.round(matching.match_confidence(F.lit(0.9), F.col("match"), F.col("microservice")), 6).alias("confidence"))


@query("""
SELECT a.l_orderkey AS orderkey, a.l_linenumber AS line_a, a.l_partkey AS part_a, b.l_linenumber AS line_b, b.l_partkey AS part_b FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <= b.l_linenumber + 1 AND a.l_linenumber + 1 >= b.l_linenumber AND a.l_partkey < b.l_partkey
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = star.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 1).alias("end_line"), "l_partkey")
    out = lookups.interface_overlap(li, li, on="l_orderkey").where("h.l_partkey < s.l_partkey")
    return out.select(F.col("h.l_orderkey").alias("orderkey"), F.col("h.start_line").alias("line_a"), F.col("h.l_partkey").alias("part_a"), F.col("s.start_line").alias("line_b"), F.col("s.l_partkey").alias("part_b"))


# --- retrieval ---


BM25_SQL = r"""
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t WHERE len(w) > 0),
tf AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS token FROM t) WHERE token IN ('the', 'ention', 'heitung', 'menteau') GROUP BY doc_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS s FROM tf JOIN df USING (token), n GROUP BY doc_id)
"""
TERMS = ["the", "ention", "heitung", "menteau"]


@query(f"WITH {BM25_SQL} SELECT doc_id, round(s, 6) AS bm25 FROM bm")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, words = star.table(spark, sf_dir, "documents"), retrieval.words(F.col("text"))
    return retrieval.bm25(retrieval.postings(docs, "doc_id", words), "doc_id", TERMS, retrieval.totals(docs, words)).select("doc_id", F.round("bm25", 6).alias("bm25"))


KNN_SQL = "SELECT vec_id, label, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings"


@query(f"SELECT vec_id, label, round(d, 6) AS distance, round(greatest(least(1 - d / 2, 1), 0), 6) AS score FROM ({KNN_SQL}) ORDER BY d, vec_id LIMIT 20")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return retrieval.knn(e, q, 20, key="vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round(X.display_score(F.col("distance")), 6).alias("score"))


@query(f"""
WITH {BM25_SQL},
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS r FROM ({KNN_SQL})),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM bm),
f AS (SELECT id, sum(1 / (60 + r)) AS rrf, count(*)::BIGINT AS lists FROM (SELECT * FROM v UNION ALL SELECT * FROM b) WHERE r <= 1000 GROUP BY id)
SELECT id, lists, round(rrf, 9) AS rrf, round(least(rrf / (2 / 61), 1), 6) AS score FROM f
""")
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the first 1000 of a vector list and of a BM25 list over the same ids."""
    e = star.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    near = e.select(F.col("vec_id").alias("id"), retrieval.l2(F.col("embedding"), F.array(*[F.lit(x) for x in q])).alias("o"))
    docs, words = star.table(spark, sf_dir, "documents"), retrieval.words(F.col("text"))
    text = retrieval.bm25(retrieval.postings(docs, "doc_id", words), "doc_id", TERMS, retrieval.totals(docs, words)).select(F.col("doc_id").alias("id"), (-F.col("bm25")).alias("o"))
    return ranking.rrf([near, text], ["id"], ["o", "id"]).select("id", "lists", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT q, q.label AS ql, b.vec_id, b.label, row_number() OVER (PARTITION BY q ORDER BY list_distance(q.e, b.embedding::DOUBLE[]), b.vec_id) AS r FROM q, embeddings b WHERE b.vec_id <> q),
s AS (SELECT q, count(*) AS rel, count(*) FILTER (r <= 5) AS h5, count(*) FILTER (r <= 10) AS h10, min(r) AS first FROM d WHERE ql = label GROUP BY q)
SELECT 'exact' AS config, round(avg(h5 / rel), 6) AS recall_5, round(avg(h10 / rel), 6) AS recall_10, round(avg(h5 / 5), 6) AS precision_5, round(avg(CASE WHEN first <= 20 THEN 1 / first ELSE 0 END), 6) AS mrr, count(*)::BIGINT AS queries FROM s
""")
def retrieval_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and reciprocal rank of exact search; vectors of one label are relevant to each other."""
    e = star.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.knn_join(e, q, 21, key="vec_id").where("query_id <> vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id")))["vec_id"].alias("retrieved"))
    labels = e.select("vec_id", "label")
    relevant = q.select(F.col("query_id")).join(labels.withColumnRenamed("vec_id", "query_id"), "query_id").join(labels, "label").where("query_id <> vec_id").groupBy("query_id").agg(F.collect_list("vec_id").alias("relevant"))
    out = ranking.evaluated(found.join(relevant, "query_id").withColumn("config", F.lit("exact")).withColumn("retrieved", F.slice("retrieved", 1, 20)), ["config"], (5, 10))
    return out.select("config", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "precision_5", "mrr")], "queries")


@query("""
WITH r AS (SELECT doc_id, lang, md5(text) AS k, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY md5(text)) - 1 AS c FROM documents)
SELECT doc_id, lang, c::BIGINT AS collapsed FROM r WHERE n = 1
""")
def first_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("k"))
    return ranking.first_of_each(docs, "k", [F.desc("n_chars"), "doc_id"]).select("doc_id", "lang", "collapsed")


@query("""
SELECT conv_id, turn, lag(md5(text)) OVER w AS previous, lead(md5(text)) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    return ranking.context(c, "conv_id", ["turn"], "h").select("conv_id", "turn", F.get("before", F.lit(0)).alias("previous"), F.get("after", F.lit(0)).alias("next"))


@query("""
WITH n AS (SELECT p_partkey, lower(p_name) AS v FROM part),
g AS (SELECT DISTINCT p_partkey, v, substr(v, i, 3) AS gram FROM (SELECT p_partkey, v, unnest(range(1, length(v) - 1)) AS i FROM n WHERE length(v) >= 3)),
q AS (SELECT DISTINCT substr('blue sprocket', i, 3) AS gram FROM (SELECT unnest(range(1, 12)) AS i))
SELECT p_partkey, v AS normalized, count(*)::BIGINT AS shared FROM g JOIN q USING (gram) GROUP BY p_partkey, v ORDER BY CASE WHEN v = 'blue sprocket' THEN 0 ELSE 1 END, 3 DESC, 2, 1 LIMIT 25
""")
def closest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.vocabulary(star.table(spark, sf_dir, "part"), "p_name", "p_partkey")
    return retrieval.closest(index, "blue sprocket", "p_partkey", 25)


@query()
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratcliff-Obershelp similarity of candidates; tested against difflib."""
    index = retrieval.vocabulary(star.table(spark, sf_dir, "part"), "p_name", "p_partkey")
    return retrieval.did_you_mean(index, "blu sprocet", "p_partkey", 10)


@query(graph=True)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical scores of symbols whose names share tokens with a query; tested against hand-computed values."""
    g = star.graph(spark, sf_dir)
    g = replace(g, symbol=g.symbol.withColumn("name", F.replace(F.initcap("name"), F.lit(" "), F.lit(""))))
    return retrieval.run_lexical(g, "red widget", NodeFilter(symbol_kind="record"), limit=100, dedup=False).select("id", "fqn", F.round("score", 6).alias("score"))


# --- scalars ---


@query(r"""
SELECT p_partkey, list_aggregate(list_filter(string_split(lower(regexp_replace(replace(p_name, ' ', ''), '([^_])([A-Z])', '\1_\2', 'g')), '_'), lambda x: x <> ''), 'string_agg', ' ') AS tokens,
       sha1('record|' || p_brand || '.' || p_name || '|part|0') AS id, p_name IN ('x') AS external FROM part
""")
def identifier_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star.table(spark, sf_dir, "part")
    fqn = F.concat_ws(".", "p_brand", "p_name")
    return p.select("p_partkey", F.array_join(X.split_identifier(F.replace("p_name", F.lit(" "), F.lit(""))), " ").alias("tokens"), K.symbol_id(F.lit("record"), fqn, F.lit("part"), F.lit(0)).alias("id"), X.is_external(fqn).alias("external"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN path = '' THEN '' ELSE '/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{}' ELSE s END), '/') END AS template FROM p
""")
def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star.page_paths(spark, sf_dir)
    return p.select("page_id", K.path_template(F.regexp_replace("path", r"(?<=/)[0-9]+(?=/|$)", "{page}")).alias("template"))


# --- increments and streams ---


@query("""
WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h
""")
def hash_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a file tree, made from documents: some removed, some added, some edited."""
    d = star.table(spark, sf_dir, "documents")
    old = incremental.hashes(d.where("doc_id % 10 <> 0"), "doc_id", F.col("text"))
    new = incremental.hashes(d.where("doc_id % 11 <> 0"), "doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return incremental.difference(old, new)


@query("""
WITH e AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT user_id, min(ts) AS first_event, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM s GROUP BY user_id, g
""")
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events with a quiet gap of 30 minutes, as the change watcher forms them."""
    e = star.table(spark, sf_dir, "events")
    return incremental.bursts(e, "ts", "event_type", "30 minutes", ["user_id"]).select("user_id", F.col("start").alias("first_event"), "n", F.array_join("kinds", ",").alias("kinds"))


@query("""
WITH j AS (SELECT l.doc_id, l.quality AS a, CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same, count(*) FILTER (a = 1) AS a1, count(*) FILTER (b = 1) AS b1 FROM j)
SELECT round((same / n - pe) / (1 - pe), 6) AS kappa FROM (SELECT *, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS pe FROM n)
""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 400).cast("int").alias("b"))
    return ranking.cohen_kappa(star.table(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "b").select(F.round("kappa", 6).alias("kappa"))


@query("SELECT source, lang, round(avg(n_chars), 6) AS mean, count(*)::BIGINT AS n FROM documents GROUP BY source, lang")
def means_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.condition_means(star.table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars").withColumn("mean", F.round("mean", 6))


@query("""
ids AS (SELECT * FROM symbol WHERE parent_id = 'customer:60' OR fqn = 'Brand#3.small ring'),
need AS (SELECT id AS cid, CASE WHEN kind = 'method' AND contains(fqn, '#') THEN string_split(fqn, '#')[1] ELSE fqn END AS needle FROM ids),
target AS (SELECT cid, s.id FROM need JOIN symbol s ON s.fqn = needle UNION SELECT cid, s.id FROM need JOIN symbol s ON s.name = needle),
dep AS (SELECT src, dst FROM edges WHERE edge_type IN ('INJECTS', 'IMPLEMENTS', 'EXTENDS')),
b1 AS (SELECT DISTINCT cid, src AS id FROM dep JOIN target ON dst = target.id),
b2 AS (SELECT DISTINCT cid, src AS id FROM dep JOIN b1 ON dst = b1.id),
blast AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT cid, id FROM b1 UNION ALL SELECT cid, id FROM b2)) JOIN symbol USING (id)),
seed AS (SELECT cid, m.id FROM (SELECT id AS cid, fqn FROM ids) JOIN symbol m USING (fqn) WHERE m.kind = 'method'
         UNION SELECT cid, m.id FROM (SELECT i.id AS cid, t.id AS tid FROM ids i JOIN symbol t USING (fqn) WHERE t.kind <> 'method') JOIN symbol m ON m.parent_id = tid WHERE m.kind = 'method'),
c1 AS (SELECT cid, src, dst, line, byte FROM calls JOIN seed ON dst = seed.id),
c2 AS (SELECT DISTINCT f.cid, calls.src, calls.dst, line, byte FROM calls JOIN (SELECT DISTINCT cid, src FROM c1 EXCEPT SELECT cid, id FROM seed) f ON calls.dst = f.src),
crossed AS (SELECT count(*) FILTER (a.microservice <> '' AND b.microservice <> '' AND a.microservice <> b.microservice) AS n FROM (SELECT DISTINCT * FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)) e JOIN symbol a ON a.id = e.src JOIN symbol b ON b.id = e.dst),
face AS (SELECT count(*) AS n FROM ids JOIN symbol t ON t.fqn = string_split(ids.fqn, '#')[1] AND t.kind = 'interface' WHERE ids.kind = 'method' AND NOT list_contains(ids.modifiers, 'private')),
shown AS (SELECT DISTINCT src, dst FROM exposes JOIN ids ON src = ids.id),
labels AS (SELECT count(DISTINCT CASE WHEN method || path <> '' THEN trim(method || ' ' || path) ELSE 'topic:' || topic END) AS n FROM shown JOIN route ON dst = route.id),
across AS (SELECT (SELECT count(*) FROM shown JOIN http_calls h ON h.dst = shown.dst AND h.match = 'cross_service' JOIN declares_client d ON d.dst = h.src) + (SELECT count(*) FROM shown JOIN async_calls h ON h.dst = shown.dst AND h.match = 'cross_service' JOIN declares_producer d ON d.dst = h.src) AS n),
f AS (SELECT blast.n AS blast, crossed.n AS cross_service, least(face.n, 1) AS interface, labels.n AS routes, across.n AS route_callers FROM blast, crossed, face, labels, across)
SELECT blast::BIGINT AS blast, cross_service::BIGINT AS cross_service, interface::BIGINT AS interface, routes::BIGINT AS routes, route_callers::BIGINT AS route_callers, score, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'medium' ELSE 'high' END AS band
FROM (SELECT *, round(least(0.4 * least(blast, 100) / 100 + 0.3 * least(cross_service, 20) / 20 + 0.2 * interface + 0.1 * least(routes, 5) / 5 + least(route_callers, 5) / 5, 1.0), 6) AS score FROM f)
""", graph=True)
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods of one type, and another type, as a change."""
    g = star.graph(spark, sf_dir)
    out = analytics.risk(g, g.symbol.where("parent_id = 'customer:60' or fqn = 'Brand#3.small ring'"))
    return out.withColumn("score", F.round("score", 6))


from . import catalog_graph  # noqa: E402, F401  (registers its queries here)
