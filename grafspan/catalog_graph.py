"""More queries over the star graph, with their SQL: lookups, walks, roll-ups, reports, changes and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .functions import keys as K
from .functions import text as X
from .operators import aggregates, analytics, lookups, ranking, traversal
from .sources import files, star
from .streaming import incremental

FIRST = "Customer#000000001"

# --- lookups ---


@query("SELECT DISTINCT s.id, s.fqn FROM extends e JOIN symbol s ON s.id = e.src JOIN symbol t ON t.id = e.dst WHERE t.name IN ('Customer#000000001') OR t.fqn = 'Customer#000000001' ORDER BY 2, 1 LIMIT 500", graph=True)
def subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.subclasses(star.graph(spark, sf_dir), FIRST, limit=500).select("id", "fqn")


@query("""
n AS (SELECT id FROM symbol WHERE name = 'Customer#000000012' OR fqn = 'Customer#000000012'),
e AS (SELECT 'EXTENDS' AS k, * FROM extends UNION ALL SELECT 'IMPLEMENTS', * FROM implements)
SELECT DISTINCT direction, edge_type, s.id, s.fqn, s.kind FROM (
  SELECT 'up' AS direction, k AS edge_type, dst AS id FROM e WHERE src IN (SELECT id FROM n) UNION ALL SELECT 'down', k, src FROM e WHERE dst IN (SELECT id FROM n)) JOIN symbol s USING (id) ORDER BY 1, 2, 4, 3 LIMIT 100
""", graph=True)
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.hierarchy(star.graph(spark, sf_dir), "Customer#000000012")


@query("SELECT DISTINCT s.id, s.fqn, 'out' AS way FROM overrides o JOIN symbol s ON s.id = o.dst JOIN symbol t ON t.id = o.src WHERE t.name = 'Order40' UNION SELECT DISTINCT s.id, s.fqn, 'in' FROM overrides o JOIN symbol s ON s.id = o.src JOIN symbol t ON t.id = o.dst WHERE t.name = 'Order40'", graph=True)
def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    both = lookups.overrides(g, "Order40").withColumn("way", F.lit("out")).unionByName(lookups.overridden_by(g, "Order40").withColumn("way", F.lit("in")))
    return both.select("id", "fqn", "way")


@query("SELECT DISTINCT s.id, s.fqn FROM injects i JOIN symbol s ON s.id = i.dst JOIN symbol t ON t.id = i.src WHERE t.name = 'Supplier#000000003' AND s.module = 'Brand#3' ORDER BY 2, 1 LIMIT 500", graph=True)
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.dependencies(star.graph(spark, sf_dir), "Supplier#000000003", module="Brand#3", limit=500).select("id", "fqn")


@query("SELECT id, fqn, 'role' AS how FROM (SELECT * FROM symbol WHERE role = 'REPOSITORY' AND microservice = 'ASIA' ORDER BY id LIMIT 500) UNION ALL SELECT id, fqn, 'capability' FROM (SELECT * FROM symbol WHERE list_contains(capabilities, 'MESSAGE_LISTENER') AND module = 'BUILDING' ORDER BY id LIMIT 500)", graph=True)
def by_role_or_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    roles, able = lookups.by_role(g, "REPOSITORY", microservice="ASIA", limit=500), lookups.by_capability(g, "MESSAGE_LISTENER", module="BUILDING", limit=500)
    return roles.withColumn("how", F.lit("role")).unionByName(able.withColumn("how", F.lit("capability"))).select("id", "fqn", "how")


@query("SELECT id, fqn FROM symbol WHERE kind IN ('class', 'interface', 'record') AND (list_contains(annotations, 'PROMO') OR list_contains(annotations, 'Brand#9'))", graph=True)
def types_of_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_framework(star.graph(spark, sf_dir), ("PROMO", "Brand#9")).select("id", "fqn")


@query("SELECT id, fqn, start_line FROM symbol WHERE filename = 'src/c7.java' AND kind NOT IN ('file', 'package') AND start_line <= 400 AND end_line >= 100", graph=True)
def symbols_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.in_file_range(star.graph(spark, sf_dir), "src/c7.java", 100, 400).select("id", "fqn", "start_line")


@query("SELECT id, fqn, start_line FROM symbol WHERE filename = 'src/c8.java' AND kind NOT IN ('file', 'package')", graph=True)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.outline(star.graph(spark, sf_dir), "src/c8.java").select("id", "fqn", "start_line")


@query("SELECT id, kind, path, topic FROM route WHERE microservice = 'EUROPE' AND (kind = 'kafka_topic' OR id IN (SELECT dst FROM exposes)) ORDER BY microservice, path, method, id LIMIT 500", graph=True)
def exposed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.routes(star.graph(spark, sf_dir), server_exposed=True, include_kafka=True, microservice="EUROPE", limit=500).select("id", "kind", "path", "topic")


@query("SELECT id, client_kind, path FROM client WHERE client_kind = 'feign_method' AND target_service = 'ASIA' ORDER BY microservice, client_kind, path, method, id LIMIT 500", graph=True)
def clients_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.clients(star.graph(spark, sf_dir), client_kind="feign_method", target_service="ASIA", limit=500).select("id", "client_kind", "path")


@query("SELECT id, topic, member_fqn FROM producer WHERE contains(topic, '2') ORDER BY microservice, topic, id LIMIT 500", graph=True)
def producers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.producers(star.graph(spark, sf_dir), topic_contains="2", limit=500).select("id", "topic", "member_fqn")


@query("SELECT id, framework, path FROM route WHERE framework = 'webflux' AND contains(path, '5') AND upper(method) = 'GET' ORDER BY id LIMIT 100 OFFSET 2", graph=True)
def find_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.find(star.graph(spark, sf_dir), "route", {"framework": "webflux", "path_contains": "5", "method": "get"}, limit=100, offset=2).select("id", "framework", "path")


@query("SELECT id, path, method FROM route WHERE path = '/c/15' AND method = 'GET' ORDER BY id LIMIT 1", graph=True)
def route_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    service = g.route.where("path = '/c/15'").first()["microservice"]
    return lookups.route_by_path(g, service, "/c/15", "GET").select("id", "path", "method")


@query("SELECT s.id, s.fqn, 1.0::DOUBLE AS confidence FROM exposes e JOIN symbol s ON s.id = e.src WHERE e.dst = 'route:25'", graph=True)
def route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.route_handlers(star.graph(spark, sf_dir), "route:25").select("id", "fqn", "confidence")


@query("""
on_ AS (SELECT DISTINCT src FROM exposes WHERE dst IN (SELECT id FROM route WHERE topic = 't6'))
SELECT id, fqn FROM symbol WHERE id IN (SELECT d.src FROM declares d JOIN on_ ON d.dst = on_.src)
""", graph=True)
def topic_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.topic_consumers(star.graph(spark, sf_dir), "t6").select("id", "fqn")


@query("SELECT id, fqn FROM symbol WHERE list_contains(capabilities, 'MESSAGE_LISTENER') ORDER BY fqn, id LIMIT 500", graph=True)
def listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.listeners(star.graph(spark, sf_dir), limit=500).select("id", "fqn")


@query("SELECT site.id, s.fqn AS caller_fqn, callee_simple, reason FROM site JOIN symbol s ON s.id = caller_id WHERE reason = 'R' AND s.microservice = 'AFRICA' AND callee_simple = 'p3' ORDER BY line, byte, site.id LIMIT 500", graph=True)
def unresolved_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.unresolved_sites(star.graph(spark, sf_dir), reason="R", microservice="AFRICA", callee="p3", limit=500).select("id", "caller_fqn", "callee_simple", "reason")


@query("""
w AS (
  SELECT 'CALLS' AS edge_type, src AS origin, dst AS other, line AS call_site_line FROM calls WHERE confidence >= 0.93
  UNION ALL SELECT 'CALLS', caller_id, id, line FROM site)
SELECT origin, edge_type, other, call_site_line FROM w WHERE origin IN ('order:7', 'order:12', 'order:30') ORDER BY 1, 2, 4, 3 LIMIT 500
""", graph=True)
def neighbors_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of some methods, sites without a target among them."""
    out = lookups.neighbors(star.graph(spark, sf_dir), ["order:7", "order:12", "order:30"], ["CALLS"], edge_where={"min_confidence": 0.93}, include_unresolved=True, limit=500)
    return out.select("origin", "edge_type", "other", "call_site_line")


@query("""
w AS (
  SELECT 'DECLARES.EXPOSES' AS edge_type, d.src AS origin, e.dst AS other FROM (SELECT DISTINCT * FROM declares) d JOIN exposes e ON d.dst = e.src
  UNION ALL SELECT 'DECLARES.DECLARES_CLIENT', d.src, e.dst FROM declares d JOIN declares_client e ON d.dst = e.src
  UNION ALL SELECT 'OVERRIDDEN_BY', dst, src FROM overrides)
SELECT * FROM w WHERE origin IN ('customer:5', 'customer:6', 'customer:10', 'order:6', 'order:40') ORDER BY origin, edge_type, other LIMIT 500
""", graph=True)
def composed_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, ids = star.graph(spark, sf_dir), ["customer:5", "customer:6", "customer:10", "order:6", "order:40"]
    return lookups.neighbors(g, ids, ["DECLARES.EXPOSES", "DECLARES.DECLARES_CLIENT", "OVERRIDDEN_BY"], limit=500).select("origin", "edge_type", "other")


# --- walks ---


@query("""
up AS (SELECT src AS sub, dst AS super, 1 AS hops FROM extends UNION ALL SELECT up.sub, e.dst, hops + 1 FROM up JOIN extends e ON up.super = e.src)
SELECT sub, super, min(hops) AS hops FROM up GROUP BY ALL
""", graph=True)
def supertypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of all types that extend another."""
    return traversal.ancestors(star.graph(spark, sf_dir).edge("EXTENDS").select("src", "dst"))


@query("""
e AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE edge_type IN ('INJECTS', 'IMPLEMENTS', 'EXTENDS')),
seed AS (SELECT id FROM symbol WHERE name = 'Customer#000000001'),
w AS (SELECT id, 0 AS d FROM seed UNION SELECT e.dst, d + 1 FROM w JOIN e ON e.src = w.id WHERE d < 3)
SELECT s.id, s.fqn, min(d) AS depth FROM w JOIN symbol s USING (id) WHERE s.microservice = 'ASIA' AND w.id NOT IN (SELECT id FROM seed) GROUP BY ALL ORDER BY 3, 1 LIMIT 500
""", graph=True)
def impact_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.impact(star.graph(spark, sf_dir), FIRST, 3, limit=500, microservice="ASIA").select("id", "fqn", "depth")


@query("""
seed AS (SELECT id FROM symbol WHERE name IN ('Customer#000000001', 'Customer#000000007') AND kind = 'class'),
e AS (SELECT src, dst FROM edges WHERE edge_type IN ('EXTENDS', 'IMPLEMENTS', 'INJECTS')),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed))
SELECT id, fqn, 1 AS depth FROM symbol WHERE id IN (SELECT id FROM h1) ORDER BY fqn, id LIMIT 500
""", graph=True)
def related_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    fqns = [r["fqn"] for r in g.symbol.where(F.col("name").isin(FIRST, "Customer#000000007")).collect()]
    return traversal.related_types(g, fqns, 1, limit=500).select("id", "fqn", "depth")


WALK_SQL = """
seed AS (SELECT id FROM symbol WHERE {seed}),
e AS (SELECT c.src, c.dst, c.line, c.byte, c.confidence FROM calls c JOIN symbol s ON s.id = c.{other}),
w AS (SELECT id, 0 AS d FROM seed UNION SELECT e.{other}, d + 1 FROM w JOIN e ON e.{at} = w.id WHERE d < {depth}),
l AS (SELECT id, min(d) AS d FROM w GROUP BY id)
SELECT src, dst, line AS call_site_line, byte AS call_site_byte, l.d + 1 AS depth, e.confidence FROM e JOIN l ON e.{at} = l.id WHERE l.d < {depth} ORDER BY 5, 1, 2, 3, 4 LIMIT 500
"""


@query(WALK_SQL.format(seed="name = 'Order5'", at="dst", other="src", depth=5), graph=True)
def callers_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of a method, and theirs, to depth 5."""
    return traversal.callers(star.graph(spark, sf_dir), "Order5", 5, limit=500).select("src", "dst", "call_site_line", "call_site_byte", "depth", "confidence")


@query(WALK_SQL.format(seed="parent_id = 'customer:9' AND kind = 'method'", at="src", other="dst", depth=9), graph=True)
def callees_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the methods of a type call, and what that calls, to depth 9."""
    return traversal.callees(star.graph(spark, sf_dir), "Customer#000000009", 9, limit=500).select("src", "dst", "call_site_line", "call_site_byte", "depth", "confidence")


@query("""
seed AS (SELECT m.id FROM symbol m JOIN symbol t ON m.parent_id = t.id WHERE t.name = 'Customer#000000009' AND m.kind = 'method'),
e AS (SELECT * FROM calls WHERE confidence >= 0.95),
h1 AS (SELECT dst AS id, max(confidence) AS s FROM e WHERE src IN (SELECT id FROM seed) GROUP BY dst),
h2 AS (SELECT dst AS id, max(least(s, confidence)) AS s FROM e JOIN h1 ON src = h1.id GROUP BY dst),
h AS (SELECT id, max(s) AS s, min(k) AS hops FROM (SELECT *, 1 AS k FROM h1 UNION ALL SELECT *, 2 FROM h2) WHERE id NOT IN (SELECT id FROM seed) GROUP BY id)
SELECT string_split(fqn, '#')[1] AS fqn, max(s) AS score, min(hops) AS hops FROM h JOIN symbol USING (id) WHERE string_split(fqn, '#')[1] NOT IN (SELECT fqn FROM symbol WHERE name = 'Customer#000000009') GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 50
""", graph=True)
def called_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    fqns = [r["fqn"] for r in g.symbol.where("name = 'Customer#000000009'").collect()]
    return traversal.expand_methods(g, fqns, 2, 0.95)


CALLERS_SQL = """
r AS (SELECT * FROM route WHERE id = 'route:{0}'),
b AS (
  SELECT src AS caller_id, confidence, 'http_edge' AS branch, 0 AS p FROM http_calls WHERE dst = 'route:{0}' UNION ALL SELECT src, confidence, 'async_edge', 1 FROM async_calls WHERE dst = 'route:{0}'
  UNION ALL SELECT c.id, 0.5, 'http_path', 2 FROM client c, r WHERE c.path <> '' AND c.path = r.path AND (c.target_service = '' OR c.target_service = r.microservice)
  UNION ALL SELECT q.id, 0.5, 'topic', 3 FROM producer q, r WHERE q.topic <> '' AND q.topic = r.topic),
one AS (SELECT caller_id, arg_min(confidence, p) AS confidence, arg_min(branch, p) AS branch FROM b GROUP BY caller_id)
"""


@query(f"{CALLERS_SQL.format(25)} SELECT caller_id, confidence::DOUBLE AS confidence, branch FROM one", graph=True)
def route_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.route_callers(star.graph(spark, sf_dir), "route:25").select("caller_id", F.round("confidence", 6).alias("confidence"), "branch")


@query(f"{CALLERS_SQL.format(56)} SELECT caller_id, confidence::DOUBLE AS confidence, branch FROM one", graph=True)
def topic_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.route_callers(star.graph(spark, sf_dir), "route:56").select("caller_id", F.round("confidence", 6).alias("confidence"), "branch")


@query(f"""
{CALLERS_SQL.format(25)},
inb AS (SELECT o.member_id AS id, confidence FROM one LEFT JOIN (SELECT id, member_id FROM client UNION ALL SELECT id, member_id FROM producer) o ON o.id = caller_id),
e AS (SELECT DISTINCT src, dst FROM calls),
bw AS (SELECT id, 0 AS d FROM (SELECT DISTINCT id FROM inb WHERE id IS NOT NULL) UNION SELECT e.src, d + 1 FROM bw JOIN e ON e.dst = bw.id WHERE d < 3),
ha AS (SELECT src AS id FROM exposes WHERE dst = 'route:25'),
fw AS (SELECT id, 0 AS d FROM ha UNION SELECT e.dst, d + 1 FROM fw JOIN e ON e.src = fw.id WHERE d < 3),
u AS (
  SELECT 'inbound' AS direction, id, 0 AS depth, confidence::DOUBLE AS confidence FROM inb UNION ALL SELECT 'origin', id, min(d), NULL FROM bw GROUP BY id HAVING min(d) > 0
  UNION ALL SELECT 'handler', id, 0, NULL FROM ha UNION ALL SELECT 'outbound', id, min(d), NULL FROM fw GROUP BY id HAVING min(d) > 0)
SELECT direction, u.id, s.fqn, depth, u.confidence FROM u LEFT JOIN symbol s ON s.id = u.id
""", graph=True)
def request_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.request_flow(star.graph(spark, sf_dir), "route:25").withColumn("confidence", F.round("confidence", 6))


# --- counts ---

COMPOSED_SQL = """
c AS (
  SELECT d.src AS origin, 'DECLARES.EXPOSES' AS edge_type, count(*) AS n FROM declares d JOIN exposes e ON d.dst = e.src GROUP BY 1
  UNION ALL SELECT d.src, 'DECLARES.DECLARES_CLIENT', count(*) FROM declares d JOIN declares_client e ON d.dst = e.src GROUP BY 1 UNION ALL SELECT d.src, 'DECLARES.DECLARES_PRODUCER', count(*) FROM declares d JOIN declares_producer e ON d.dst = e.src GROUP BY 1
  UNION ALL SELECT dst, 'OVERRIDDEN_BY', count(DISTINCT src) FROM overrides GROUP BY 1 UNION ALL SELECT o.dst, 'OVERRIDDEN_BY.EXPOSES', count(*) FROM overrides o JOIN exposes e ON o.src = e.src GROUP BY 1
  UNION ALL SELECT o.dst, 'OVERRIDDEN_BY.DECLARES_CLIENT', count(*) FROM overrides o JOIN declares_client e ON o.src = e.src GROUP BY 1
  UNION ALL SELECT o.dst, 'OVERRIDDEN_BY.DECLARES_PRODUCER', count(*) FROM overrides o JOIN declares_producer e ON o.src = e.src GROUP BY 1)
"""


@query(f"{COMPOSED_SQL} SELECT origin, edge_type, n::BIGINT AS n FROM c", graph=True)
def composed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.composed_counts(star.graph(spark, sf_dir))


@query(f"""
{COMPOSED_SQL},
s AS (SELECT id, edge_type, sum(i) AS i, sum(o) AS o FROM (SELECT src AS id, edge_type, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, edge_type, 1, 0 FROM edges) GROUP BY ALL)
SELECT id, edge_type, max(i)::BIGINT AS n_in, max(o)::BIGINT AS n_out FROM (SELECT * FROM s UNION ALL SELECT origin, edge_type, 0, n FROM c UNION ALL SELECT origin, 'OVERRIDES', n, 0 FROM c WHERE edge_type = 'OVERRIDDEN_BY') GROUP BY id, edge_type
""", graph=True)
def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.edge_summary(star.graph(spark, sf_dir))


@query("SELECT edge_type, count(*) FILTER (dst = 'order:12')::BIGINT AS n_in, count(*) FILTER (src = 'order:12')::BIGINT AS n_out FROM edges WHERE src = 'order:12' OR dst = 'order:12' GROUP BY edge_type", graph=True)
def edges_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.edge_counts_of(star.graph(spark, sf_dir), "order:12")


@query("SELECT microservice, count(*)::BIGINT AS n FROM symbol WHERE kind IN ('class', 'interface', 'record') GROUP BY microservice", graph=True)
def microservice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.scope_counts(star.graph(spark, sf_dir), "microservice")


@query("SELECT topic, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT member_fqn)), ',') AS members FROM producer GROUP BY topic", graph=True)
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.topics(star.graph(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query("SELECT coalesce(s.microservice, '') AS microservice, count(*)::BIGINT AS n FROM site LEFT JOIN symbol s ON s.id = caller_id GROUP BY 1", graph=True)
def unresolved_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.unresolved_stats(star.graph(spark, sf_dir), "microservice")


@query("SELECT reason, count(*)::BIGINT AS n FROM site GROUP BY 1", graph=True)
def unresolved_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.unresolved_stats(star.graph(spark, sf_dir), "reason")


@query("""
SELECT (SELECT count(*) FROM symbol)::BIGINT AS symbols, (SELECT count(*) FROM symbol WHERE kind IN ('class', 'interface', 'record'))::BIGINT AS types, (SELECT count(*) FROM symbol WHERE kind = 'method')::BIGINT AS members,
  (SELECT count(*) FROM edges WHERE edge_type = 'CALLS')::BIGINT AS n_calls, (SELECT count(*) FROM exposes)::BIGINT AS n_exposes, (SELECT round(avg((match IN ('cross_service', 'intra_service'))::INT), 6) FROM http_calls) AS http_calls_matched
""", graph=True)
def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.meta(star.graph(spark, sf_dir))
    return m.select("symbols", "types", "members", F.col("edge_counts")["CALLS"].alias("n_calls"), F.col("edge_counts")["EXPOSES"].alias("n_exposes"), F.round("http_calls_matched", 6).alias("http_calls_matched"))


@query("""
x AS (
  SELECT 'routes' AS section, trim(CASE WHEN method = '' THEN ' ' || path ELSE method || ' ' || path END) AS x FROM route WHERE microservice = 'ASIA' UNION ALL SELECT 'clients', target_service || ' ' || path FROM client WHERE microservice = 'ASIA'
  UNION ALL SELECT 'producers', topic FROM producer WHERE microservice = 'ASIA' UNION ALL SELECT 'entities', fqn FROM symbol WHERE microservice = 'ASIA' AND role = 'ENTITY'),
k AS (SELECT unnest(['routes', 'clients', 'producers', 'entities']) AS section)
SELECT section, count(x.x)::BIGINT AS n, coalesce(array_to_string(list_sort(list(DISTINCT trim(x.x)) FILTER (x.x IS NOT NULL))[1:5], ','), '') AS sample FROM k LEFT JOIN x USING (section) GROUP BY section
""", graph=True)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    return aggregates.overview(g, "ASIA", 100_000).select("section", "n", F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform("sample", lambda x: F.trim(x)))), 1, 5), ",").alias("sample"))


@query("""
t AS (SELECT * FROM symbol WHERE kind IN ('class', 'interface', 'record')),
m AS (SELECT 'module' AS what, module AS value, count(*)::BIGINT AS n FROM t GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5),
s AS (SELECT 'microservice' AS what, microservice AS value, count(*)::BIGINT AS n FROM t GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5),
r AS (SELECT 'role' AS what, role AS value, count(*)::BIGINT AS n FROM t GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
SELECT * FROM m UNION ALL SELECT * FROM s UNION ALL SELECT * FROM r
""", graph=True)
def vocabulary_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.vocabulary_context(star.graph(spark, sf_dir)).where("what <> 'token'")


# --- resolution, changes, increments ---


@query("""
f AS (
  SELECT id, 'route' AS node_kind, 'route_method_path' AS reason FROM route WHERE path = '/c/30' AND method = 'GET')
SELECT * FROM f
""", graph=True)
def resolved_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.resolved(star.graph(spark, sf_dir), "GET /c/30", "route").select("id", "node_kind", "reason")


@query("""
f AS (
  SELECT id, 'route' AS node_kind, 'route_topic' AS reason, 4 AS p, 2 AS s FROM route WHERE topic = 't6' UNION ALL SELECT id, 'producer', 'producer_topic', 7, 2 FROM producer WHERE topic = 't6'),
shown AS (SELECT DISTINCT dst AS id FROM exposes)
SELECT id, node_kind, reason FROM f WHERE node_kind = 'producer' OR id IN (SELECT id FROM shown) OR NOT EXISTS (SELECT 1 FROM f JOIN shown USING (id) WHERE node_kind = 'route') ORDER BY p, s DESC, id LIMIT 500
""", graph=True)
def resolved_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and producers of a topic; routes that nobody exposes stand back behind exposed ones of the same label."""
    return analytics.resolved(star.graph(spark, sf_dir), "t6", most=500).select("id", "node_kind", "reason")


@query("""
f AS (
  SELECT id, 'client_target' AS reason, 6 AS p FROM client WHERE target_service = 'EUROPE' UNION ALL SELECT id, 'exact_fqn', 1 FROM symbol WHERE fqn = 'EUROPE' UNION ALL SELECT id, 'short_name', 12 FROM symbol WHERE name = 'EUROPE')
SELECT id, arg_min(reason, p) AS reason FROM f GROUP BY id ORDER BY min(p), id LIMIT 500
""", graph=True)
def resolved_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.resolved(star.graph(spark, sf_dir), "EUROPE", most=500).select("id", "reason")


@query("""
h AS (SELECT 'src/c' || l_partkey % 97 || '.java' AS path, 1 + l_suppkey * 13 % 900 AS a, l_linenumber AS n FROM lineitem WHERE l_linenumber >= 5)
SELECT s.id, array_to_string(list_sort(list(DISTINCT x)), ',') AS lines FROM (SELECT s.id, unnest(range(greatest(a, start_line), least(a + n - 1, end_line) + 1)) AS x FROM h JOIN symbol s ON s.filename = h.path AND s.start_line <= a + n - 1 AND s.end_line >= a WHERE kind NOT IN ('file', 'package')) s GROUP BY s.id
""", graph=True)
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hunks of a diff."""
    c = F.col
    path, at, n = F.concat(F.lit("src/c"), c("l_partkey") % 97, F.lit(".java")), (1 + c("l_suppkey") * 13 % 900).cast("int"), c("l_linenumber").cast("int")
    hunks = star.table(spark, sf_dir, "lineitem").where("l_linenumber >= 5").select(path.alias("source_path"), path.alias("target_path"), at.alias("source_start"), n.alias("source_len"), at.alias("target_start"), n.alias("target_len"))
    return analytics.changed_symbols(star.graph(spark, sf_dir), hunks).select("id", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("""
ch AS (SELECT 'src/c' || c_custkey || '.java' AS filename FROM customer WHERE c_custkey % 40 = 3),
hit AS (SELECT id FROM symbol WHERE filename IN (SELECT filename FROM ch)),
into_ AS (SELECT DISTINCT src FROM edges WHERE edge_type IN ('EXTENDS', 'IMPLEMENTS', 'INJECTS', 'CALLS', 'OVERRIDES', 'DECLARES') AND dst IN (SELECT id FROM hit))
SELECT DISTINCT filename FROM symbol WHERE id IN (SELECT src FROM into_) AND filename <> '' AND filename NOT IN (SELECT filename FROM ch)
""", graph=True)
def dependent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = star.table(spark, sf_dir, "customer").where("c_custkey % 40 = 3").select(F.concat(F.lit("src/c"), "c_custkey", F.lit(".java")).alias("filename"))
    return incremental.dependents(star.graph(spark, sf_dir), changed)


# --- scalars ---


@query("""
SELECT p_partkey, sha1('class|__phantom.' || p_name || '|') AS phantom, 'r:' || left(sha1('kafka|kafka_topic||' || p_type || '|' || p_name || '|b|' || p_brand), 16) AS route, 'c:' || left(sha1(p_brand || '|' || p_name || '|feign|/x|GET'), 16) AS client,
  'p:' || left(sha1(p_brand || '|' || p_name || '|kafka|' || p_type), 16) AS producer, 'ucs:' || p_name || ':' || p_size || ':7' AS site, p_name || ':' || p_size || ':' || p_partkey AS chunk FROM part
""")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, lit = star.table(spark, sf_dir, "part"), F.col, F.lit
    return p.select("p_partkey", K.phantom_id(c("p_name")).alias("phantom"), K.route_id(lit("kafka"), lit("kafka_topic"), lit(""), c("p_type"), lit("raw"), c("p_name"), lit("b"), c("p_brand")).alias("route"),
                    K.client_id(c("p_brand"), c("p_name"), lit("feign"), lit("/x"), lit("GET")).alias("client"), K.producer_id(c("p_brand"), c("p_name"), lit("kafka"), c("p_type")).alias("producer"),
                    K.unresolved_id(c("p_name"), c("p_size"), lit(7)).alias("site"), K.chunk_id(c("p_name"), c("p_size"), c("p_partkey")).alias("chunk"))


@query("""
s AS (SELECT id, fqn, name FROM symbol)
SELECT id, list_extract(string_split(fqn, '.'), -1) AS simple, string_split(fqn, '#')[1] AS enclosing, regexp_matches(name, '^([A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*|[A-Z][A-Z0-9]*(_[A-Z0-9]+)+)$') AND length(name) BETWEEN 2 AND 200 AS shaped,
  lower(regexp_extract(name, '^[^<(#]*')) AS normalized, regexp_replace(name || '(3)', '\\(\\d+\\)$', '(?)') AS phantom, array_to_string(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1), ' ') AS camel FROM s
""", graph=True)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, name = star.graph(spark, sf_dir).symbol, F.col("name")
    return s.select("id", X.simple_name(F.col("fqn")).alias("simple"), X.enclosing_type(F.col("fqn")).alias("enclosing"), X.looks_like_identifier(name).alias("shaped"), X.normalize_name(name).alias("normalized"),
                    X.phantom_arity(F.concat(name, F.lit("(3)"))).alias("phantom"), F.array_join(X.camel_tokens(name), " ").alias("camel"))


@query("""
WITH w AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS d, ['CONTROLLER', 'SERVICE', 'COMPONENT', 'x'][label % 4 + 1] AS role FROM embeddings),
x AS (SELECT *, CASE role WHEN 'CONTROLLER' THEN 0.10 WHEN 'SERVICE' THEN 0.08 WHEN 'COMPONENT' THEN 0.03 ELSE 0 END AS rw, CASE WHEN vec_id % 7 = 0 THEN 0.08 ELSE 0 END AS pen FROM w)
SELECT vec_id, round(1 - d * d / 2, 6) AS cosine, round(d + pen - rw, 6) AS effective, round(greatest(least(1 - (d + pen - rw) / 2, 1), 0), 6) AS score FROM x
""")
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to one vector with penalties for imports and bonuses for roles."""
    from .operators import retrieval

    e = star.table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(x) for x in e.where("vec_id = 1").first()["embedding"]])
    role = F.element_at(F.array(*map(F.lit, ("CONTROLLER", "SERVICE", "COMPONENT", "x"))), (F.col("label") % 4 + 1).cast("int"))
    e = e.withColumn("d", retrieval.l2(F.col("embedding"), q))
    effective = X.effective_distance(F.col("d"), F.col("vec_id") % 7 == 0, X.role_weight(role), F.lit(0.0))
    return e.select("vec_id", F.round(X.l2_to_score(F.col("d")), 6).alias("cosine"), F.round(effective, 6).alias("effective"), F.round(X.display_score(effective), 6).alias("score"))


@query(r"""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 3 AND len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), 'import '))) >= 0.55 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS import_heavy,
  len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: regexp_matches(x, '[A-Z]'))))::BIGINT AS n_names FROM documents
""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.import_heavy(F.col("text")).alias("import_heavy"), F.size(ranking.names_in(F.col("text"))).cast("long").alias("n_names"))


@query("""
WITH f AS (SELECT o_custkey AS k, list(DISTINCT o_orderkey % 20) AS f, list(DISTINCT o_orderkey % 30) AS e FROM orders GROUP BY 1),
m AS (SELECT k, len(list_intersect(f, e)) / len(f) AS p, len(list_intersect(f, e)) / len(e) AS r, len(list_intersect(f, e)) / len(list_distinct(list_concat(f, e))) AS j, list_sort(f) = list_sort(e) AS same FROM f)
SELECT k, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN same THEN 1 ELSE j END, 6) AS path FROM m
""")
def graded_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found and expected sets by customer."""
    o = star.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_set(F.col("o_orderkey") % 20)).alias("f"), F.sort_array(F.collect_set(F.col("o_orderkey") % 30)).alias("e"))
    s = ranking.set_match(F.col("f"), F.col("e"))
    return o.select("k", *[F.round(v, 6).alias(n) for n, v in s.items()], F.round(ranking.path_match(F.col("f"), F.col("e")), 6).alias("path"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN path = '' THEN '/api' ELSE '/api/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') END AS composed,
  CASE WHEN starts_with(path, '/') AND NOT regexp_matches(path, '\s') THEN 'GET' END AS method FROM p WHERE len(list_filter(string_split(path, '/'), lambda s: s <> '')) > 0
""")
def composed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star.page_paths(spark, sf_dir).where(F.size(F.filter(F.split("path", "/"), lambda s: s != "")) > 0)
    return p.select("page_id", K.compose_paths(F.lit("/api/"), F.col("path")).alias("composed"), K.route_method(F.concat(F.lit("get "), "path"))["method"].alias("method"))


@query(r"""
WITH p AS (SELECT page_id, ltrim(regexp_extract(url, '://([^?#]*)', 1), '/') AS path FROM pages)
SELECT page_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS microservice FROM p
""")
def owners_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as files of a tree without build files: the first folder is the service."""
    p = star.table(spark, sf_dir, "pages").select("page_id", F.ltrim(F.regexp_extract("url", r"://([^?#]*)", 1), F.lit("/")).alias("filename"))
    own = files.owners(p.select("filename").distinct(), spark.createDataFrame([], "path string")).select("filename", "microservice")
    return p.join(own, "filename").select("page_id", "microservice")
