"""Traversals as joins, one for a level. Frontiers are distinct, written at each level, and a walk ends when one is empty."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import shared_dir
from ..functions import text as X
from ..graph import CodeGraph
from .lookups import clamp, page

def _cut(df: DataFrame) -> DataFrame:
    """Ends lineage in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) in one direction or both."""
    e = edges.select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": e, "in": back, "both": e.unionByName(back)}[direction]


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes within 1 to depth hops of the seeds (column id), at their least depth; no seed is among them.

    The last level's nodes are joined with the edges, and what was seen before is taken away by
    an anti join, so that a popular node is walked once.
    """
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        step = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = _cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(front)
        if level < depth and front.isEmpty():
            break
    return seen.where("depth > 0")


def neighbors_within(g: CodeGraph, needle: str, depth: int, edge_types: tuple[str, ...], direction: str = "both", limit: int = 100) -> DataFrame:
    """Symbols within some hops of those with that name or fqn."""
    seeds = g.symbol.where((F.col("fqn") == needle) | (F.col("name") == needle)).select("id")
    found = reach(directed(g.all_edges(edge_types), direction), seeds, depth)
    return page(g.symbol.join(found, "id"), ["depth", "id"], clamp(limit))


def impact(g: CodeGraph, needle: str, depth: int = 3, limit: int = 100, microservice: str | None = None) -> DataFrame:
    """What depends on a symbol, against INJECTS, IMPLEMENTS and EXTENDS; a scope is applied before the limit."""
    seeds = g.symbol.where((F.col("fqn") == needle) | (F.col("name") == needle)).select("id")
    out = g.symbol.join(reach(directed(g.all_edges(("INJECTS", "IMPLEMENTS", "EXTENDS")), "in"), seeds, depth), "id")
    if microservice:
        out = out.where(F.col("microservice") == microservice)
    return page(out, ["depth", "id"], clamp(limit))


def related_types(g: CodeGraph, fqns: list[str], depth: int = 1, edge_types: tuple[str, ...] = ("EXTENDS", "IMPLEMENTS", "INJECTS"), limit: int = 100) -> DataFrame:
    seeds = g.symbol.where(F.col("fqn").isin(*fqns)).select("id")
    return page(g.symbol.where("resolved").join(reach(directed(g.all_edges(edge_types), "both"), seeds, depth), "id"), ["depth", "fqn", "id"], clamp(limit))


def method_ids(g: CodeGraph, needle: str, limit: int = 50) -> DataFrame:
    """Methods that a needle means: by fqn (or with unknown arity), else members of that type, else by name."""
    members = g.symbol.where(F.col("kind").isin("method", "constructor"))
    alt = g.spark.range(1).select(X.phantom_arity(F.lit(needle)).alias("alt"))
    first = members.where(F.col("fqn") == needle).withColumn("_r", F.lit(0))
    again = members.join(F.broadcast(alt), F.col("fqn") == F.col("alt")).drop("alt").withColumn("_r", F.lit(1))
    types = g.symbol.where(((F.col("fqn") == needle) | (F.col("name") == needle)) & ~F.col("kind").isin("method", "constructor", "file", "package")).select(F.col("id").alias("parent_id"))
    second = members.join(types, "parent_id", "left_semi").withColumn("_r", F.lit(2))
    third = members.where(F.col("name") == needle).withColumn("_r", F.lit(3))
    cols = ["id", "fqn", "_r"]
    every = first.select(cols).unionByName(again.select(cols)).unionByName(second.select(cols)).unionByName(third.select(cols))
    best = every.join(F.broadcast(every.agg(F.min("_r").alias("_r"))), "_r", "left_semi").select("id", "fqn").distinct()  # of one row
    return page(best, ["fqn", "id"], clamp(limit))


def walk_calls(g: CodeGraph, seeds: DataFrame, side: str = "callers", depth: int = 1, limit: int = 100, min_confidence: float = 0.0, exclude_external: bool = False, module: str | None = None, microservice: str | None = None) -> DataFrame:
    """Call edges met level by level: depth, src, dst, site, confidence; each edge once, at its least depth.

    Scope and externality are tested on the end that the walk discovers.
    """
    at, other = ("dst", "src") if side == "callers" else ("src", "dst")
    e = g.edge("CALLS").where(F.col("confidence") >= min_confidence).select("src", "dst", "call_site_line", "call_site_byte", "confidence", "strategy")
    who = g.symbol.select(F.col("id").alias(other), F.col("fqn").alias("_fqn"), F.col("module").alias("_m"), F.col("microservice").alias("_s"))
    e = e.join(who, other)
    if exclude_external:
        e = e.where(~X.is_external(F.col("_fqn")))
    for name, value in (("_m", module), ("_s", microservice)):
        if value:
            e = e.where(F.col(name) == value)
    e = e.drop("_fqn", "_m", "_s")
    key = ["src", "dst", "call_site_line", "call_site_byte"]
    front, walked, seen = seeds.select("id").distinct(), None, seeds.select("id").distinct()
    for level in range(1, depth + 1):
        step = _cut(e.join(front.select(F.col("id").alias(at)), at, "left_semi").withColumn("depth", F.lit(level)))
        walked = step if walked is None else walked.unionByName(step)
        front = _cut(step.select(F.col(other).alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(front)
        if level < depth and front.isEmpty():
            break
    first = walked.groupBy(*key).agg(F.min(F.struct("depth", "confidence", "strategy")).alias("f")).select(*key, "f.depth", "f.confidence", "f.strategy")
    return page(first, ["depth", *key], clamp(limit))


def callers(g: CodeGraph, needle: str, depth: int = 1, **given) -> DataFrame:
    return walk_calls(g, method_ids(g, needle), "callers", depth, **given)


def callees(g: CodeGraph, needle: str, depth: int = 1, **given) -> DataFrame:
    return walk_calls(g, method_ids(g, needle), "callees", depth, **given)


def bottleneck(edges: DataFrame, seeds: DataFrame, depth: int, min_confidence: float = 0.0) -> DataFrame:
    """(id, score, hops): over all walks of up to depth hops, the best of their weakest edges.

    The frontier is replaced at each hop and nothing is marked as seen, so longer but stronger walks count.
    """
    e = edges.where(F.col("confidence") >= min_confidence).select("src", "dst", "confidence")
    front, out = seeds.select("id").distinct().withColumn("score", F.lit(1.0)), None
    for hop in range(1, depth + 1):
        front = _cut(e.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.least("score", "confidence")).alias("score")))
        one = front.withColumn("hops", F.lit(hop))
        out = one if out is None else out.unionByName(one)
        if hop < depth and front.isEmpty():
            break
    best = out.groupBy("id").agg(F.max("score").alias("score"), F.min("hops").alias("hops"))
    return best.join(seeds.select("id").distinct(), "id", "left_anti")


def expand_methods(g: CodeGraph, fqns: list[str], depth: int = 1, min_confidence: float = 0.0, limit: int = 50, exclude_external: bool = True) -> DataFrame:
    """Types whose methods are called from those of the given types, by their best walk: fqn, score."""
    types = g.symbol.where(F.col("fqn").isin(*fqns)).select(F.col("id").alias("parent_id"))
    seeds = g.symbol.where(F.col("kind").isin("method", "constructor")).join(types, "parent_id", "left_semi")
    found = bottleneck(g.edge("CALLS"), seeds, depth, min_confidence)
    out = g.symbol.join(found, "id").select(X.enclosing_type(F.col("fqn")).alias("fqn"), "score", "hops")
    if exclude_external:
        out = out.where(~X.is_external(F.col("fqn")))
    out = out.where(~F.col("fqn").isin(*fqns)).groupBy("fqn").agg(F.max("score").alias("score"), F.min("hops").alias("hops"))
    return page(out, [F.desc("score"), "hops", "fqn"], clamp(limit))


#: Stages of a flow, and the roles that belong to each.
STAGES = (("entry", ("CONTROLLER",)), ("service", ("SERVICE", "COMPONENT")), ("data", ("CLIENT", "REPOSITORY", "MAPPER")))


def trace_flow(g: CodeGraph, seed_fqns: list[str], depth: int = 2, stage_limit: int = 20, follow_calls: bool = True, min_call_confidence: float = 0.0, exclude_external: bool = True) -> DataFrame:
    """Role by role from the seeds: stage, id, fqn, role, hops, via (up to four edges that led there).

    A stage is reached from all nodes before it by one to three hops, as depth says, over structural edges first, then
    calls within a service, then HTTP and asynchronous calls between services. A node is visited once.
    """
    calls = g.edge("CALLS").where(F.col("confidence") >= min_call_confidence)
    member = g.symbol.select(F.col("id"), F.when(F.col("kind").isin("method", "constructor"), F.col("parent_id")).otherwise(F.col("id")).alias("type"), "microservice")
    lift = lambda e, a, b: e.join(member.select(F.col("id").alias(a), F.col("type").alias("_t1")), a).join(member.select(F.col("id").alias(b), F.col("type").alias("_t2")), b).select(F.col("_t1").alias("src"), F.col("_t2").alias("dst"))
    types = lift(g.all_edges(("INJECTS", "IMPLEMENTS", "EXTENDS")), "src", "dst").withColumn("via", F.lit("structure")).withColumn("_p", F.lit(0))
    if follow_calls:
        types = types.unionByName(lift(calls, "src", "dst").withColumn("via", F.lit("CALLS")).withColumn("_p", F.lit(1)))
    handler = g.edge("EXPOSES").select(F.col("src").alias("_h"), F.col("dst").alias("_route"))
    for edge, declares, p in (("HTTP_CALLS", "DECLARES_CLIENT", 2), ("ASYNC_CALLS", "DECLARES_PRODUCER", 3)):
        out = g.edge(declares).select("src", F.col("dst").alias("_c")).join(g.edge(edge).select(F.col("src").alias("_c"), F.col("dst").alias("_route")), "_c").join(handler, "_route").select("src", F.col("_h").alias("dst"))
        types = types.unionByName(lift(out, "src", "dst").withColumn("via", F.lit(edge)).withColumn("_p", F.lit(p)))
    types = types.where("src <> dst").distinct()
    names = g.symbol.select("id", "fqn", F.upper("role").alias("role"))
    if exclude_external:
        names = names.where(~X.is_external(F.col("fqn")))
    start = names.where(F.col("fqn").isin(*seed_fqns))
    seen = _cut(start.select("id", "fqn", "role", F.lit("seed").alias("stage"), F.lit(0).alias("hops"), X.empty().alias("via")))
    out = seen
    for stage, roles in STAGES:
        front, met = out.select(F.col("id").alias("src")), None
        for hop in range(1, min(max(depth, 1), 3) + 1):
            step = types.join(front, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.slice(F.array_sort(F.collect_set(F.struct("_p", "via", "src"))), 1, 4).alias("_v"))
            step = _cut(step.join(out.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
            met = step if met is None else met.unionByName(step.join(met.select("id"), "id", "left_anti"))
            front = step.select(F.col("id").alias("src"))
            if hop < depth and front.isEmpty():
                break
        met = met.join(names.where(F.col("role").isin(*roles)), "id")
        via = F.transform("_v", lambda x: F.concat_ws(":", x["via"], x["src"]))
        met = page(met.select("id", "fqn", "role", F.lit(stage).alias("stage"), "hops", via.alias("via"), F.get("_v", F.lit(0))["_p"].alias("_p")), ["hops", "_p", "fqn", "id"], stage_limit).drop("_p")
        out = _cut(out.unionByName(met))
    return out


def route_callers(g: CodeGraph, route_id: str) -> DataFrame:
    """Who calls a route: by edge, or by a path or topic that fits; edges win for a caller. branch, caller_id, confidence."""
    r = g.route.where(F.col("id") == route_id).select(*[F.col(c).alias(f"r_{c}") for c in ("id", "path", "path_template", "method", "topic", "microservice", "framework")])
    by_edge = lambda edge, branch, p: g.edge(edge).where(F.col("dst") == route_id).select(F.col("src").alias("caller_id"), "confidence", F.lit(branch).alias("branch"), F.lit(p).alias("_p"))
    c, q = g.client, g.producer
    same = lambda a, b: (a != "") & (a == b)
    paths = same(c["path"], F.col("r_path")) | same(c["path_template"], F.col("r_path_template")) | same(c["path"], F.col("r_path_template")) | same(c["path_template"], F.col("r_path"))
    verb = (c["method"] == "") | (F.col("r_method") == "") | (c["method"] == F.col("r_method"))
    service = (c["target_service"] == "") | (c["target_service"] == F.col("r_microservice"))
    # One route stands on the right, so this nested loop is one pass over the clients.
    http = c.join(F.broadcast(r), paths & verb & service).select(c["id"].alias("caller_id"), F.lit(0.5).alias("confidence"), F.lit("http_path").alias("branch"), F.lit(2).alias("_p"))
    topic = q.join(F.broadcast(r), same(q["topic"], F.col("r_topic"))).select(q["id"].alias("caller_id"), F.lit(0.5).alias("confidence"), F.lit("topic").alias("branch"), F.lit(3).alias("_p"))
    every = by_edge("HTTP_CALLS", "http_edge", 0).unionByName(by_edge("ASYNC_CALLS", "async_edge", 1)).unionByName(http).unionByName(topic)
    one = Window.partitionBy("caller_id").orderBy("_p", F.desc("confidence"))
    return every.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "_p").orderBy(F.desc("confidence"), "caller_id")


def request_flow(g: CodeGraph, route_id: str, max_hops: int = 3) -> DataFrame:
    """A request from its origins through a route to what the handlers call: direction, id, fqn, hops, confidence."""
    inbound = route_callers(g, route_id)
    owner = g.client.select(F.col("id").alias("caller_id"), "member_id").unionByName(g.producer.select(F.col("id").alias("caller_id"), "member_id"))
    members = inbound.join(owner, "caller_id", "left")
    back = reach(directed(g.edge("CALLS"), "in"), members.select(F.col("member_id").alias("id")), max_hops)
    handlers = g.edge("EXPOSES").where(F.col("dst") == route_id).select(F.col("src").alias("id"))
    ahead = reach(directed(g.edge("CALLS"), "out"), handlers, max_hops)
    name = g.symbol.select("id", "fqn")
    rows = members.select(F.lit("inbound").alias("direction"), F.col("member_id").alias("id"), F.lit(0).alias("depth"), "confidence")
    rows = rows.unionByName(back.select(F.lit("origin").alias("direction"), "id", "depth", F.lit(None).cast("double").alias("confidence")))
    rows = rows.unionByName(handlers.select(F.lit("handler").alias("direction"), "id", F.lit(0).alias("depth"), F.lit(None).cast("double").alias("confidence")))
    rows = rows.unionByName(ahead.select(F.lit("outbound").alias("direction"), "id", "depth", F.lit(None).cast("double").alias("confidence")))
    return rows.join(name, "id", "left").select("direction", "id", "fqn", "depth", "confidence").orderBy("direction", "depth", F.desc("confidence"), "id")


def ancestors(supers: DataFrame, depth: int | None = None) -> DataFrame:
    """(sub, super, hops): the closure of a direct supertype relation (src, dst), at least distances; up to a depth, if there is one."""
    pairs = supers.select(F.col("src").alias("sub"), F.col("dst").alias("super")).distinct().withColumn("hops", F.lit(1))
    front = pairs
    for hop in count(2):
        if (depth and hop > depth) or front.isEmpty():
            break
        step = front.alias("f").join(supers.alias("e"), F.col("f.super") == F.col("e.src")).select(F.col("f.sub").alias("sub"), F.col("e.dst").alias("super")).distinct()
        front = _cut(step.join(pairs, ["sub", "super"], "left_anti").withColumn("hops", F.lit(hop)))
        pairs = pairs.unionByName(front)
    return pairs
