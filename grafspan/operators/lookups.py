"""Lookups and one-hop joins. Every limit follows a total order, so that results don't vary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from .. import vocabulary as V
from ..graph import CodeGraph
from .filters import EdgeFilter, NodeFilter, scoped

MOST = 500


def clamp(limit: int | None, default: int = 20, most: int = MOST) -> int:
    return max(1, min(limit or default, most))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


# --- nodes ---


def find(g: CodeGraph, kind: str = "symbol", where: dict | NodeFilter | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Nodes of a kind that pass the filter, by id; symbols for files and packages are left out."""
    df = g.node(kind).where(NodeFilter.of(where).column(kind))
    if kind == "symbol":
        df = df.where(~F.col("kind").isin("file", "package"))
    return page(df, ["id"], clamp(limit), offset)


def by_name(g: CodeGraph, needle: str, kinds: tuple[str, ...] | None = None, mode: str = "exact", module: str | None = None, microservice: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols whose name or fqn is, begins with or contains the needle; the two fuzzy modes skip files and packages."""
    if not needle:
        return g.symbol.limit(0)
    test = {"exact": lambda c: c == needle, "prefix": lambda c: c.startswith(needle), "contains": lambda c: c.contains(needle)}[mode]
    df = g.symbol.where(test(F.col("name")) | test(F.col("fqn")))
    if mode != "exact":
        df = df.where(~F.col("kind").isin("file", "package"))
    if kinds:
        df = df.where(F.col("kind").isin(*kinds))
    return page(scoped(df, module, microservice), ["fqn", "id"], clamp(limit))


def by_name_or_wider(g: CodeGraph, needle: str, **given) -> DataFrame:
    """Exact matches; if there are none those by prefix; else those that contain the needle."""
    wide = {**given, "limit": MOST}
    ranked = None
    for rank, mode in enumerate(("exact", "prefix", "contains")):
        one = by_name(g, needle, mode=mode, **wide).withColumn("_rank", F.lit(rank))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy())).where("_rank = _best").drop("_rank", "_best")
    return page(best, ["fqn", "id"], clamp(given.get("limit")))


def by_role(g: CodeGraph, role: str, limit: int = 20, **scope) -> DataFrame:
    return page(scoped(g.symbol.where(F.col("role") == role), **scope), ["id"], clamp(limit))


def by_annotation(g: CodeGraph, annotation: str, limit: int = 20, **scope) -> DataFrame:
    return page(scoped(g.symbol.where(F.array_contains("annotations", annotation)), **scope), ["id"], clamp(limit))


def by_capability(g: CodeGraph, capability: str, limit: int = 20, **scope) -> DataFrame:
    return page(scoped(g.symbol.where(F.array_contains("capabilities", capability)), **scope), ["id"], clamp(limit))


def by_framework(g: CodeGraph, annotations: tuple[str, ...]) -> DataFrame:
    """Types that carry any of a framework's annotations."""
    return g.symbol.where(F.col("kind").isin(*V.TYPE_KINDS) & F.arrays_overlap("annotations", F.array(*map(F.lit, annotations))))


def in_file_range(g: CodeGraph, filename: str, start: int, end: int) -> DataFrame:
    """Symbols of a file whose lines overlap [start, end]."""
    hit = (F.col("filename") == filename) & (F.col("start_line") <= end) & (F.col("end_line") >= start)
    return g.symbol.where(hit & ~F.col("kind").isin("file", "package")).orderBy("start_line", "end_line", "id")


def outline(g: CodeGraph, filename: str) -> DataFrame:
    return g.symbol.where((F.col("filename") == filename) & ~F.col("kind").isin("file", "package")).orderBy("start_line", "start_byte", "id")


def clients(g: CodeGraph, limit: int = 20, **where) -> DataFrame:
    return page(g.client.where(NodeFilter.of(where).column("client")), ["microservice", "client_kind", "path", "method", "id"], clamp(limit))


def producers(g: CodeGraph, topic_contains: str | None = None, limit: int = 20, **where) -> DataFrame:
    df = g.producer.where(NodeFilter.of(where).column("producer"))
    if topic_contains:
        df = df.where(F.col("topic").contains(topic_contains))
    return page(df, ["microservice", "producer_kind", "topic", "id"], clamp(limit))


def routes(g: CodeGraph, server_exposed: bool = False, include_kafka: bool = False, limit: int = 20, **where) -> DataFrame:
    """Routes; server_exposed keeps those that some method exposes, include_kafka topics besides."""
    df = g.route.where(NodeFilter.of(where).column("route"))
    if server_exposed:
        shown = g.edge("EXPOSES").select(F.col("dst").alias("id")).distinct()
        if include_kafka:
            df = df.join(shown.withColumn("_shown", F.lit(True)), "id", "left").where(F.col("_shown") | (F.col("kind") == "kafka_topic")).drop("_shown")
        else:
            df = df.join(shown, "id", "left_semi")
    return page(df, ["microservice", "path", "method", "id"], clamp(limit))


def route_by_path(g: CodeGraph, microservice: str, path_template: str, method: str | None = None) -> DataFrame:
    df = g.route.where((F.col("microservice") == microservice) & (F.col("path_template") == path_template))
    return (df.where(F.col("method") == method) if method else df).orderBy("id").limit(1)


def unresolved_sites(g: CodeGraph, method_id: str | None = None, reason: str | None = None, microservice: str | None = None, callee: str | None = None, limit: int = 100) -> DataFrame:
    """Call sites without a target, with their caller."""
    who = g.symbol.select(F.col("id").alias("caller_id"), F.col("fqn").alias("caller_fqn"), F.col("microservice").alias("caller_microservice"), F.col("role").alias("caller_role"))
    df = g.unresolved.join(who, "caller_id")
    for name, value in (("caller_id", method_id), ("reason", reason), ("caller_microservice", microservice), ("callee_simple", callee)):
        if value:
            df = df.where(F.col(name) == value)
    return page(df, ["call_site_line", "call_site_byte", "id"], clamp(limit))


# --- edges ---


def _ends(g: CodeGraph, edge: str, side: str) -> DataFrame:
    """Edges with the symbol at one end, as all its columns."""
    e = g.edge(edge).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    return e.join(g.symbol, F.col("id") == F.col(f"_{side}"))


def related(g: CodeGraph, edge: str, needle: str, direction: str = "in", limit: int = 20, capability: str | None = None, **scope) -> DataFrame:
    """Distinct symbols one edge away from those of that name or fqn: implementors, subclasses, injectors, overriders."""
    at, other = ("dst", "src") if direction == "in" else ("src", "dst")
    named = g.symbol.where((F.col("fqn") == needle) | (F.col("name") == needle)).select(F.col("id").alias(f"_{at}"))
    out = _ends(g, edge, other).join(named, f"_{at}", "left_semi").drop("_src", "_dst")
    out = scoped(out, **scope)
    if capability:
        out = out.where(F.array_contains("capabilities", capability))
    return page(out.dropDuplicates(["id"]), ["fqn", "id"], clamp(limit))


def implementors(g: CodeGraph, needle: str, **given) -> DataFrame:
    return related(g, "IMPLEMENTS", needle, "in", **given)


def subclasses(g: CodeGraph, needle: str, **given) -> DataFrame:
    return related(g, "EXTENDS", needle, "in", **given)


def overrides(g: CodeGraph, needle: str, **given) -> DataFrame:
    return related(g, "OVERRIDES", needle, "out", **given)


def overridden_by(g: CodeGraph, needle: str, **given) -> DataFrame:
    return related(g, "OVERRIDES", needle, "in", **given)


def dependencies(g: CodeGraph, needle: str, **given) -> DataFrame:
    return related(g, "INJECTS", needle, "out", **given)


def hierarchy(g: CodeGraph, needle: str, limit: int = 100) -> DataFrame:
    """Supertypes and subtypes one step away, with the direction and the edge."""
    out = None
    for edge in ("EXTENDS", "IMPLEMENTS"):
        for direction, word in (("out", "up"), ("in", "down")):
            one = related(g, edge, needle, direction, limit=MOST).select(F.lit(word).alias("direction"), F.lit(edge).alias("edge_type"), "id", "fqn", "kind")
            out = one if out is None else out.unionByName(one)
    return page(out, ["direction", "edge_type", "fqn", "id"], clamp(limit))


def injectors(g: CodeGraph, needle: str, limit: int = 20, **scope) -> DataFrame:
    """Both ends of INJECTS edges into the named types, prefixed s_ and t_, with the edge's attributes."""
    target = g.symbol.where((F.col("fqn") == needle) | (F.col("name") == needle))
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in schema.SYMBOL_COLUMNS])
    s = scoped(g.symbol, **scope).select(*[F.col(c).alias(f"s_{c}") for c in schema.SYMBOL_COLUMNS])
    out = g.edge("INJECTS").join(t, F.col("dst") == F.col("t_id")).join(s, F.col("src") == F.col("s_id"))
    return page(out.drop("src", "dst"), ["s_id", "t_id", "mechanism", "field_or_param"], clamp(limit))


def route_handlers(g: CodeGraph, route_id: str) -> DataFrame:
    hit = g.edge("EXPOSES").where(F.col("dst") == route_id).select(F.col("src").alias("id"), "confidence", "strategy")
    return g.symbol.join(hit, "id").orderBy("fqn", "id")


def calls_of(g: CodeGraph, origin: str, direction: str = "out", where: dict | EdgeFilter | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """CALLS of one method with the symbol at the other end, in the order of the call sites."""
    at, other = ("src", "dst") if direction == "out" else ("dst", "src")
    e = g.edge("CALLS").where((F.col(at) == origin) & EdgeFilter.of(where).column()).withColumnRenamed("resolved", "edge_resolved")
    df = e.join(g.symbol.drop("resolved"), F.col(other) == F.col("id"))
    order = ["call_site_line", "call_site_byte", F.desc("edge_resolved"), "id"]
    return page(df, order, clamp(limit, MOST), offset) if limit else df.orderBy(*order)


def neighbors(g: CodeGraph, ids: list[str], edge_types: list[str], direction: str = "out", where: dict | NodeFilter | None = None, edge_where: dict | EdgeFilter | None = None, limit: int = 50, offset: int = 0, include_unresolved: bool = False, dedup_calls: bool = False) -> DataFrame:
    """One hop from each id over stored and composed edges: origin, edge_type, other, attributes.

    Attributes that an edge type lacks are null. Call sites without a target may be added as rows of CALLS.
    """
    ef, out = EdgeFilter.of(edge_where), None
    for kind in edge_types:
        schema.check_edge(kind)
        one = walk(g, kind, direction)
        if lacking := ef.needs() - set(one.columns):
            raise ValueError(f"{kind} has no {', '.join(sorted(lacking))}")
        one = one.where(F.col("origin").isin(*ids) & ef.column()).withColumn("edge_type", F.lit(kind))
        if kind == "CALLS" and dedup_calls:
            one = dedup_call_edges(one)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if where:
        kept = NodeFilter.of(where)
        passing = None
        for kind in {V.EDGES[V.COMPOSED[k][2] or "OVERRIDES" if k in V.COMPOSED else k][1 if direction == "out" else 0].lower() for k in edge_types}:
            node = g.node(kind).where(kept.column(kind)).select(F.col("id").alias("other"))
            passing = node if passing is None else passing.unionByName(node)
        out = out.join(passing, "other", "left_semi")
    if include_unresolved and "CALLS" in edge_types and direction == "out":
        sites = g.unresolved.where(F.col("caller_id").isin(*ids)).select(F.col("caller_id").alias("origin"), F.col("id").alias("other"), F.lit("CALLS").alias("edge_type"), "call_site_line", "call_site_byte", F.lit(False).alias("resolved"))
        out = out.unionByName(sites, allowMissingColumns=True)
    order = ["origin", "edge_type"] + [c for c in ("call_site_line", "call_site_byte") if c in out.columns] + ["other"]
    return page(out, order, clamp(limit), offset)


def walk(g: CodeGraph, kind: str, direction: str = "out") -> DataFrame:
    """(origin, other, attributes) of a stored or composed edge, in a direction; composed ones go outwards only."""
    if kind in V.COMPOSED:
        first, way, then = V.COMPOSED[kind]
        a, b = ("src", "dst") if way == "out" else ("dst", "src")
        step = g.edge(first).select(F.col(a).alias("origin"), F.col(b).alias("via")).distinct()
        if then is None:
            return step.withColumnRenamed("via", "other")
        return step.join(g.edge(then).withColumnRenamed("src", "via").withColumnRenamed("dst", "other"), "via")
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return g.edge(kind).withColumnRenamed(a, "origin").withColumnRenamed(b, "other")


def dedup_call_edges(calls: DataFrame) -> DataFrame:
    """Calls of one pair as one row: the earliest site, how many there are, and their distinct lines."""
    keys = [c for c in ("origin", "other", "edge_type") if c in calls.columns]
    rest = [c for c in calls.columns if c not in keys]
    site = F.struct("call_site_line", "call_site_byte", *[c for c in rest if c not in ("call_site_line", "call_site_byte")])
    g = calls.groupBy(*keys).agg(F.min(site).alias("_s"), F.count("*").alias("call_site_count"), F.sort_array(F.collect_set("call_site_line")).alias("call_site_lines"))
    return g.select(*keys, "_s.*", "call_site_count", "call_site_lines")


def topic_consumers(g: CodeGraph, topic: str, contains: bool = False, microservice: str | None = None) -> DataFrame:
    """Types whose members expose a topic: DECLARES, then EXPOSES."""
    hit = F.col("topic").contains(topic) if contains else F.col("topic") == topic
    on = g.route.where(hit).select(F.col("id").alias("dst"))
    members = g.edge("EXPOSES").join(on, "dst", "left_semi").select(F.col("src").alias("dst"))
    types = g.edge("DECLARES").join(members, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return scoped(g.symbol.join(types, "id", "left_semi"), None, microservice).orderBy("fqn", "id")


def listeners(g: CodeGraph, topic: str | None = None, limit: int = 100) -> DataFrame:
    df = g.symbol.where(F.array_contains("capabilities", "MESSAGE_LISTENER"))
    if topic:
        df = df.join(topic_consumers(g, topic, contains=True).select("id"), "id", "left_semi")
    return page(df, ["fqn", "id"], clamp(limit))


def interface_overlap(hunks: DataFrame, symbols: DataFrame, on: str = "filename") -> DataFrame:
    """Interval join: equal key first, then overlapping line ranges."""
    h, s = hunks.alias("h"), symbols.alias("s")
    hit: Column = (F.col(f"h.{on}") == F.col(f"s.{on}")) & (F.col("s.start_line") <= F.col("h.end_line")) & (F.col("s.end_line") >= F.col("h.start_line"))
    return h.join(s, hit)
