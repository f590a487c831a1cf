"""Resolution of identifiers, descriptions, explanations of empty results, and risk of changes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import keys as K
from ..functions import text as X
from ..graph import CodeGraph
from . import aggregates, lookups, ranking, retrieval, traversal
from .filters import NodeFilter, scoped

#: Reasons of a match, best first.
REASONS = ("exact_id", "exact_fqn", "route_method_path", "route_template", "route_topic", "client_target_path", "client_target", "producer_topic", "fqn_suffix", "route_topic_prefix", "producer_topic_prefix", "client_owner", "short_name")


def _found(df: DataFrame, reason: str, specificity) -> DataFrame:  # noqa: ANN001
    s = specificity if not isinstance(specificity, int) else F.lit(specificity)
    return df.select("id", "node_kind", "label", F.lit(reason).alias("reason"), F.lit(REASONS.index(reason)).alias("priority"), s.cast("long").alias("specificity"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidates(g: CodeGraph, identifier: str, microservice: str | None = None, module: str | None = None) -> DataFrame:
    """All nodes that an identifier may mean, with reason and specificity. A scope limits every generator."""
    n = len(identifier)
    s = scoped(g.symbol, module, microservice).withColumns({"node_kind": F.lit("symbol"), "label": F.col("fqn")})
    fqn, parts = F.col("fqn"), []
    parts.append(_found(s.where(F.col("id") == identifier), "exact_id", n))
    parts.append(_found(s.where(fqn == identifier), "exact_fqn", n))
    if "#" in identifier and "(" not in identifier:
        parts.append(_found(s.where(fqn.startswith(f"{identifier}(")), "fqn_suffix", n + 1))
        if "." not in identifier.split("#", 1)[0]:
            parts.append(_found(s.where(fqn.contains(f".{identifier}(")), "fqn_suffix", n + 1))
    parts.append(_found(s.where((fqn == identifier) | fqn.endswith(f".{identifier}")), "fqn_suffix", F.length("fqn")))
    parts.append(_found(s.where(F.col("name") == identifier), "short_name", n))
    r = scoped(g.route, module, microservice).withColumns({"node_kind": F.lit("route"), "label": F.concat_ws(" ", "method", "path_template")})
    parts.append(_found(r.where(F.col("id") == identifier), "exact_id", n))
    words = identifier.split()
    if len(words) in (2, 3) and words[-1].startswith("/"):
        hit = (F.col("method") == words[-2].upper()) & ((F.col("path") == words[-1]) | (F.col("path_template") == words[-1]))
        parts.append(_found(r.where(hit & (F.col("microservice") == words[0] if len(words) == 3 else F.lit(True))), "route_method_path", len(words[-1])))
    if identifier.startswith("/"):
        parts.append(_found(r.where((F.col("path") == identifier) | (F.col("path_template") == identifier)), "route_template", F.length("path_template")))
    else:
        parts.append(_found(r.where((F.col("topic") != "") & F.col("topic").startswith(identifier) & (F.col("topic") != identifier)), "route_topic_prefix", n))
    parts.append(_found(r.where(F.col("topic") == identifier), "route_topic", n))
    c = scoped(g.client, module, microservice).withColumns({"node_kind": F.lit("client"), "label": F.concat_ws(" ", "target_service", "path")})
    parts.append(_found(c.where(F.col("id") == identifier), "exact_id", n))
    if len(words) == 2:
        parts.append(_found(c.where((F.col("target_service") == words[0]) & F.col("path").startswith(words[1])), "client_target_path", n))
    parts.append(_found(c.where(F.col("target_service") == identifier), "client_target", n))
    parts.append(_found(c.where((F.col("member_fqn") == identifier) | F.col("member_fqn").endswith(f".{identifier}")), "client_owner", F.length("member_fqn")))
    p = scoped(g.producer, module, microservice).withColumns({"node_kind": F.lit("producer"), "label": F.col("topic")})
    parts.append(_found(p.where(F.col("id") == identifier), "exact_id", n))
    parts.append(_found(p.where(F.col("topic") == identifier), "producer_topic", n))
    parts.append(_found(p.where((F.col("topic") != identifier) & F.col("topic").startswith(identifier)), "producer_topic_prefix", n))
    return _drop_mirrors(g, _union(parts))


def _drop_mirrors(g: CodeGraph, found: DataFrame) -> DataFrame:
    """Without routes that nobody exposes, if an exposed one has the same label."""
    shown = g.edge("EXPOSES").select(F.col("dst").alias("id")).distinct().withColumn("_shown", F.lit(True))
    marked = found.join(shown, "id", "left").withColumn("_route", F.col("node_kind") == "route")
    good = marked.where("_route and _shown").select("label").distinct().withColumn("_good", F.lit(True))
    out = marked.join(good, "label", "left").where(~(F.col("_route") & F.col("_shown").isNull() & F.coalesce("_good", F.lit(False))))
    return out.drop("_shown", "_route", "_good")


def resolved(g: CodeGraph, identifier: str, kind: str | None = None, most: int = 10, **scope) -> DataFrame:
    """Ranked candidates, one row for each node."""
    if "*" in identifier or "?" in identifier:
        raise ValueError("wildcards are not identifiers; use find")
    found = candidates(g, identifier, **scope)
    return ranking.ranked_candidates(found.where(F.col("node_kind") == kind) if kind else found, most=most).orderBy("place")


@dataclass
class Result:
    """What a call returns: a status, rows for people, and the table for further work."""

    status: str
    rows: list[dict] = field(default_factory=list)
    truncated: bool = False
    message: str = ""
    frame: DataFrame | None = None

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(Result(self.status, self.rows, self.truncated, self.message)).items() if k != "frame"}


def enveloped(df: DataFrame, limit: int) -> Result:
    """A page of at most limit rows, and whether there are more."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return Result("ok" if rows else "empty", rows[:limit], len(rows) > limit, frame=df)


def resolve(g: CodeGraph, identifier: str, kind: str | None = None, **scope) -> Result:
    """one, many or none."""
    found = resolved(g, identifier, kind, **scope)
    rows = [r.asDict() for r in found.collect()]
    # One node of the best reason stands for itself, even if weaker reasons name others.
    top = [r for r in rows if r["priority"] == rows[0]["priority"]] if rows else []
    one = len(top) == 1 and top[0]["reason"] in ("exact_id", "exact_fqn")
    return Result("none" if not rows else "one" if one or len(rows) == 1 else "many", rows[:1] if one else rows, frame=found)


def describe(g: CodeGraph, node_id: str, sites: int = 5) -> Result:
    """A node's record, its edge summary, and its first unresolved call sites."""
    kind = {"r": "route", "c": "client", "p": "producer"}.get(node_id.split(":", 1)[0] if ":" in node_id[:2] else "", "symbol")
    record = g.node(kind).where(F.col("id") == node_id).first()
    if record is None:
        return Result("none", message=f"no {kind} {node_id}")
    counts = aggregates.edge_summary(g).where(F.col("id") == node_id).collect()
    gaps = g.unresolved.where(F.col("caller_id") == node_id)
    first = gaps.orderBy("call_site_line", "call_site_byte", "id").limit(sites).collect()
    row = record.asDict(recursive=True) | {"edge_summary": {r["edge_type"]: {"in": r["n_in"], "out": r["n_out"]} for r in counts}, "unresolved_sites": [r.asDict() for r in first], "unresolved_count": gaps.count()}
    return Result("ok", [row])


# --- empty results ---

ABSENT_FLOOR, CLOSE = 0.40, 0.85


def diagnose(g: CodeGraph, query: str, where: dict | NodeFilter | None = None, vocabulary: DataFrame | None = None) -> Result:
    """Why a search found nothing: external, excluded by the filter, a close name, absent, or too vague."""
    names = g.symbol.where(F.col("resolved") & ~F.col("kind").isin("file", "package"))
    if query.startswith(V.EXTERNAL_PREFIXES):
        return Result("external", message=f"{query} is not part of this project")
    if not names.where((F.col("name") == query) | (F.col("fqn") == query)).isEmpty():
        relaxed = relaxation(g, where, query)
        return Result("refine_query", relaxed, message="the name exists, but not under this filter")
    near = retrieval.did_you_mean(vocabulary if vocabulary is not None else retrieval.vocabulary(names), query).collect()
    rows, best = [r.asDict() for r in near], near[0]["similarity"] if near else 0.0
    shaped = g.spark.range(1).select(X.looks_like_identifier(F.lit(query))).first()[0]
    if best < ABSENT_FLOOR and shaped:
        return Result("not_in_project", rows, message=f"no name is like {query}")
    return Result("refine_query", rows, message="close names" if best >= CLOSE else "no close name")


def relaxation(g: CodeGraph, where: dict | NodeFilter | None, needle: str | None = None) -> list[dict]:
    """For each dimension that the filter constrains: values under which rows exist."""
    out = []
    for dim in ("module", "microservice", "role"):
        if getattr(NodeFilter.of(where), dim):
            out += [{"dimension": dim} | r.asDict() for r in aggregates.tally(g.symbol.where("resolved"), dim, needle).collect()]
    return out


# --- changes ---


def changed_symbols(g: CodeGraph, hunks: DataFrame) -> DataFrame:
    """Diff hunks to symbols: id, change (modified before removed before other), lines.

    hunks: source_path, target_path, source_start, source_len, target_start, target_len. The new side counts, but
    the old one for hunks that only delete. A path that is not indexed stands for the only file of that name.
    """
    files = g.symbol.select("filename").where("filename <> ''").distinct()
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    only = files.groupBy(base(F.col("filename")).alias("_base")).agg(F.min("filename").alias("_only"), F.count("*").alias("_n")).where("_n = 1")
    sides = F.when(F.col("target_len") > 0, F.struct(F.col("target_path").alias("path"), F.col("target_start").alias("a"), (F.col("target_start") + F.col("target_len") - 1).alias("b"), F.lit("modified").alias("change"))).otherwise(
        F.struct(F.col("source_path").alias("path"), F.col("source_start").alias("a"), (F.col("source_start") + F.greatest(F.col("source_len"), F.lit(1)) - 1).alias("b"), F.lit("removed").alias("change")))
    h = hunks.select(sides.alias("s")).select("s.*")
    h = h.join(files.withColumn("_exact", F.col("filename")), h["path"] == F.col("filename"), "left").drop("filename").join(only, base(F.col("path")) == F.col("_base"), "left")
    h = h.withColumn("filename", F.coalesce("_exact", "_only")).where("filename is not null").select("filename", F.col("a").cast("long").alias("start_line"), F.col("b").cast("long").alias("end_line"), "change")
    s = g.symbol.where(~F.col("kind").isin("file", "package")).select("id", "filename", "start_line", "end_line")
    hit = lookups.interface_overlap(h, s)
    lo, hi = F.greatest("h.start_line", "s.start_line"), F.least("h.end_line", "s.end_line")
    rank = F.when(F.col("change") == "modified", 0).otherwise(1)
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_l"))))
    return hit.select(F.col("s.id"), "change", rank.alias("_r"), F.sequence(lo, hi).alias("_l")).groupBy("id").agg(F.min_by("change", "_r").alias("change"), lines.alias("lines"))


def risk(g: CodeGraph, changed: DataFrame) -> DataFrame:
    """One row: blast, cross_service, interface, routes, route_callers, score, band.

    blast: over all changed symbols, how many depend on each (on the type, for a member) within two edges of INJECTS, IMPLEMENTS and EXTENDS.
    cross_service: call edges within two hops that lead to a changed symbol from another service. interface: whether a method of an interface that isn't
    private is among them. routes: different ones that changed symbols expose. route_callers: calls of these routes from other services.
    """
    ids = g.symbol.join(changed.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("cid"), "fqn", "kind", "modifiers")
    owner = F.substring_index("fqn", "#", 1)
    needles = ids.select("cid", F.when(F.col("kind").isin("method", "field", "constructor"), owner).otherwise(F.col("fqn")).alias("needle"))
    named = lambda column: needles.join(g.symbol.select("id", F.col(column).alias("needle")), "needle").select("cid", "id")
    front, blast = named("fqn").unionByName(named("name")).distinct(), None
    dependents = g.all_edges(("INJECTS", "IMPLEMENTS", "EXTENDS")).select("src", F.col("dst").alias("id"))
    for _ in range(2):
        front = dependents.join(front, "id").select("cid", F.col("src").alias("id")).distinct()
        blast = front if blast is None else blast.unionByName(front)
    blast = blast.distinct().join(g.symbol.select("id"), "id", "left_semi")

    members = g.symbol.where(F.col("kind").isin("method", "constructor"))
    types = g.symbol.where(~F.col("kind").isin("method", "constructor", "file", "package")).select("fqn", F.col("id").alias("parent_id"))
    own = ids.select("cid", "fqn").join(members.select("fqn", "id"), "fqn").select("cid", "id")
    inside = ids.select("cid", "fqn").join(types, "fqn").join(members.select("parent_id", "id"), "parent_id").select("cid", "id")
    seeds = own.unionByName(inside).distinct()
    calls = g.edge("CALLS").select("src", "dst", "call_site_line", "call_site_byte")
    first = calls.join(seeds.withColumnRenamed("id", "dst"), "dst").select("cid", *calls.columns)
    again = first.select("cid", F.col("src").alias("dst")).distinct().join(seeds.withColumnRenamed("id", "dst"), ["cid", "dst"], "left_anti")
    edges = first.unionByName(calls.join(again, "dst").select("cid", *calls.columns)).distinct()
    service = lambda end: g.symbol.where("microservice <> ''").select(F.col("id").alias(end), F.col("microservice").alias(f"_{end}"))
    across = edges.join(service("src"), "src").join(service("dst"), "dst").where("_src <> _dst")

    faces = g.symbol.where("kind = 'interface'").select(F.col("fqn").alias("_type"))
    public = ids.where((F.col("kind") == "method") & ~F.array_contains("modifiers", "private")).withColumn("_type", owner).join(faces, "_type", "left_semi")
    shown = g.edge("EXPOSES").select(F.col("src").alias("cid"), "dst").distinct().join(ids, "cid", "left_semi")
    label = F.trim(F.concat_ws(" ", "method", "path_template"))
    labels = g.route.join(shown.select(F.col("dst").alias("id")), "id", "left_semi").select(F.when(label != "", label).otherwise(F.concat(F.lit("topic:"), F.col("topic"))).alias("label")).distinct()

    def remote(edge: str, declares: str) -> DataFrame:
        call = g.edge(edge).where("match = 'cross_service'").select(F.col("src").alias("_end"), "dst")
        return shown.join(call, "dst").join(g.edge(declares).select(F.col("dst").alias("_end")), "_end").select("_end")

    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = one(blast, "blast"), one(across, "cross_service"), one(public.limit(1), "interface"), one(labels, "routes"), one(remote("HTTP_CALLS", "DECLARES_CLIENT").unionByName(remote("ASYNC_CALLS", "DECLARES_PRODUCER")), "route_callers")
    row = parts[0]
    for p in parts[1:]:  # of one row each
        row = row.crossJoin(p)
    part = lambda c, k: V.RISK[k][0] * F.least(F.col(c), F.lit(V.RISK[k][1])) / V.RISK[k][1]
    score = part("blast", "blast") + part("cross_service", "cross") + part("interface", "interface") + part("routes", "routes") + F.least(F.col("route_callers"), F.lit(5)) / 5
    out = row.withColumn("score", F.least(score, F.lit(1.0)))
    return out.withColumn("band", F.when(F.col("score") < 0.3, "low").when(F.col("score") < 0.7, "medium").otherwise("high"))


def route_of(g: CodeGraph, identifier: str) -> DataFrame:
    """Routes that ``GET /x`` names."""
    want = g.spark.range(1).select(K.route_method(F.lit(identifier)).alias("w")).select("w.method", "w.path")
    return g.route.join(F.broadcast(want), ["method", "path"], "left_semi")
