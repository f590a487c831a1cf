"""Counts, roll-ups and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as X
from ..graph import CodeGraph
from .lookups import walk


def edge_counts(g: CodeGraph, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """id, edge_type, n_in, n_out of every node with an edge: one shuffle over both ends."""
    e = g.all_edges(edge_types)
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return e.select("edge_type", ends.alias("x")).groupBy("x.id", "edge_type").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))


def edge_counts_of(g: CodeGraph, node_id: str) -> DataFrame:
    e = g.all_edges().where((F.col("src") == node_id) | (F.col("dst") == node_id))
    return e.groupBy("edge_type").agg(F.sum((F.col("dst") == node_id).cast("long")).alias("n_in"), F.sum((F.col("src") == node_id).cast("long")).alias("n_out")).orderBy("edge_type")


def composed_counts(g: CodeGraph, keys: tuple[str, ...] | None = None) -> DataFrame:
    """origin, edge_type, n: two-step edges of every origin; OVERRIDDEN_BY counts distinct methods."""
    out = None
    for k in keys or tuple(V.COMPOSED):
        w = walk(g, k)
        n = F.count_distinct("other") if V.COMPOSED[k][2] is None else F.count("*")
        one = w.groupBy("origin").agg(n.alias("n")).withColumn("edge_type", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("origin", "edge_type", "n")


def edge_summary(g: CodeGraph) -> DataFrame:
    """Stored and composed counts of every node in one table; a composed OVERRIDES count never lowers the stored one."""
    stored = edge_counts(g)
    composed = composed_counts(g).select(F.col("origin").alias("id"), "edge_type", F.lit(0).cast("long").alias("n_in"), F.col("n").alias("n_out"))
    over = composed.where("edge_type = 'OVERRIDDEN_BY'").select("id", F.lit("OVERRIDES").alias("edge_type"), F.col("n_out").alias("n_in"), F.lit(0).cast("long").alias("n_out"))
    return stored.unionByName(composed).unionByName(over).groupBy("id", "edge_type").agg(F.max("n_in").alias("n_in"), F.max("n_out").alias("n_out"))


def scope_counts(g: CodeGraph, column: str) -> DataFrame:
    """Resolved types by module or microservice; unknown is the empty string."""
    return g.symbol.where(F.col("resolved") & F.col("kind").isin(*V.TYPE_KINDS)).groupBy(F.coalesce(F.col(column), F.lit("")).alias(column)).agg(F.count("*").alias("n")).orderBy(column)


def map_of(g: CodeGraph, by: str = "microservice") -> DataFrame:
    """Types by scope and kind; without a scope they are (unscoped)."""
    scope = F.when(F.coalesce(F.col(by), F.lit("")) == "", "(unscoped)").otherwise(F.col(by))
    return g.symbol.where(F.col("resolved") & F.col("kind").isin(*V.TYPE_KINDS)).groupBy(scope.alias("scope"), "kind").agg(F.count("*").alias("n")).orderBy("scope", "kind")


def conventions(g: CodeGraph) -> DataFrame:
    """Counts of roles and of route frameworks, most frequent first."""
    roles = g.symbol.where(F.col("resolved") & F.col("kind").isin(*V.TYPE_KINDS)).groupBy(F.lit("role").alias("what"), F.col("role").alias("value")).agg(F.count("*").alias("n"))
    frameworks = g.route.groupBy(F.lit("framework").alias("what"), F.col("framework").alias("value")).agg(F.count("*").alias("n"))
    return roles.unionByName(frameworks).orderBy("what", F.desc("n"), "value")


def topics(g: CodeGraph) -> DataFrame:
    """Producers by topic, with their members in order; producers without a topic are left out."""
    p = g.producer.where(F.col("topic") != "")
    return p.groupBy("topic").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("member_fqn")).alias("members")).orderBy("topic")


def unresolved_stats(g: CodeGraph, by: str = "reason") -> DataFrame:
    """Unresolved call sites by reason, microservice or role of the caller."""
    who = g.symbol.select(F.col("id").alias("caller_id"), "microservice", F.col("role").alias("caller_role"))
    return g.unresolved.join(who, "caller_id", "left").groupBy(F.coalesce(F.col(by), F.lit("")).alias(by)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def meta(g: CodeGraph) -> DataFrame:
    """One row: counts of every table, and fractions of what is resolved (null where there is nothing)."""
    share = lambda df, c: df.agg(F.avg(c.cast("double")).alias("x"))
    out = g.symbol.groupBy().agg(F.count("*").alias("symbols"), F.sum(F.col("kind").isin(*V.TYPE_KINDS).cast("long")).alias("types"), F.sum(F.col("kind").isin(*V.MEMBER_KINDS).cast("long")).alias("members"))
    edges = None
    for k, e in g.edges.items():
        one = e.agg(F.lit(k).alias("edge"), F.count("*").alias("n"))
        edges = one if edges is None else edges.unionByName(one)
    counts = edges.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge", "n")))).alias("edge_counts"))
    out = out.crossJoin(counts)
    for name, df, c in (("calls_resolved", g.edge("CALLS"), F.col("resolved")), ("routes_resolved", g.route, F.col("resolved")), ("http_calls_matched", g.edge("HTTP_CALLS"), F.col("match").isin("cross_service", "intra_service"))):
        out = out.crossJoin(share(df, c).withColumnRenamed("x", name))
    frameworks = g.route.groupBy("framework").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("framework", "n")))).alias("routes_by_framework"))
    return out.crossJoin(frameworks)


def overview(g: CodeGraph, microservice: str, limit: int = 10) -> DataFrame:
    """What a microservice has: section, n, sample."""
    sections = {
        "routes": g.route.where(F.col("microservice") == microservice).select(F.concat_ws(" ", "method", "path").alias("x")),
        "clients": g.client.where(F.col("microservice") == microservice).select(F.concat_ws(" ", "target_service", "path").alias("x")),
        "producers": g.producer.where(F.col("microservice") == microservice).select(F.col("topic").alias("x")),
        "entities": g.symbol.where((F.col("microservice") == microservice) & (F.col("role") == "ENTITY")).select(F.col("fqn").alias("x")),
    }
    out = None
    for name, df in sections.items():
        one = df.agg(F.lit(name).alias("section"), F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("x")), 1, limit).alias("sample"))
        out = one if out is None else out.unionByName(one)
    return out


def tally(df: DataFrame, dimension: str, contains: str | None = None, top: int = 10) -> DataFrame:
    """The most frequent values of a dimension, of rows whose name contains something."""
    if contains:
        df = df.where(F.lower("name").contains(contains.lower()))
    return df.groupBy(F.coalesce(F.col(dimension), F.lit("")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def vocabulary_context(g: CodeGraph) -> DataFrame:
    """Top five modules, microservices and roles, and top ten tokens of names: what, value, n."""
    types = g.symbol.where(F.col("resolved") & F.col("kind").isin(*V.TYPE_KINDS))
    out = None
    for what, top in (("module", 5), ("microservice", 5), ("role", 5)):
        one = tally(types, what, top=top).withColumn("what", F.lit(what))
        out = one if out is None else out.unionByName(one)
    tokens = types.select(F.explode(X.camel_tokens(F.col("name"))).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10)
    return out.unionByName(tokens.withColumn("what", F.lit("token"))).select("what", "value", "n")
