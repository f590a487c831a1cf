"""Outgoing calls matched with routes, and name resolution by priority: joins with an ordered choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocabulary as V
from ..functions import text as X


def match_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls with outcome and, where it is one, the route: call columns, match, route_id, candidates.

    A declared remote interface matches by target service, verb and path, and only if nothing fits by its
    target's name; other HTTP calls by verb and path; asynchronous calls by topic and broker. The path is
    tested against a route's pattern; the number of path segments is an equi key for routes whose pattern
    keeps segments apart, so that the pattern join is not a nested loop.
    """
    calls = calls.withColumn("_call", F.xxhash64(*[F.col(c) for c in calls.columns])) if "call_id" not in calls.columns else calls.withColumn("_call", F.col("call_id"))
    parts = lambda c: F.size(F.filter(F.split(c, "/"), lambda s: s != ""))
    c = calls.withColumn("_n", parts(F.col("path_template_call")))
    r = routes.select(F.col("id").alias("route_id"), F.col("kind").alias("r_kind"), F.col("method").alias("r_method"), F.col("path_regex").alias("r_regex"), F.col("microservice").alias("r_service"), F.col("topic").alias("r_topic"), F.col("broker").alias("r_broker"), F.col("feign_name").alias("r_feign"), parts(F.col("path_template")).alias("_n"))
    http = r.where("r_kind = 'http_endpoint' and r_regex <> ''")
    verb = (F.col("r_method") == "") | (F.col("method_call") == "") | (F.col("r_method") == F.col("method_call"))
    fits = F.expr("path_template_call rlike r_regex") & verb
    feign = F.col("client_kind") == "feign_method"
    by_path = c.where((F.col("channel") == "http") & (~feign | (F.col("path_template_call") != ""))).join(http, "_n")
    service = ~feign | (F.col("feign_target_name") == "") | (F.col("r_service") == F.col("feign_target_name"))
    by_path = by_path.where(fits & service).select("_call", "route_id", "r_service", F.lit(0).alias("_p"))
    by_name = c.where(feign & (F.col("feign_target_name") != "")).join(r, F.col("r_feign") == F.col("feign_target_name")).select("_call", "route_id", "r_service", F.lit(1).alias("_p"))
    by_topic = c.where("channel = 'async'").join(r, (F.col("r_topic") == F.col("topic_call")) & (F.col("r_broker") == F.col("broker_call"))).select("_call", "route_id", "r_service", F.lit(0).alias("_p"))
    found = by_path.unionByName(by_name).unionByName(by_topic).distinct()
    first = found.withColumn("_best", F.min("_p").over(Window.partitionBy("_call"))).where("_p = _best")
    one = first.groupBy("_call").agg(F.count("*").alias("candidates"), F.min("route_id").alias("_route"), F.min("r_service").alias("_service"))
    out = calls.join(one, "_call", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    blank = ~F.col("resolved") & (F.col("path_template_call") == "") & (F.col("topic_call") == "")
    match = (
        F.when(blank, "unresolved").when(F.col("candidates") == 0, "phantom").when(F.col("candidates") > 1, "ambiguous")
        .when((F.col("_service") != "") & (F.col("_service") == F.col("microservice")), "intra_service").otherwise("cross_service")
    )
    return out.withColumn("match", match).withColumn("route_id", F.when(F.col("match").isin("intra_service", "cross_service"), F.col("_route"))).withColumn("candidates", F.when(blank, 0).otherwise(F.col("candidates"))).drop("_call", "_route", "_service")


def match_confidence(base, match, microservice):  # noqa: ANN001, ANN201
    """A call's own confidence, by outcome, and less without a known microservice."""
    table = F.create_map(*[x for k, v in V.MATCH_FACTORS.items() for x in (F.lit(k), F.lit(v))])
    return base * F.element_at(table, match) * F.when(microservice != "", 1.0).otherwise(0.85)


def resolve_names(wanted: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Simple type names to fqns by an ordered search; adds dst_fqn (null if there is none) and rule.

    wanted: filename, package, outer (fqn of the enclosing type or ''), name. types: fqn, name, package,
    outer_fqn, filename. imports: filename, name, fqn, kind (explicit, wildcard). Rules in order:
    nested in an enclosing type, in the same file, explicit import (one that names an unknown type ends
    the search), same package, wildcard import.
    """
    key = ["filename", "package", "outer", "name"]
    w = wanted.select(*key).distinct()
    chain = F.transform(F.sequence(F.lit(1), F.size(F.split("outer", r"\."))), lambda i: F.array_join(F.slice(F.split("outer", r"\."), 1, i), "."))
    up = w.where("outer <> ''").select(*key, F.posexplode(chain).alias("_d", "_o"))
    t = types.select(F.col("fqn").alias("dst_fqn"), F.col("name").alias("t_name"), F.col("package").alias("t_package"), F.col("outer_fqn").alias("t_outer"), F.col("filename").alias("t_file"))
    cols = [*key, "dst_fqn", "_p", "_s", "_end"]
    pick = lambda df, p, s, end=False: df.withColumns({"_p": F.lit(p), "_s": s, "_end": F.lit(end) if isinstance(end, bool) else end}).select(*cols)
    nested = pick(up.join(t, (F.col("_o") == F.col("t_outer")) & (F.col("name") == F.col("t_name"))), 1, -F.col("_d"))
    same_file = pick(w.join(t, (F.col("filename") == F.col("t_file")) & (F.col("name") == F.col("t_name"))), 2, F.length("dst_fqn"))
    ex = imports.where("kind = 'explicit'").select("filename", "name", F.col("fqn").alias("_i"), F.col("ordinal"))
    explicit = w.join(ex, ["filename", "name"]).join(t.select("dst_fqn"), F.col("_i") == F.col("dst_fqn"), "left")
    explicit = pick(explicit, 3, -F.col("ordinal"), F.col("dst_fqn").isNull())
    package = pick(w.join(t.where("t_outer = ''"), (F.col("package") == F.col("t_package")) & (F.col("name") == F.col("t_name"))), 4, F.length("dst_fqn"))
    wild = imports.where("kind = 'wildcard'").select("filename", F.col("fqn").alias("_i"), "ordinal")
    wildcard = pick(w.join(wild, "filename").join(t, (F.col("_i") == F.col("t_package")) & (F.col("name") == F.col("t_name"))), 5, F.col("ordinal"))
    every = nested.unionByName(same_file).unionByName(explicit).unionByName(package).unionByName(wildcard)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_p", "_s", "dst_fqn"))).where("_n = 1")
    rule = F.element_at(F.array(*[F.lit(x) for x in ("nested", "same_file", "import", "package", "wildcard")]), F.col("_p"))
    return wanted.join(first.select(*key, "dst_fqn", F.when(F.col("dst_fqn").isNotNull(), rule).alias("rule")), key, "left")


def phantom_fqn(resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """Guessed fqns of names that no rule resolved: an explicit import, else java.lang, else the first wildcard, else the bare name."""
    ex = imports.where("kind = 'explicit'").groupBy("filename", "name").agg(F.max_by("fqn", "ordinal").alias("_x"))
    wild = imports.where("kind = 'wildcard'").groupBy("filename").agg(F.min_by("fqn", "ordinal").alias("_w"))
    lang = F.col("name").isin("Object", "String", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Character", "Number", "Iterable", "Comparable", "Runnable", "Thread", "Exception", "RuntimeException", "Throwable", "Error", "Enum", "Record", "Void", "Cloneable", "AutoCloseable", "CharSequence", "StringBuilder", "System", "Math")
    guess = F.coalesce("_x", F.when(lang, F.concat(F.lit("java.lang."), "name")), F.concat("_w", F.lit("."), "name"), F.col("name"))
    return resolved.join(ex, ["filename", "name"], "left").join(wild, "filename", "left").withColumn("dst_resolved", F.col("dst_fqn").isNotNull()).withColumn("dst_fqn", F.coalesce("dst_fqn", guess)).drop("_x", "_w")


def unique_by(df: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value) of names that one value alone has."""
    return df.groupBy(name).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def override_pairs(members: DataFrame, supers: DataFrame) -> DataFrame:
    """(src, dst): non-static methods and those of direct supertypes with the same signature. members: id, parent_id, signature, modifiers, kind."""
    m = members.where((F.col("kind") == "method") & ~F.array_contains("modifiers", "static")).select("id", "parent_id", "signature")
    sub = m.select(F.col("id").alias("src"), F.col("parent_id").alias("_sub"), "signature")
    sup = m.select(F.col("id").alias("dst"), F.col("parent_id").alias("_sup"), "signature")
    return sub.join(supers.select(F.col("src").alias("_sub"), F.col("dst").alias("_sup")).distinct(), "_sub").join(sup, ["_sup", "signature"]).select("src", "dst").distinct()


def collapse_supertypes(candidates: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Candidates of a call site without those whose declaring type is a supertype of another candidate's with the same signature."""
    c, o = candidates.alias("c"), candidates.alias("o")
    worse = c.join(o, (F.col("c.site") == F.col("o.site")) & (F.col("c.signature") == F.col("o.signature")) & (F.col("c.type") != F.col("o.type")))
    worse = worse.join(ancestors.alias("a"), (F.col("a.sub") == F.col("o.type")) & (F.col("a.super") == F.col("c.type"))).select("c.site", "c.id").distinct()
    return candidates.join(worse, ["site", "id"], "left_anti")


def external(df: DataFrame, fqn: str = "fqn") -> DataFrame:
    return df.where(X.is_external(F.col(fqn)))
