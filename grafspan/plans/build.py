"""From source files to a property graph: one parsing pass, then joins.

Every pass is a DataFrame over exploded records. Name resolution, receivers and candidates are joins
with a priority; nothing but the parser runs in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import shared_dir
from .. import vocabulary as V
from ..config import Overrides
from ..functions import keys as K
from ..functions import text as X
from ..graph import CodeGraph, Store
from ..operators import matching, traversal
from ..sources import endpoints, files, java
from ..streaming import incremental



def BLANK() -> Column:  # noqa: N802
    return F.lit("")



def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def _names(values) -> Column:  # noqa: ANN001
    return F.array(*[F.lit(v) for v in values])


class Work:
    """Written intermediate tables of one build, in the folder that the cluster names for checkpoints.

    Each table is made once, whatever reads it later, and plans stay small.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.at = f"{shared_dir(spark)}/build-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.at}/{self.n:03d}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{self.n:03d}")


def _one_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def endpoint_rows(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes and outgoing calls of parsed units, by the record functions."""
    route = "filename string, member_fqn string, kind string, framework string, start_line long, end_line long, http_method string, path string, topic string, broker string, feign_name string, feign_url string, strategy string, confidence double, resolved boolean, source_layer string"
    call = "filename string, member_fqn string, client_kind string, channel string, line long, feign_target_name string, feign_target_url string, path_template_call string, method_call string, topic_call string, broker_call string, raw_uri string, raw_topic string, strategy string, confidence double, resolved boolean, source_layer string"

    def rows(batches, which, names):  # noqa: ANN001, ANN202
        import pandas as pd

        plain = lambda items: [{k: (list(v) if hasattr(v, "tolist") else v) for k, v in (x.asDict() if hasattr(x, "asDict") else x).items()} for x in items]
        for b in batches:
            out = []
            for u in b.itertuples(index=False):
                types, members = {t["fqn"]: t for t in plain(u.types)}, plain(u.members)
                found = endpoints.routes(types, members) if which == "routes" else endpoints.outgoing(types, members, plain(u.fields), plain(u.scope), plain(u.calls))
                out += [{"filename": u.filename} | r for r in found]
            yield pd.DataFrame(out, columns=names)

    names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
    routes = units.mapInPandas(lambda it: rows(it, "routes", names(route)), route)
    return routes, units.mapInPandas(lambda it: rows(it, "calls", names(call)), call)


def roles(types: DataFrame, members: DataFrame, fields: DataFrame) -> DataFrame:
    """Types with role and capabilities: by annotation, then data carriers, then injected messaging types."""
    injected = fields.select(F.col("type_fqn").alias("fqn"), F.col("type").alias("_t")).unionByName(members.where("kind = 'constructor'").select(F.col("type_fqn").alias("fqn"), F.explode("param_types").alias("_t")))
    injected = injected.groupBy("fqn").agg(F.collect_set("_t").alias("_injected"))
    noted = members.select(F.col("type_fqn").alias("fqn"), F.explode("annotations").alias("_a")).groupBy("fqn").agg(F.collect_set("_a").alias("_noted"))
    role, none = _map(V.ROLE_BY_ANNOTATION), X.empty()
    pick = lambda table, arr: F.filter(F.transform(F.coalesce(arr, none), lambda a: F.try_element_at(_map(table), a)), lambda x: x.isNotNull())
    df = types.join(injected, "fqn", "left").join(noted, "fqn", "left")
    by_annotation = F.get(F.filter(F.transform("annotations", lambda a: F.try_element_at(role, a)), lambda x: x.isNotNull()), F.lit(0))
    dto = (F.col("kind") == "record") | F.arrays_overlap("annotations", _names(("Data", "Value"))) | F.col("name").rlike(r"(Dto|DTO|Request|Response)$")
    client = F.arrays_overlap(F.coalesce("_injected", none), _names(V.CAPABILITY_BY_INJECTED_TYPE))
    found = F.concat(pick(V.CAPABILITY_BY_TYPE_ANNOTATION, F.col("annotations")), pick(V.CAPABILITY_BY_METHOD_ANNOTATION, F.col("_noted")), pick(V.CAPABILITY_BY_INJECTED_TYPE, F.col("_injected")), pick(V.CAPABILITY_BY_SUPERTYPE, F.concat("extends", "implements")))
    return df.withColumns({"role": F.coalesce(by_annotation, F.when(dto, "DTO"), F.when(client, "CLIENT"), F.lit("OTHER")), "capabilities": F.array_sort(F.array_distinct(found))}).drop("_injected", "_noted")


def overridden(types: DataFrame, o: Overrides) -> DataFrame:
    """Types with what the project declares: a role by type before one by annotation before what was inferred; capabilities add up."""
    role, more = F.col("role"), F.col("capabilities")
    if o.roles_by_annotation:
        role = F.coalesce(F.get(F.filter(F.transform("annotations", lambda a: F.try_element_at(_map(o.roles_by_annotation), a)), lambda x: x.isNotNull()), F.lit(0)), role)
    if o.roles_by_fqn:
        role = F.coalesce(F.try_element_at(_map(o.roles_by_fqn), F.col("fqn")), role)
    for table, hit in ((o.capabilities_by_annotation, lambda k: F.array_contains("annotations", k)), (o.capabilities_by_fqn, lambda k: F.col("fqn") == k)):
        for k, names in table.items():
            more = F.concat(more, F.when(hit(k), _names(names)).otherwise(X.empty()))
    return types.withColumns({"role": role, "capabilities": F.array_sort(F.array_distinct(more))})


def meta_annotations(types: DataFrame, known: tuple[str, ...], depth: int = 4) -> DataFrame:
    """(annotation, means): own annotations that carry a known one, directly or through others."""
    direct = types.where("kind = 'annotation'").select(F.col("name").alias("src"), F.explode("annotations").alias("dst"))
    return traversal.ancestors(direct, depth).where(F.col("super").isin(*known)).select(F.col("sub").alias("annotation"), F.col("super").alias("means"))


def build(units: DataFrame, places: DataFrame, texts: DataFrame | None = None, overrides: Overrides | None = None) -> CodeGraph:
    """units: parsed files (see sources.java.SCHEMA). places: filename, module, microservice."""
    spark, keep = units.sparkSession, Work(units.sparkSession).keep
    own = keep(places.select("filename", "module", "microservice"))
    units = keep(units)
    # --- nodes ---
    types = units.select("filename", "package", F.explode("types").alias("t")).select("filename", "package", "t.*")
    types = _one_per(types, ["fqn"], [F.desc("filename")])  # of two files with one fqn the greater path wins
    members = units.select("filename", "package", F.explode("members").alias("m")).select("filename", "package", "m.*").join(types.select(F.col("fqn").alias("type_fqn"), "filename"), ["type_fqn", "filename"], "left_semi")
    members = _one_per(members, ["fqn"], ["start_byte"])
    fields = units.select("filename", F.explode("fields").alias("f")).select("filename", "f.*")
    imports = units.select("filename", F.explode("imports").alias("i")).select("filename", "i.*")
    types = roles(types, members, fields).join(own, "filename", "left")
    meta = meta_annotations(types, tuple(V.ROLE_BY_ANNOTATION))
    implied = types.select("fqn", F.explode("annotations").alias("annotation")).join(meta, "annotation").groupBy("fqn").agg(F.min("means").alias("_means"))
    types = types.join(implied, "fqn", "left").withColumn("role", F.when((F.col("role") == "OTHER") & F.col("_means").isNotNull(), F.element_at(_map(V.ROLE_BY_ANNOTATION), F.col("_means"))).otherwise(F.col("role"))).drop("_means")
    types = overridden(types, overrides or Overrides())
    types = keep(types.withColumn("id", K.symbol_id(F.col("kind"), F.col("fqn"), F.col("filename"), F.col("start_byte"))))
    members = members.join(own, "filename", "left").join(types.select(F.col("fqn").alias("type_fqn"), F.col("id").alias("parent_id"), F.col("role").alias("owner_role")), "type_fqn")
    members = members.withColumn("id", K.symbol_id(F.col("kind"), F.col("fqn"), F.col("filename"), F.col("start_byte")))
    fields, imports = keep(fields), keep(imports)
    members = members.withColumn("capabilities", F.array_sort(F.array_distinct(F.filter(F.transform("annotations", lambda a: F.try_element_at(_map(V.CAPABILITY_BY_METHOD_ANNOTATION), a)), lambda x: x.isNotNull()))))
    members = keep(members)
    file_nodes = units.select("filename", "package").join(own, "filename", "left").select(K.symbol_id(F.lit("file"), F.col("filename"), F.col("filename"), F.lit(0)).alias("id"), F.lit("file").alias("kind"), F.element_at(F.split("filename", "/"), -1).alias("name"), F.col("filename").alias("fqn"), "package", "module", "microservice", "filename", F.lit(True).alias("resolved"))
    package_nodes = units.where("package <> ''").select("package").distinct().select(K.symbol_id(F.lit("package"), F.col("package"), BLANK(), F.lit(0)).alias("id"), F.lit("package").alias("kind"), X.simple_name(F.col("package")).alias("name"), F.col("package").alias("fqn"), "package", F.lit(True).alias("resolved"))
    outer = types.select(F.col("fqn").alias("outer_fqn"), F.col("id").alias("_outer"))
    type_nodes = types.join(outer, "outer_fqn", "left").withColumn("parent_id", F.coalesce("_outer", BLANK())).withColumn("resolved", F.lit(True))

    # --- supertypes and injections ---
    supers = F.concat(F.transform("extends", lambda n: F.struct(n.alias("name"), F.lit("EXTENDS").alias("edge"))), F.transform("implements", lambda n: F.struct(n.alias("name"), F.lit("IMPLEMENTS").alias("edge"))))
    wanted = types.select("filename", "package", F.col("fqn").alias("outer"), F.col("id").alias("src"), F.posexplode(supers).alias("at", "s")).select("filename", "package", "outer", "src", "at", "s.name", "s.edge")
    known = types.select("fqn", "name", "package", "outer_fqn", "filename")
    sup = matching.phantom_fqn(matching.resolve_names(wanted, known, imports), imports)
    ids = types.select(F.col("fqn").alias("dst_fqn"), F.col("id").alias("_id"))
    target = lambda df: df.join(ids, "dst_fqn", "left").withColumn("dst", F.coalesce("_id", K.phantom_id(F.col("dst_fqn")))).drop("_id")
    # A Kotlin supertype is an interface if it is known as one.
    sup = target(sup).join(types.select(F.col("fqn").alias("dst_fqn"), F.col("kind").alias("_k")), "dst_fqn", "left")
    sup = sup.withColumn("edge", F.when((F.col("_k") == "interface") & (F.col("edge") == "EXTENDS") & F.col("filename").endswith(".kt"), "IMPLEMENTS").otherwise(F.col("edge"))).drop("_k")
    sup_edges = keep(_one_per(sup.select("edge", "src", "dst", F.col("filename").alias("source_file"), F.col("name").alias("dst_name"), "dst_fqn", F.col("dst_resolved").alias("resolved"), "at"), ["edge", "src", "dst"], ["at"]))
    slots = injections(types, members, fields)
    inj = target(matching.phantom_fqn(matching.resolve_names(slots, known, imports), imports))
    inj_edges = keep(inj.select("src", "dst", F.col("filename").alias("source_file"), F.col("name").alias("dst_name"), "dst_fqn", F.col("dst_resolved").alias("resolved"), "mechanism", "annotation", "field_or_param").dropDuplicates(["src", "dst", "mechanism", "field_or_param"]))
    phantoms = sup_edges.where("not resolved").select("dst", "dst_fqn").unionByName(inj_edges.where("not resolved").select("dst", "dst_fqn")).dropDuplicates(["dst"])
    phantom_nodes = phantoms.select(F.col("dst").alias("id"), F.lit("class").alias("kind"), X.simple_name(F.col("dst_fqn")).alias("name"), F.col("dst_fqn").alias("fqn"), F.lit(False).alias("resolved"))

    declares = members.select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.col("filename").alias("source_file")).unionByName(type_nodes.where("parent_id <> ''").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.col("filename").alias("source_file")))
    direct = sup_edges.select("src", "dst")
    over = matching.override_pairs(members, direct).join(members.select(F.col("id").alias("src"), F.col("filename").alias("source_file")), "src")
    calls, sites, call_phantoms = resolve_calls(units, types, members, fields, imports, sup_edges, keep)

    symbol = type_nodes.unionByName(members.withColumns({"resolved": F.lit(True), "role": F.lit("")}), allowMissingColumns=True)
    for more in (file_nodes, package_nodes, phantom_nodes, call_phantoms):
        symbol = symbol.unionByName(more, allowMissingColumns=True)
    symbol = symbol.dropDuplicates(["id"])
    if texts is not None:
        made = texts.select("filename", files.generated_by(F.col("text"), X.empty()).alias("_g"))
        symbol = symbol.join(made, "filename", "left").withColumns({"generated_by": F.coalesce(F.when(F.array_contains("annotations", "Generated"), "annotation"), "_g"), "generated": F.col("_g").isNotNull() | F.coalesce(F.array_contains("annotations", "Generated"), F.lit(False))}).drop("_g")
    symbol = keep(symbol).withColumn("search_text", X.search_text("name", "fqn", "signature", "package", F.concat_ws(" ", "annotations"), F.concat_ws(" ", "capabilities")))
    edges = {k: sup_edges.where(F.col("edge") == k) for k in ("EXTENDS", "IMPLEMENTS")} | {"INJECTS": inj_edges, "DECLARES": declares, "OVERRIDES": over, "CALLS": calls, "UNRESOLVED_AT": sites.select(F.col("caller_id").alias("src"), F.col("id").alias("dst"), "source_file")}
    tables, endpoint_edges = endpoint_tables(units, members, keep)
    return CodeGraph.of(spark, symbol, edges | endpoint_edges, **tables, unresolved_call_site=sites)


def injections(types: DataFrame, members: DataFrame, fields: DataFrame) -> DataFrame:
    """What types are given from outside: annotated fields, constructor parameters, generated constructors, setters.

    A constructor counts if it is annotated or the only one that has parameters. Interfaces are left out.
    """
    t = types.where("kind <> 'interface'").select(F.col("fqn").alias("type_fqn"), F.col("id").alias("src"), "filename", "package", F.col("annotations").alias("_ta"))
    f = fields.drop("filename").join(t, "type_fqn").where(~F.array_contains("modifiers", "static"))
    note = F.get(F.array_intersect("annotations", _names(V.INJECT_ANNOTATIONS)), F.lit(0))
    cols = lambda df, how, a, slot, name: df.select("filename", "package", F.col("type_fqn").alias("outer"), "src", F.lit(how).alias("mechanism"), a.alias("annotation"), slot.alias("field_or_param"), name.alias("name"))
    out = cols(f.where(F.arrays_overlap("annotations", _names(V.INJECT_ANNOTATIONS))), "field", note, F.col("name"), F.col("type"))
    lombok = F.arrays_overlap("_ta", _names(V.LOMBOK_CONSTRUCTORS))
    every = F.array_contains("_ta", "AllArgsConstructor")
    out = out.unionByName(cols(f.where(lombok & (every | F.array_contains("modifiers", "final"))), "lombok_constructor", F.get(F.array_intersect("_ta", _names(V.LOMBOK_CONSTRUCTORS)), F.lit(0)), F.col("name"), F.col("type")))
    m = members.drop("filename", "package", "id").join(t, "type_fqn")
    ctor = m.where("kind = 'constructor'").withColumn("_all", F.count("*").over(Window.partitionBy("type_fqn")))
    marked = F.arrays_overlap("annotations", _names(V.INJECT_ANNOTATIONS))
    ctor = ctor.where((F.size("param_types") > 0) & (marked | (F.col("_all") == 1)) & ~F.coalesce(F.col("type_fqn").contains("<anon"), F.lit(False)))
    slots = lambda df: df.withColumn("_p", F.explode(F.arrays_zip("param_names", "param_types")))
    out = out.unionByName(cols(slots(ctor), "constructor", F.coalesce(note, BLANK()), F.col("_p.param_names"), F.col("_p.param_types")))
    setter = m.where((F.col("kind") == "method") & marked & (F.size("param_types") == 1))
    out = out.unionByName(cols(slots(setter), "setter", note, F.col("_p.param_names"), F.col("_p.param_types")))
    return out.where(~F.col("name").isin("int", "long", "short", "byte", "boolean", "char", "float", "double", "String", "Int", "Long", "Boolean"))


def resolve_calls(units: DataFrame, types: DataFrame, members: DataFrame, fields: DataFrame, imports: DataFrame, sup_edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(CALLS, unresolved sites, phantom methods) of all call sites."""
    calls = units.select("filename", "package", F.explode("calls").alias("c")).select("filename", "package", "c.*")
    caller = members.select(F.col("fqn").alias("caller_fqn"), F.col("id").alias("caller_id"), F.col("type_fqn").alias("host"), "microservice")
    c = calls.join(caller, "caller_fqn").withColumn("receiver", F.regexp_replace(F.trim("receiver"), r"^this\.", "")).withColumn("site", F.xxhash64("caller_fqn", "line", "byte", "callee"))
    bare = F.col("receiver")
    simple = bare.rlike(r"^[A-Za-z_$][\w$]*$")
    implicit = bare.isin("", "this")
    # Variables: fields (of supertypes too) before parameters before locals.
    scope = units.select("filename", F.explode("scope").alias("s")).select("s.*")
    chain = traversal.ancestors(sup_edges.select("src", "dst").join(types.select(F.col("id").alias("src"), F.col("fqn").alias("_s")), "src").join(types.select(F.col("id").alias("dst"), F.col("fqn").alias("_d")), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst")))
    lines = types.select(F.col("fqn").alias("host"), F.col("fqn").alias("super"), F.lit(0).alias("hops")).unionByName(chain.select(F.col("sub").alias("host"), "super", "hops"))
    by_field = c.where(simple & ~implicit).join(lines, "host").join(fields.select(F.col("type_fqn").alias("super"), F.col("name").alias("receiver"), F.col("type").alias("_type")), ["super", "receiver"]).select("site", "_type", (F.lit(10) + F.col("hops")).alias("_r"))
    by_scope = c.where(simple).join(scope.select(F.col("member_fqn").alias("caller_fqn"), F.col("name").alias("receiver"), F.col("type").alias("_type"), F.col("rank").alias("_k"), F.col("ordinal").alias("_o")), ["caller_fqn", "receiver"]).select("site", "_type", (F.lit(9) - 4 * F.col("_k") - F.col("_o") / 1000).alias("_r"))
    lines = keep(lines)
    variable = _one_per(by_field.select("site", "_type", F.col("_r").cast("double")).unionByName(by_scope.select("site", "_type", F.col("_r").cast("double"))), ["site"], ["_r", "_type"])
    c = c.join(variable.select("site", "_type"), "site", "left")
    c = c.withColumn("name", F.when(F.col("_type").isNotNull(), F.col("_type")).when(simple & ~implicit & (bare != "super"), bare))
    known = types.select("fqn", "name", "package", "outer_fqn", "filename")
    want = c.where("name is not null").select("filename", "package", F.col("host").alias("outer"), "name").distinct()
    found = matching.resolve_names(want, known, imports).withColumnRenamed("outer", "host")
    explicit = imports.where("kind = 'explicit'").groupBy("filename", "name").agg(F.max_by("fqn", "ordinal").alias("_import"))
    unique = matching.unique_by(types, "name", "fqn").withColumnRenamed("fqn", "_unique")
    c = c.join(found.select("filename", "package", "host", "name", "dst_fqn"), ["filename", "package", "host", "name"], "left").join(explicit, ["filename", "name"], "left").join(unique, "name", "left")
    static = imports.where("kind = 'static_explicit'").select("filename", F.col("name").alias("callee"), F.regexp_replace("fqn", r"\.[^.]+$", "").alias("_static"))
    c = c.join(_one_per(static.withColumn("_x", F.lit(1)), ["filename", "callee"], ["_static"]).drop("_x"), ["filename", "callee"], "left")
    own = members.select(F.col("type_fqn").alias("host"), F.col("name").alias("callee")).distinct().withColumn("_own", F.lit(True))
    c = c.join(own, ["host", "callee"], "left")
    wild = imports.where("kind = 'static_wildcard'").select("filename", F.col("fqn").alias("_w"), "ordinal").join(members.where(F.array_contains("modifiers", "static")).select(F.col("type_fqn").alias("_w"), F.col("name").alias("callee")).distinct(), "_w")
    c = c.join(wild.groupBy("filename", "callee").agg(F.min_by("_w", "ordinal").alias("_wild")), ["filename", "callee"], "left")
    parent = _one_per(sup_edges.join(types.select(F.col("id").alias("src"), F.col("fqn").alias("host")), "src").select("host", F.col("dst_fqn").alias("_super"), "edge", "at"), ["host"], ["edge", "at"])
    c = c.join(parent.select("host", "_super"), "host", "left")
    chained = bare.rlike(r"[()\[\].]")
    tiers = [
        (implicit & F.col("_own").isNull() & F.col("_static").isNotNull(), F.col("_static"), "static_import", 0.95),
        (implicit & F.col("_own").isNull() & F.col("_wild").isNotNull(), F.col("_wild"), "static_import_wildcard", 0.85),
        (implicit, F.col("host"), "this_super", 0.95),
        ((bare == "super") & F.col("_super").isNotNull(), F.col("_super"), "this_super", 0.95),
        (bare == "super", F.lit("java.lang.Object"), "implicit_super", 0.90),
        (F.col("dst_fqn").isNotNull(), F.col("dst_fqn"), "import_map", 0.95),
        (F.col("_import").isNotNull(), F.col("_import"), "import_map", 0.95),
        (chained, F.lit(None).cast("string"), "chained_receiver", 0.0),
        (F.col("_unique").isNotNull(), F.col("_unique"), "unique_type_name", 0.75),
    ]
    chosen = None
    for test, fqn, strategy, confidence in tiers:
        value = F.struct(fqn.alias("fqn"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence"))
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    c = c.withColumn("_r", chosen.otherwise(F.struct(F.lit(None).cast("string").alias("fqn"), F.lit("phantom").alias("strategy"), F.lit(0.0).alias("confidence"))))
    c = keep(c.select("filename", "site", "caller_id", "host", "microservice", "receiver", "callee", "arg_count", "line", "byte", F.col("_r.fqn").alias("recv"), F.col("_r.strategy").alias("strategy"), F.col("_r.confidence").alias("confidence")))
    lost = c.where("recv is null")
    sites = lost.select(K.unresolved_id(F.col("caller_id"), F.col("line"), F.col("byte")).alias("id"), "caller_id", F.col("line").alias("call_site_line"), F.col("byte").alias("call_site_byte"), F.col("arg_count").cast("long").alias("arg_count"), F.col("callee").alias("callee_simple"), F.col("receiver").alias("receiver_expr"),
                        F.when(F.col("strategy") == "chained_receiver", "chained_receiver").otherwise("phantom_unresolved_receiver").alias("reason"), F.col("filename").alias("source_file")).dropDuplicates(["id"])
    # Candidates: methods of that name up the hierarchy; those of the right arity, else all; the nearest type first.
    met = c.where("recv is not null").join(lines.select(F.col("host").alias("recv"), "super", "hops"), "recv", "left").withColumn("super", F.coalesce("super", "recv"))
    cand = members.select(F.col("type_fqn").alias("super"), F.col("name").alias("callee"), F.col("id").alias("_m"), "signature", F.size("param_types").alias("_n"), F.col("owner_role"), F.col("microservice").alias("_ms"))
    hit = met.join(cand, ["super", "callee"]).where((F.col("_ms") == F.col("microservice")) | (F.col("_ms") == "") | (F.col("microservice") == ""))
    hit = hit.where((F.col("callee") != "<init>") | (F.col("hops") == 0))
    hit = hit.withColumn("_exact", (F.col("_n") == F.col("arg_count")) | (F.col("arg_count") < 0)).withColumn("_any", F.max("_exact").over(Window.partitionBy("site"))).where("_exact = _any")
    hit = keep(_one_per(hit, ["site", "signature"], ["hops", "super", "_m"])).withColumn("_count", F.count("*").over(Window.partitionBy("site")))
    shape = F.when(F.col("arg_count") < 0, "method_reference").when((F.col("callee") == "<init>") & (F.col("receiver") == "super") & (F.col("strategy") == "implicit_super"), "implicit_super").when(F.col("callee") == "<init>", "constructor")
    good = hit.select("site", "caller_id", "_m", "line", "byte", "arg_count", "confidence", F.coalesce(shape, F.when((F.col("_count") > 1) | ~F.col("_exact"), "overload_ambiguous"), F.col("strategy")).alias("strategy"), "owner_role", "filename")
    resolved = good.select(F.col("caller_id").alias("src"), F.col("_m").alias("dst"), F.col("filename").alias("source_file"), F.col("line").alias("call_site_line"), F.col("byte").alias("call_site_byte"), F.col("arg_count").cast("long").alias("arg_count"), "confidence", "strategy", F.lit("static").alias("source"), F.lit(True).alias("resolved"), F.coalesce("owner_role", F.lit("OTHER")).alias("callee_declaring_role"))
    rest = c.where("recv is not null").join(hit.select("site").distinct(), "site", "left_anti")
    rest = rest.withColumn("_f", F.concat("recv", F.lit("#"), "callee", F.lit("("), F.when(F.col("arg_count") < 0, "?").otherwise(F.col("arg_count").cast("string")), F.lit(")")))
    ghost = rest.select(F.col("caller_id").alias("src"), K.phantom_id(F.col("_f")).alias("dst"), F.col("filename").alias("source_file"), F.col("line").alias("call_site_line"), F.col("byte").alias("call_site_byte"), F.col("arg_count").cast("long").alias("arg_count"), "confidence", F.coalesce(shape, F.col("strategy")).alias("strategy"), F.lit("static").alias("source"), F.lit(False).alias("resolved"), F.lit("OTHER").alias("callee_declaring_role"))
    phantoms = rest.select(K.phantom_id(F.col("_f")).alias("id"), F.lit("method").alias("kind"), F.col("callee").alias("name"), F.col("_f").alias("fqn"), F.lit(False).alias("resolved")).dropDuplicates(["id"])
    edges = resolved.unionByName(ghost).dropDuplicates(["src", "dst", "arg_count", "call_site_line", "call_site_byte"])
    return edges, sites, phantoms


LAYER = {"builtin": 0, "codebase": 1}


def endpoint_tables(units: DataFrame, members: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Routes, clients and producers with their edges; calls are matched with routes and keep phantom routes otherwise."""
    found, out = map(keep, endpoint_rows(units))
    m = members.select(F.col("fqn").alias("member_fqn"), F.col("id").alias("member_id"), "module", "microservice", "filename")
    r = found.drop("filename").join(m, "member_fqn")
    plain = (F.col("kind") == "http_endpoint") & F.col("resolved") & F.col("strategy").isin("annotation", "codebase_route")
    r = r.withColumns({"path_template": F.when(plain, K.path_template(F.col("path"))).otherwise(""), "path_regex": F.when(plain, K.path_regex(F.col("path"))).otherwise("")})
    r = r.withColumn("id", K.route_id(F.col("framework"), F.col("kind"), F.col("http_method"), F.col("path_template"), F.col("path"), F.col("topic"), F.col("broker"), F.col("microservice"))).withColumn("method", F.col("http_method"))
    routes = _one_per(r, ["id"], [F.desc(F.element_at(_map({k: str(v) for k, v in LAYER.items()}), F.col("source_layer"))), "filename", "start_line"])
    exposes = r.select(F.col("member_id").alias("src"), F.col("id").alias("dst"), F.col("filename").alias("source_file"), "confidence", "strategy").dropDuplicates(["src", "dst"])

    o = out.drop("filename").join(m, "member_fqn").withColumns({"path_template": K.path_template(F.col("path_template_call")), "path_regex": K.path_regex(F.col("path_template_call"))})
    http, queue = o.where("channel = 'http'"), o.where("channel = 'async'")
    client_id = K.client_id(F.col("microservice"), F.col("member_fqn"), F.col("client_kind"), F.col("path_template_call"), F.col("method_call"))
    producer_id = K.producer_id(F.col("microservice"), F.col("member_fqn"), F.col("client_kind"), F.col("topic_call"))
    clients = http.select(client_id.alias("id"), "client_kind", F.col("feign_target_name").alias("target_service"), F.col("path_template_call").alias("path"), "path_template", "path_regex", F.col("method_call").alias("method"), "member_fqn", "member_id", "microservice", "module", "filename", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "resolved", "source_layer", "confidence", "strategy")
    producers = queue.select(producer_id.alias("id"), F.col("client_kind").alias("producer_kind"), F.col("topic_call").alias("topic"), F.col("broker_call").alias("broker"), F.lit("outbound").alias("direction"), "member_fqn", "member_id", "microservice", "module", "filename", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "resolved", "source_layer", "confidence", "strategy")
    calls = o.withColumn("call_id", F.when(F.col("channel") == "http", client_id).otherwise(producer_id)).dropDuplicates(["call_id"])
    matched = matching.match_calls(calls, routes.select("id", "kind", "method", "path_regex", "path_template", "microservice", "topic", "broker", "feign_name"))
    none = BLANK()
    kind = F.when(F.col("channel") == "http", "http_endpoint").otherwise("kafka_topic")
    ghost = K.route_id(F.lit("phantom"), kind, F.col("method_call"), F.col("path_template"), F.col("raw_uri"), F.col("topic_call"), F.col("broker_call"), none)
    e = keep(matched.withColumn("dst", F.coalesce("route_id", ghost)).withColumn("confidence", matching.match_confidence(F.col("confidence"), F.col("match"), F.col("microservice"))))
    phantom = e.where("route_id is null").select(F.col("dst").alias("id"), kind.alias("kind"), F.lit("phantom").alias("framework"), F.col("method_call").alias("method"), F.col("path_template_call").alias("path"), "path_template", "path_regex", F.col("topic_call").alias("topic"), F.col("broker_call").alias("broker"), F.lit(False).alias("resolved")).dropDuplicates(["id"])
    edge = lambda which: e.where(F.col("channel") == which).select(F.col("call_id").alias("src"), "dst", F.col("filename").alias("source_file"), "confidence", "strategy", "method_call", "raw_uri", "match", F.lit("outbound").alias("direction"), "raw_topic")
    owned = lambda df: df.select(F.col("member_id").alias("src"), F.col("id").alias("dst"), F.col("filename").alias("source_file"), "confidence", "strategy").dropDuplicates(["src", "dst"])
    tables = {"route": routes.unionByName(phantom, allowMissingColumns=True), "client": clients.dropDuplicates(["id"]), "producer": producers.dropDuplicates(["id"])}
    return tables, {"EXPOSES": exposes, "DECLARES_CLIENT": owned(clients), "DECLARES_PRODUCER": owned(producers), "HTTP_CALLS": edge("http"), "ASYNC_CALLS": edge("async")}


def from_files(sources: DataFrame, all_paths: DataFrame | None = None, overrides: Overrides | None = None) -> CodeGraph:
    """sources: filename, content (binary). all_paths: path of every file, for build markers."""
    places = files.owners(sources.select("filename"), all_paths if all_paths is not None else sources.select(F.col("filename").alias("path")), (overrides or Overrides()).microservices)
    return build(java.parsed(sources), places, sources.select("filename", F.decode("content", "UTF-8").alias("text")), overrides)


def full(spark: SparkSession, root: str, store: Store, overrides: Overrides | None = None, **given) -> int:  # noqa: ANN003
    """Reads a source tree and commits a new version of its graph, with the hashes it was made from."""
    sources = files.scan(spark, root, **given)
    every = files.scan(spark, root, glob="*").select(F.col("filename").alias("path"))
    hashes = sources.select(F.col("filename").alias("path"), F.sha2("content", 256).alias("sha256"))
    return store.write(from_files(sources, every, overrides), {"source_root": root, "mode": "full"}, hashes)


def increment(spark: SparkSession, root: str, store: Store, cap: int = incremental.EXPANSION_CAP, overrides: Overrides | None = None) -> tuple[int | None, str]:
    """Brings a graph up to date: (version, mode). Nothing is written if no file changed.

    Names are resolved over all files, so that the result equals a full build; what did not change keeps
    its rows. Many changes, a stale version or a missing one make a full build.
    """
    if not store.exists():
        return full(spark, root, store, overrides), "full"
    sources = files.scan(spark, root)
    now = sources.select(F.col("filename").alias("path"), F.sha2("content", 256).alias("sha256"))
    changed = Work(spark).keep(incremental.difference(store.files(), now))
    n = changed.count()
    if n == 0:
        return None, "none"
    ok = store.meta().get("ontology_version") == V.ONTOLOGY_VERSION
    if incremental.needs_full(n, ok, True, cap):
        return full(spark, root, store, overrides), "full"
    old, every = store.read(), files.scan(spark, root, glob="*").select(F.col("filename").alias("path"))
    names = changed.select(F.col("path").alias("filename"))
    fresh = from_files(sources, every, overrides)
    graph = incremental.rewritten(old, fresh, names, incremental.dependents(old, names))
    return store.write(graph, {"source_root": root, "mode": "increment"}, now), "increment"
