"""A property graph over the star-schema tables, so that graph operators can be run and checked on them.

region, nation, customer, supplier, orders and part become symbols; DECLARES is the tree region - nation -
customer - order, IMPLEMENTS customer - nation, EXTENDS customer - customer (key over ten), INJECTS supplier - part, CALLS order -
part with a line item as call site, and order - order, as OVERRIDES. Some customers are routes or topics, which orders expose; suppliers
are clients and producers, which orders declare and which call routes. Line items numbered 7 are unresolved sites, too.
``routes`` and ``outgoing`` come from the paths of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import importable
from ..functions import keys as K
from ..graph import CodeGraph

ROLES = {"BUILDING": "CONTROLLER", "AUTOMOBILE": "SERVICE", "MACHINERY": "COMPONENT", "HOUSEHOLD": "REPOSITORY", "FURNITURE": "CLIENT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    region, nation, customer, supplier, orders, part = map(t, ("region", "nation", "customer", "supplier", "orders", "part"))
    none = F.array().cast("array<string>")
    lit = F.lit

    def made(df, kind, key, symbol_kind, name, fqn, module, service, role, parent=lit(""), annotations=none, capabilities=none, modifiers=none, filename=lit(""), line=lit(0)):  # noqa: ANN001, ANN202
        return df.select(_id(kind, key).alias("id"), lit(symbol_kind).alias("kind"), name.alias("name"), fqn.alias("fqn"), module.alias("module"), service.alias("microservice"), role.alias("role"),
                         parent.alias("parent_id"), annotations.alias("annotations"), capabilities.alias("capabilities"), modifiers.alias("modifiers"), lit(True).alias("resolved"), filename.alias("filename"), line.cast("long").alias("start_line"), (line + F.when(line > 0, 9).otherwise(0)).cast("long").alias("end_line"))

    c = F.col
    # Nations and regions are a fixed 30 rows.
    place = nation.join(F.broadcast(region), c("n_regionkey") == c("r_regionkey"))
    cust = customer.join(F.broadcast(place), c("c_nationkey") == c("n_nationkey"))
    supp = supplier.join(F.broadcast(place), c("s_nationkey") == c("n_nationkey"))
    role = F.coalesce(*[F.when(c("c_mktsegment") == k, v) for k, v in ROLES.items()], lit("OTHER"))
    who = cust.select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    ord_ = orders.join(who, c("o_custkey") == c("c_custkey"))
    return (
        made(region, "region", "r_regionkey", "package", c("r_name"), c("r_name"), lit(""), c("r_name"), lit(""))
        .unionByName(made(place, "nation", "n_nationkey", "interface", c("n_name"), F.concat_ws(".", "r_name", "n_name"), lit(""), c("r_name"), lit("CONFIG"), _id("region", "n_regionkey")))
        .unionByName(made(cust, "customer", "c_custkey", "class", c("c_name"), F.concat_ws(".", "n_name", "c_name"), c("c_mktsegment"), c("r_name"), role, _id("nation", "c_nationkey")))
        .unionByName(made(supp, "supplier", "s_suppkey", "class", c("s_name"), F.concat_ws(".", "n_name", "s_name"), lit("SUPPLY"), c("r_name"), lit("ENTITY"), _id("nation", "s_nationkey")))
        .unionByName(made(ord_, "order", "o_orderkey", "method", F.concat(lit("Order"), c("o_orderkey")), F.concat(c("n_name"), lit("."), c("c_name"), lit("#Order"), c("o_orderkey")), c("c_mktsegment"), c("r_name"), lit(""), _id("customer", "o_custkey"), capabilities=F.when(c("o_orderkey") % 11 == 0, F.array(lit("MESSAGE_LISTENER"))).otherwise(none),
                          modifiers=F.when(c("o_orderstatus") == "F", F.array(lit("private"))).otherwise(none), filename=F.concat(lit("src/c"), c("o_custkey"), lit(".java")), line=1 + c("o_orderkey") % 100 * 10))
        .unionByName(made(part, "part", "p_partkey", "record", c("p_name"), F.concat_ws(".", "p_brand", "p_name"), c("p_brand"), lit(""), lit("OTHER"), lit(""), F.array("p_brand", "p_type"), F.array("p_type")))
    )


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    edge = lambda df, a, b, *more: df.select(a.alias("src"), b.alias("dst"), *more)
    declares = (
        edge(t("nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"))
        .unionByName(edge(t("customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey")))
        .unionByName(edge(t("orders"), _id("customer", "o_custkey"), _id("order", "o_orderkey")))
    )
    li = t("lineitem")
    calls = edge(li, _id("order", "l_orderkey"), _id("part", "l_partkey"), c("l_linenumber").cast("long").alias("call_site_line"), c("l_suppkey").alias("call_site_byte"), F.round(1 - c("l_discount"), 6).alias("confidence"),
                 c("l_returnflag").alias("strategy"), c("l_linestatus").alias("source"), F.lit(True).alias("resolved"), F.lit("OTHER").alias("callee_declaring_role"))
    # Methods that call and override others.
    o = t("orders").select(c("o_orderkey").alias("k"), "o_custkey")
    chain = edge(o.where("k % 2 = 0"), _id("order", "k"), F.concat(F.lit("order:"), F.floor(c("k") / 3)), F.lit(0).cast("long").alias("call_site_line"), F.lit(0).cast("long").alias("call_site_byte"), F.lit(0.97).alias("confidence"), F.lit("N").alias("strategy"),
                 F.lit("").alias("source"), F.lit(True).alias("resolved"), F.lit("").alias("callee_declaring_role"))
    calls = calls.unionByName(chain)
    overrides = edge(o.where("k % 4 = 0"), _id("order", "k"), F.concat(F.lit("order:"), F.floor(c("k") / 2)))
    extends = edge(t("customer").where("c_custkey >= 10"), _id("customer", "c_custkey"), F.concat(F.lit("customer:"), F.floor(c("c_custkey") / 10)))
    place = t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    cust = t("customer").join(F.broadcast(place), c("c_nationkey") == c("n_nationkey")).withColumn("k", c("c_custkey"))
    supp = t("supplier").join(F.broadcast(place), c("s_nationkey") == c("n_nationkey")).withColumn("k", c("s_suppkey"))
    http, path = c("k") % 5 == 0, F.concat(F.lit("/c/"), c("k"))
    topic = F.concat(F.lit("t"), c("k") % 50)
    either = lambda a, b: F.when(http, a).otherwise(b)
    route = cust.where("k % 5 < 2").select(
        _id("route", "k").alias("id"), either("http_endpoint", "kafka_topic").alias("kind"), either(F.when(c("k") % 2 == 0, "spring_mvc").otherwise("webflux"), F.lit("kafka")).alias("framework"), either("GET", "").alias("method"), either(path, F.lit("")).alias("path"),
        either(path, F.lit("")).alias("path_template"), either(F.lit(""), topic).alias("topic"), c("r_name").alias("microservice"), c("c_mktsegment").alias("module"), F.lit(True).alias("resolved"))
    exposes = edge(o.where("k % 7 = 0 and o_custkey % 5 < 2"), _id("order", "k"), _id("route", "o_custkey"), F.lit(1.0).alias("confidence"), F.lit("annotation").alias("strategy"))
    client = supp.select(_id("client", "k").alias("id"), F.when(c("k") % 2 == 0, "feign_method").otherwise("rest_template").alias("client_kind"), F.when(c("k") % 2 == 0, c("r_name")).otherwise("").alias("target_service"), F.concat(F.lit("/c/"), c("k") * 5).alias("path"),
                         F.concat(F.lit("/c/"), c("k") * 5).alias("path_template"), F.lit("GET").alias("method"), F.concat_ws(".", "n_name", "s_name").alias("member_fqn"), _id("order", "k").alias("member_id"), c("r_name").alias("microservice"), F.lit("SUPPLY").alias("module"), F.lit(True).alias("resolved"))
    producer = supp.where("k % 2 = 0").select(_id("producer", "k").alias("id"), F.lit("kafka").alias("producer_kind"), topic.alias("topic"), F.lit("kafka").alias("broker"), F.concat_ws(".", "n_name", "s_name").alias("member_fqn"), F.concat(F.lit("order:"), c("k") + 1).alias("member_id"),
                                              c("r_name").alias("microservice"), F.lit("SUPPLY").alias("module"), F.lit(True).alias("resolved"))
    strong = (F.lit(1.0).alias("confidence"), F.lit("annotation").alias("strategy"))
    found = F.when(c("k") % 3 == 0, "cross_service").when(c("k") % 3 == 1, "intra_service").otherwise("ambiguous").alias("match")
    sites = li.where("l_linenumber = 7").select(F.concat_ws(":", F.lit("site"), "l_orderkey", "l_suppkey").alias("id"), _id("order", "l_orderkey").alias("caller_id"), c("l_linenumber").cast("long").alias("call_site_line"), c("l_suppkey").cast("long").alias("call_site_byte"),
                                                F.concat(F.lit("p"), c("l_partkey") % 10).alias("callee_simple"), c("l_returnflag").alias("reason"))
    more = {
        "EXTENDS": extends, "OVERRIDES": overrides, "EXPOSES": exposes,
        "DECLARES_CLIENT": edge(supp, _id("order", "k"), _id("client", "k"), *strong), "DECLARES_PRODUCER": edge(supp.where("k % 2 = 0"), F.concat(F.lit("order:"), c("k") + 1), _id("producer", "k"), *strong),
        "HTTP_CALLS": edge(supp, _id("client", "k"), F.concat(F.lit("route:"), c("k") * 5), F.round(0.5 + c("k") % 5 / 10, 6).alias("confidence"), found),
        "ASYNC_CALLS": edge(supp.where("k % 2 = 0"), _id("producer", "k"), F.concat(F.lit("route:"), c("k") * 5 + 1), F.lit(0.75).alias("confidence"), found),
    }
    injects = edge(li.select("l_suppkey", "l_partkey").distinct(), _id("supplier", "l_suppkey"), _id("part", "l_partkey"))
    implements = edge(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"))
    return CodeGraph.of(spark, symbols(spark, sf_dir), {"DECLARES": declares, "CALLS": calls, "INJECTS": injects, "IMPLEMENTS": implements} | more, route=route, client=client, producer=producer, unresolved_call_site=sites)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, domain, path of every page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"://[^/?#]*?([^./?#]+)(?:[/?#]|$)", 1).alias("domain"), F.regexp_extract("url", r"://[^/?#]+([^?#]*)", 1).alias("path"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GET route for each domain and first path segment, with the page number as a variable."""
    p = page_paths(spark, sf_dir).where(F.col("path").rlike(r"^/[a-z]+/[0-9]+"))
    one = p.select("domain", F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2), F.lit("/{page:[0-9]+}")).alias("path")).distinct()
    none = F.lit("")
    return one.select(K.route_id(F.lit("spring_mvc"), F.lit("http_endpoint"), F.lit("GET"), K.path_template(F.col("path")), F.col("path"), none, none, F.col("domain")).alias("id"), F.lit("http_endpoint").alias("kind"), F.lit("GET").alias("method"),
                      "path", K.path_template(F.col("path")).alias("path_template"), K.path_regex(F.col("path")).alias("path_regex"), F.col("domain").alias("microservice"), none.alias("topic"), none.alias("broker"), none.alias("feign_name"))


def outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an HTTP call; a quarter of the pages names the service that it wants."""
    p = page_paths(spark, sf_dir)
    none = F.lit("")
    feign = F.col("page_id") % 4 == 0
    return p.select(F.col("page_id").alias("call_id"), F.when(feign, "feign_method").otherwise("rest_template").alias("client_kind"), F.lit("http").alias("channel"), F.when(feign, F.col("domain")).otherwise("").alias("feign_target_name"),
                    F.col("path").alias("path_template_call"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method_call"), none.alias("topic_call"), none.alias("broker_call"), F.lit(True).alias("resolved"), F.col("domain").alias("microservice"))
