"""Tables of the property graph. The empty string, not null, means unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

NODES = {
    "symbol": "id string, kind string, name string, fqn string, package string, module string, microservice string, filename string, start_line long, end_line long, "
    "start_byte long, end_byte long, modifiers array<string>, annotations array<string>, capabilities array<string>, role string, signature string, parent_id string, "
    "resolved boolean, generated boolean, generated_by string, search_text string",
    "route": "id string, kind string, framework string, method string, path string, path_template string, path_regex string, topic string, broker string, feign_name string, "
    "feign_url string, microservice string, module string, filename string, start_line long, end_line long, resolved boolean",
    "client": "id string, client_kind string, target_service string, path string, path_template string, path_regex string, method string, member_fqn string, member_id string, "
    "microservice string, module string, filename string, start_line long, end_line long, resolved boolean, source_layer string",
    "producer": "id string, producer_kind string, topic string, broker string, direction string, member_fqn string, member_id string, microservice string, module string, "
    "filename string, start_line long, end_line long, resolved boolean, source_layer string",
    "unresolved_call_site": "id string, caller_id string, call_site_line long, call_site_byte long, arg_count long, callee_simple string, receiver_expr string, reason string",
}
_ENDS = "src string, dst string, source_file string"
EDGES = {
    "EXTENDS": f"{_ENDS}, dst_name string, dst_fqn string, resolved boolean",
    "IMPLEMENTS": f"{_ENDS}, dst_name string, dst_fqn string, resolved boolean",
    "INJECTS": f"{_ENDS}, dst_name string, dst_fqn string, resolved boolean, mechanism string, annotation string, field_or_param string",
    "DECLARES": _ENDS,
    "OVERRIDES": _ENDS,
    "CALLS": f"{_ENDS}, call_site_line long, call_site_byte long, arg_count long, confidence double, strategy string, source string, resolved boolean, callee_declaring_role string",
    "UNRESOLVED_AT": _ENDS,
    "EXPOSES": f"{_ENDS}, confidence double, strategy string",
    "DECLARES_CLIENT": f"{_ENDS}, confidence double, strategy string",
    "DECLARES_PRODUCER": f"{_ENDS}, confidence double, strategy string",
    "HTTP_CALLS": f"{_ENDS}, confidence double, strategy string, method_call string, raw_uri string, match string",
    "ASYNC_CALLS": f"{_ENDS}, confidence double, strategy string, direction string, raw_topic string, match string",
}
CHUNK = (
    "id string, filename string, language string, text string, range_start long, range_end long, embedding array<float>, package string, module string, microservice string, "
    "primary_type_fqn string, primary_type_kind string, role string, capabilities array<string>, annotations_on_type array<string>, symbols array<string>, generated boolean"
)
SYMBOL_COLUMNS = [c.split()[0] for c in NODES["symbol"].split(", ")]


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a table."""
    return [tuple(c.split(" ", 1)) for c in ddl.split(", ")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The table's columns in order and type; what is missing or null is filled: '' for strings, [] for arrays, false, 0. generated_by may be null."""
    default = {"string": F.lit(""), "boolean": F.lit(False), "long": F.lit(0), "array<string>": F.array().cast("array<string>")}
    have = set(df.columns)
    keep_null = {"generated_by"}

    def one(c: str, t: str):  # noqa: ANN202
        if c not in have:
            return F.lit(None) if c in keep_null else default.get(t, F.lit(None))
        return F.col(c) if c in keep_null or t not in default else F.coalesce(F.col(c).cast(t), default[t])

    return df.select(*[one(c, t).cast(t).alias(c) for c, t in columns(ddl)])


def check_edge(edge: str) -> None:
    if edge not in V.EDGES and edge not in V.COMPOSED:
        raise ValueError(f"unknown edge type {edge!r}; one of {', '.join([*V.EDGES, *V.COMPOSED])}")
