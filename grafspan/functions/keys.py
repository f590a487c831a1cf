"""Deterministic ids and path templates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha1(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def symbol_id(kind: Column, fqn: Column, path: Column, start_byte: Column) -> Column:
    return _sha1(kind, fqn, path, start_byte)


def phantom_id(name: Column) -> Column:
    return F.sha1(F.concat(F.lit("class|__phantom."), name, F.lit("|")))


def route_id(framework: Column, kind: Column, method: Column, template: Column, raw: Column, topic: Column, broker: Column, microservice: Column) -> Column:
    return F.concat(F.lit("r:"), F.left(_sha1(framework, kind, method, F.when(template != "", template).otherwise(raw), topic, broker, microservice), F.lit(16)))


def client_id(microservice: Column, member: Column, kind: Column, path: Column, method: Column) -> Column:
    return F.concat(F.lit("c:"), F.left(_sha1(microservice, member, kind, path, method), F.lit(16)))


def producer_id(microservice: Column, member: Column, kind: Column, topic: Column) -> Column:
    return F.concat(F.lit("p:"), F.left(_sha1(microservice, member, kind, topic), F.lit(16)))


def unresolved_id(caller: Column, line: Column, byte: Column) -> Column:
    return F.concat_ws(":", F.lit("ucs"), caller, line.cast("string"), byte.cast("string"))


def chunk_id(filename: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", filename, start.cast("string"), end.cast("string"))


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(path, F.lit(""))), "/"), lambda s: s != "")


_VARIABLE = r"^\{[^:{}]+(:[^}]*)?\}$"


def path_template(path: Column) -> Column:
    """``/users/{id:\\d+}`` to ``/users/{}``; an empty path stays empty."""
    parts = F.transform(_segments(path), lambda s: F.when(s.rlike(_VARIABLE), "{}").otherwise(s))
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def path_regex(path: Column) -> Column:
    """Anchored: a variable matches one segment or keeps its own constraint, all else is literal."""
    quote = lambda s: F.regexp_replace(s, r"([^A-Za-z0-9_])", r"\\$1")
    own = lambda s: F.regexp_extract(s, r"^\{[^:{}]+:([^}]+)\}$", 1)
    parts = F.transform(_segments(path), lambda s: F.when(~s.rlike(_VARIABLE), quote(s)).when(own(s) != "", own(s)).otherwise("[^/]+"))
    body = F.concat(F.lit("^/"), F.array_join(parts, "/"), F.lit("/?$"))
    none = F.trim(F.coalesce(path, F.lit(""))) == ""
    return F.when(none, "").when(F.size(_segments(path)) == 0, "^/?$").otherwise(body)


def compose_paths(base: Column, path: Column) -> Column:
    """A class's path and a method's, with one slash between segments."""
    return F.concat(F.lit("/"), F.array_join(F.concat(_segments(base), _segments(path)), "/"))


def route_method(identifier: Column) -> Column:
    """(method, path) of ``GET /x``; nulls if it has another form."""
    p = r"^(?i)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)$"
    return F.when(identifier.rlike(p), F.struct(F.upper(F.regexp_extract(identifier, p, 1)).alias("method"), F.regexp_extract(identifier, p, 2).alias("path")))
