"""Node and edge filters: validated records that compile to one predicate column each."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Which fields a kind of node understands.
_COMMON = {"module", "microservice", "filename_contains", "exclude_kinds"}
APPLICABLE = {
    "symbol": _COMMON | {"role", "roles", "exclude_roles", "annotation", "capability", "capabilities", "fqn_contains", "fqn_prefix", "fqn_in", "symbol_kind", "symbol_kinds", "package_prefix", "generated", "resolved", "name"},
    "route": _COMMON | {"method", "path_contains", "framework", "topic", "route_kind", "resolved"},
    "client": _COMMON | {"method", "path_contains", "client_kind", "target_service", "source_layer", "resolved"},
    "producer": _COMMON | {"topic", "producer_kind", "source_layer", "resolved"},
}


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class NodeFilter:
    """All given fields must hold. A node without a role passes an exclusion of roles."""

    role: str | None = None
    roles: tuple[str, ...] | None = None
    exclude_roles: tuple[str, ...] | None = None
    annotation: str | None = None
    capability: str | None = None
    capabilities: tuple[str, ...] | None = None
    fqn_contains: str | None = None
    fqn_prefix: str | None = None
    fqn_in: tuple[str, ...] | None = None
    symbol_kind: str | None = None
    symbol_kinds: tuple[str, ...] | None = None
    exclude_kinds: tuple[str, ...] | None = None
    package_prefix: str | None = None
    name: str | None = None
    module: str | None = None
    microservice: str | None = None
    filename_contains: str | None = None
    generated: bool | None = None
    resolved: bool | None = None
    method: str | None = None
    path_contains: str | None = None
    framework: str | None = None
    topic: str | None = None
    route_kind: str | None = None
    client_kind: str | None = None
    producer_kind: str | None = None
    target_service: str | None = None
    source_layer: str | None = None

    @classmethod
    def of(cls, given: dict | NodeFilter | None) -> NodeFilter:
        """From a mapping; unknown keys are refused."""
        if given is None or isinstance(given, NodeFilter):
            return given or cls()
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown filter fields: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def set_fields(self) -> dict:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def check(self, kind: str) -> None:
        if wrong := set(self.set_fields()) - APPLICABLE[kind]:
            raise ValueError(f"filter fields that don't apply to {kind}: {', '.join(sorted(wrong))}")

    def column(self, kind: str = "symbol", present: list[str] | None = None) -> Column:
        """The predicate; fields whose column is not among ``present`` are left out, as in older tables."""
        self.check(kind)
        c = F.col
        make = {
            "role": lambda v: c("role") == v,
            "roles": lambda v: c("role").isin(*v),
            "exclude_roles": lambda v: c("role").isNull() | ~c("role").isin(*v),
            "annotation": lambda v: F.array_contains("annotations", v),
            "capability": lambda v: F.array_contains("capabilities", v),
            "capabilities": lambda v: F.arrays_overlap("capabilities", F.array(*map(F.lit, v))),
            "fqn_contains": lambda v: c("fqn").contains(v),
            "fqn_prefix": lambda v: c("fqn").startswith(v),
            "fqn_in": lambda v: c("fqn").isin(*v),
            "symbol_kind": lambda v: c("kind") == v,
            "symbol_kinds": lambda v: c("kind").isin(*v),
            "exclude_kinds": lambda v: ~c("kind").isin(*v),
            "package_prefix": lambda v: (c("package") == v) | c("package").startswith(f"{v}."),
            "name": lambda v: c("name") == v,
            "module": lambda v: c("module") == v,
            "microservice": lambda v: c("microservice") == v,
            "filename_contains": lambda v: c("filename").contains(v),
            "generated": lambda v: F.coalesce(c("generated"), F.lit(False)) == v,
            "resolved": lambda v: c("resolved") == v,
            "method": lambda v: F.upper("method") == v.upper(),
            "path_contains": lambda v: c("path").contains(v),
            "framework": lambda v: c("framework") == v,
            "topic": lambda v: c("topic") == v,
            "route_kind": lambda v: c("kind") == v,
            "client_kind": lambda v: c("client_kind") == v,
            "producer_kind": lambda v: c("producer_kind") == v,
            "target_service": lambda v: c("target_service") == v,
            "source_layer": lambda v: c("source_layer") == v,
        }
        reads = {"roles": "role", "exclude_roles": "role", "annotation": "annotations", "capability": "capabilities", "fqn_contains": "fqn", "fqn_prefix": "fqn", "fqn_in": "fqn", "symbol_kind": "kind", "symbol_kinds": "kind", "exclude_kinds": "kind", "package_prefix": "package", "filename_contains": "filename", "path_contains": "path", "route_kind": "kind"}
        wanted = {k: v for k, v in self.set_fields().items() if present is None or reads.get(k, k) in present}
        # A role and a capability set given together are alternatives.
        if "roles" in wanted and "capabilities" in wanted:
            either = make["roles"](wanted.pop("roles")) | make["capabilities"](wanted.pop("capabilities"))
            return both([either, *[make[k](v) for k, v in wanted.items()]])
        return both([make[k](v) for k, v in wanted.items()])


@dataclass(frozen=True)
class EdgeFilter:
    min_confidence: float | None = None
    include_strategies: tuple[str, ...] | None = None
    exclude_strategies: tuple[str, ...] | None = None
    callee_declaring_role: str | None = None
    callee_declaring_roles: tuple[str, ...] | None = None
    exclude_callee_declaring_roles: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.include_strategies and self.exclude_strategies:
            raise ValueError("include_strategies and exclude_strategies exclude each other")
        if sum(x is not None for x in (self.callee_declaring_role, self.callee_declaring_roles, self.exclude_callee_declaring_roles)) > 1:
            raise ValueError("only one filter on the callee's role may be given")

    @classmethod
    def of(cls, given: dict | EdgeFilter | None) -> EdgeFilter:
        if given is None or isinstance(given, EdgeFilter):
            return given or cls()
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown edge filter fields: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def needs(self) -> set[str]:
        out = {"confidence"} if self.min_confidence is not None else set()
        out |= {"strategy"} if self.include_strategies or self.exclude_strategies else set()
        roles = (self.callee_declaring_role, self.callee_declaring_roles, self.exclude_callee_declaring_roles)
        return out | ({"callee_declaring_role"} if any(x is not None for x in roles) else set())

    def column(self, present: list[str] | None = None) -> Column:
        if present is not None and (lacking := self.needs() - set(present)):
            raise ValueError(f"the edge has no {', '.join(sorted(lacking))}")
        parts = []
        if self.min_confidence is not None:
            parts.append(F.col("confidence") >= self.min_confidence)
        if self.include_strategies:
            parts.append(F.col("strategy").isin(*self.include_strategies))
        if self.exclude_strategies:
            parts.append(~F.col("strategy").isin(*self.exclude_strategies))
        role = F.col("callee_declaring_role")
        if self.callee_declaring_role is not None:
            parts.append(role == self.callee_declaring_role)
        if self.callee_declaring_roles is not None:
            parts.append(role.isin(*self.callee_declaring_roles))
        if self.exclude_callee_declaring_roles is not None:
            parts.append(role.isNull() | ~role.isin(*self.exclude_callee_declaring_roles))
        return both(parts)


def scoped(df: DataFrame, module: str | None = None, microservice: str | None = None) -> DataFrame:
    return df.where(both([F.col(k) == v for k, v in (("module", module), ("microservice", microservice)) if v]))


def chunk_filter(present: list[str], f: NodeFilter, path: str | None = None) -> Column:
    """The node predicate over a chunk table, whose annotations and kind are those of its primary type."""
    renamed = {"annotations_on_type": "annotations", "primary_type_kind": "kind", "primary_type_fqn": "fqn"}
    predicate = f.column("symbol", [*present, *[renamed[c] for c in present if c in renamed]])
    return predicate if path is None else predicate & F.col("filename").contains(path)


def as_nodes(chunks: DataFrame) -> DataFrame:
    """Chunks with the column names that node filters read."""
    return chunks.withColumns({"annotations": F.col("annotations_on_type"), "kind": F.col("primary_type_kind"), "fqn": F.col("primary_type_fqn")})
