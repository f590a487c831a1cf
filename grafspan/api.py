"""Five calls over an index: search, find, describe, neighbors, resolve; and the reports around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CodeGraph, Store
from .operators import aggregates, analytics, lookups, retrieval, traversal
from .operators.analytics import Result, enveloped
from .operators.filters import NodeFilter
from .plans import build
from .sources import files

#: Columns of a node by detail.
DETAIL = {"brief": ["id", "kind", "fqn"], "normal": ["id", "kind", "name", "fqn", "role", "module", "microservice", "filename", "start_line", "end_line", "signature"], "full": None}


@dataclass
class Index:
    """A committed graph and, if there is one, its full-text index and vocabulary. A scope is the default microservice."""

    graph: CodeGraph
    scope: str | None = None
    text_index: DataFrame | None = None
    vocabulary: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, scope: str | None = None) -> Index:
        graph = Store(spark, path).read()
        tokens = retrieval.search_text(graph)
        names = graph.symbol.where("resolved")
        return cls(graph, scope, retrieval.postings(tokens, "id", F.col("tokens")), retrieval.vocabulary(names))

    def _where(self, where: dict | NodeFilter | None) -> NodeFilter:
        f = NodeFilter.of(where)
        return f if f.microservice or not self.scope else NodeFilter.of(f.set_fields() | {"microservice": self.scope})

    def search(self, query: str, where: dict | None = None, limit: int = 10, offset: int = 0, detail: str = "normal", min_score: float = 0.0, dedup: bool = True) -> Result:
        """Symbols by lexical score; an explanation if there are none."""
        hits = retrieval.run_lexical(self.graph, query, self._where(where), limit + 1, offset, dedup, self.text_index, min_score)
        out = enveloped(projected(hits, detail, ["score"]).orderBy(F.desc("score"), "fqn", "id"), limit)
        return out if out.rows else analytics.diagnose(self.graph, query, where, self.vocabulary)

    def find(self, kind: str = "symbol", where: dict | None = None, limit: int = 20, offset: int = 0, detail: str = "normal") -> Result:
        return enveloped(projected(lookups.find(self.graph, kind, self._where(where) if kind == "symbol" else where, limit + 1, offset), detail), limit)

    def describe(self, identifier: str) -> Result:
        found = self.resolve(identifier)
        return analytics.describe(self.graph, found.rows[0]["id"]) if found.status == "one" else found

    def neighbors(self, ids: list[str], edge_types: list[str], direction: str = "out", **given) -> Result:  # noqa: ANN003
        limit = given.pop("limit", 50)
        return enveloped(lookups.neighbors(self.graph, ids, edge_types, direction, limit=limit + 1, **given), limit)

    def resolve(self, identifier: str, kind: str | None = None) -> Result:
        return analytics.resolve(self.graph, identifier, kind, microservice=self.scope)

    # --- reports ---

    def callers(self, needle: str, depth: int = 1, limit: int = 100) -> Result:
        return enveloped(traversal.callers(self.graph, needle, depth, limit=limit + 1), limit)

    def callees(self, needle: str, depth: int = 1, limit: int = 100) -> Result:
        return enveloped(traversal.callees(self.graph, needle, depth, limit=limit + 1), limit)

    def impact(self, needle: str, depth: int = 3, limit: int = 100) -> Result:
        return enveloped(traversal.impact(self.graph, needle, depth, limit + 1, self.scope).select("id", "fqn", "depth"), limit)

    def flow(self, route: str, hops: int = 3, limit: int = 200) -> Result:
        found = analytics.resolved(self.graph, route, "route").first()
        return enveloped(traversal.request_flow(self.graph, found["id"], hops), limit) if found else Result("none", message=f"no route {route}")

    def decompose(self, type_fqn: str, depth: int = 2) -> Result:
        return enveloped(traversal.trace_flow(self.graph, [type_fqn], depth), 200)

    def overview(self, microservice: str) -> Result:
        return enveloped(aggregates.overview(self.graph, microservice), 10)

    def status(self) -> Result:
        return enveloped(aggregates.meta(self.graph), 1)

    def review(self, diff: str) -> Result:
        """Risk of a unified diff, with the symbols that it changes."""
        changed = analytics.changed_symbols(self.graph, files.diff_hunks(self.graph.spark, diff)).persist()
        report = analytics.risk(self.graph, changed).first().asDict() | {"changed": [r.asDict() for r in changed.orderBy("id").collect()], "notes": files.parse_diff(diff)[1]}
        changed.unpersist()
        return Result("ok", [report])


def projected(df: DataFrame, detail: str = "normal", more: list[str] | None = None) -> DataFrame:
    if detail not in DETAIL:
        raise ValueError(f"detail is one of {', '.join(DETAIL)}")
    wanted = DETAIL[detail] or df.columns
    return df.select(*[c for c in [*wanted, *(more or [])] if c in df.columns])


def init(spark: SparkSession, root: str, path: str) -> int:
    """The first index; refuses to replace one."""
    store = Store(spark, path)
    if store.exists():
        raise FileExistsError(f"{path} holds an index; use increment or reprocess")
    return build.full(spark, root, store)


def reprocess(spark: SparkSession, root: str, path: str) -> int:
    return build.full(spark, root, Store(spark, path))


def increment(spark: SparkSession, root: str, path: str) -> tuple[int | None, str]:
    return build.increment(spark, root, Store(spark, path))
