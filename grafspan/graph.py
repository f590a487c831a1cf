"""The property graph as named tables, and a versioned folder that holds them."""

from __future__ import annotations

import contextlib
import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from . import vocabulary as V


@dataclass(frozen=True)
class CodeGraph:
    spark: SparkSession
    symbol: DataFrame
    edges: dict[str, DataFrame] = field(default_factory=dict)
    route: DataFrame | None = None
    client: DataFrame | None = None
    producer: DataFrame | None = None
    unresolved: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, symbol: DataFrame, edges: dict[str, DataFrame], **nodes: DataFrame) -> CodeGraph:
        """Tables that lack columns are filled up to the schema; edges that are absent are empty."""
        none = lambda ddl: spark.createDataFrame([], ddl)
        full = {k: schema.conform(edges[k], d) if k in edges else none(d) for k, d in schema.EDGES.items()}
        tables = {k: schema.conform(nodes[k], schema.NODES[k]) if k in nodes else none(schema.NODES[k]) for k in ("route", "client", "producer")}
        sites = nodes.get("unresolved_call_site")
        ddl = schema.NODES["unresolved_call_site"]
        return cls(spark, schema.conform(symbol, schema.NODES["symbol"]), full, **tables, unresolved=schema.conform(sites, ddl) if sites is not None else none(ddl))

    def edge(self, kind: str) -> DataFrame:
        schema.check_edge(kind)
        return self.edges[kind]

    def node(self, kind: str) -> DataFrame:
        return {"symbol": self.symbol, "route": self.route, "client": self.client, "producer": self.producer}[kind]

    def all_edges(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """(edge_type, src, dst) of several edge tables."""
        out = None
        for k in kinds or tuple(V.EDGES):
            one = self.edge(k).select(F.lit(k).alias("edge_type"), "src", "dst")
            out = one if out is None else out.unionByName(one)
        return out

    def node_ids(self) -> DataFrame:
        """Ids of all nodes with the kind of table they are in."""
        out = None
        for k in ("symbol", "route", "client", "producer"):
            one = self.node(k).select("id", F.lit(k).alias("node_kind"))
            out = one if out is None else out.unionByName(one)
        return out

    def with_edges(self, **edges: DataFrame) -> CodeGraph:
        return replace(self, edges=self.edges | edges)


class Store:
    """A folder of versions. Readers follow CURRENT; a new version is written beside it and then named there.

    A reader keeps the version that it opened, so a rebuild never changes what it sees.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions: those with a complete marker."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.path}/{n}/_COMMITTED")))

    def exists(self) -> bool:
        return bool(self.versions())

    def write(self, graph: CodeGraph, meta: dict | None = None, files: DataFrame | None = None) -> int:
        """Every table as Parquet in a new version; the marker is created last, in one step."""
        done = self.versions()
        version = done[-1] + 1 if done else 1
        at = f"{self.path}/v{version}"
        self._fs.delete(self._path(at), True)
        for k in ("symbol", "route", "client", "producer"):
            graph.node(k).write.mode("overwrite").parquet(f"{at}/{k}")
        graph.unresolved.write.mode("overwrite").parquet(f"{at}/unresolved_call_site")
        for k, df in graph.edges.items():
            df.write.mode("overwrite").parquet(f"{at}/edge_{k.lower()}")
        if files is not None:
            files.write.mode("overwrite").parquet(f"{at}/files")
        info = {"ontology_version": V.ONTOLOGY_VERSION} | (meta or {})
        self.spark.range(1).select(F.lit(json.dumps(info)).alias("json")).coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")
        self._fs.create(self._path(f"{at}/_COMMITTED")).close()
        return version

    def meta(self, version: int | None = None) -> dict:
        version = version or self.versions()[-1]
        return json.loads(self.spark.read.parquet(f"{self.path}/v{version}/meta").first()["json"])

    def read(self, version: int | None = None) -> CodeGraph:
        if not self.exists():
            raise FileNotFoundError(f"no graph in {self.path}")
        version = version or self.versions()[-1]
        if (have := self.meta(version).get("ontology_version", 0)) < V.ONTOLOGY_VERSION:
            raise ValueError(f"the graph has ontology version {have}; {V.ONTOLOGY_VERSION} is needed: rebuild it")
        load = lambda name: self.spark.read.parquet(f"{self.path}/v{version}/{name}")
        return CodeGraph(self.spark, load("symbol"), {k: load(f"edge_{k.lower()}") for k in schema.EDGES}, load("route"), load("client"), load("producer"), load("unresolved_call_site"))

    def files(self, version: int | None = None) -> DataFrame:
        """(path, sha256) of what the version was built from."""
        return self.spark.read.parquet(f"{self.path}/v{version or self.versions()[-1]}/files")

    def erase(self, yes: bool = False) -> None:
        if not yes:
            raise ValueError("erasing needs yes=True")
        self._fs.delete(self._path(self.path), True)


@contextlib.contextmanager
def single_writer(path: str | Path):
    """A lock file beside the index; a second writer is refused."""
    lock = Path(f"{path}.lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"{lock} is held by another writer") from None
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        lock.unlink(missing_ok=True)
