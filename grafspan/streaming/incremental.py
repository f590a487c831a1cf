"""Incremental work: hash differences, dependents, scoped rewrites, and bursts of change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CodeGraph

#: More changed files than this make a full rebuild.
EXPANSION_CAP = 50
DEPENDENCY_EDGES = ("EXTENDS", "IMPLEMENTS", "INJECTS", "CALLS", "OVERRIDES", "DECLARES")


def hashes(files: DataFrame, path: str = "path", content: Column | None = None) -> DataFrame:
    """(path, sha256) of files."""
    return files.select(F.col(path).alias("path"), F.sha2(content if content is not None else F.col("content"), 256).alias("sha256"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed; equal files are left out. One full outer join."""
    o, n = old.withColumnRenamed("sha256", "_old"), new.withColumnRenamed("sha256", "_new")
    both = o.join(n, "path", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select("path", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change"))


def dependents(g: CodeGraph, changed: DataFrame) -> DataFrame:
    """Files (filename) with an edge into a symbol of a changed file, or that use an annotation declared in one."""
    hit = g.symbol.join(changed.select("filename").distinct(), "filename", "left_semi")
    into = g.all_edges(DEPENDENCY_EDGES).join(hit.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    by_edge = g.symbol.join(into, "id", "left_semi").select("filename")
    names = hit.where("kind = 'annotation'").select(F.col("name").alias("_a"))
    by_annotation = g.symbol.select("filename", F.explode("annotations").alias("_a")).join(names, "_a", "left_semi").select("filename")
    return by_edge.unionByName(by_annotation).where("filename <> ''").distinct().join(changed.select("filename"), "filename", "left_anti")


def rewritten(g: CodeGraph, fresh: CodeGraph, changed: DataFrame, dependent: DataFrame) -> CodeGraph:
    """The graph with a scope replaced: edges of changed and dependent files, nodes of changed ones and of no file.

    What lies outside the scope is kept as it is; rows of the scope come from ``fresh``.
    """
    scope = changed.select("filename").unionByName(dependent.select("filename")).distinct()
    files = scope.withColumnRenamed("filename", "source_file")
    edges = {k: e.join(files, "source_file", "left_anti").unionByName(fresh.edges[k].join(files, "source_file", "left_semi")) for k, e in g.edges.items()}
    keep = g.symbol.where("filename <> ''").join(changed.select("filename").distinct(), "filename", "left_anti")
    new = fresh.symbol.join(keep.select("id"), "id", "left_anti")
    return CodeGraph(g.spark, keep.unionByName(new), edges, fresh.route, fresh.client, fresh.producer, fresh.unresolved)


def needs_full(n_changed: int, version_ok: bool, clean: bool, cap: int = EXPANSION_CAP) -> bool:
    return not version_ok or not clean or n_changed > cap


# --- events ---


def kinds_of(path: Column) -> Column:
    """What a changed file bears on: vectors, and the graph if its language is parsed; nothing for ignored files."""
    code = path.rlike(r"\.(java|kt)$")
    sql = path.rlike(r"(^|/)src/main/resources/db/migration/[^/]*\.sql$")
    yaml = path.rlike(r"(^|/)src/main/resources/application[^/]*\.ya?ml$")
    none = F.array().cast("array<string>")
    return F.when(code, F.array(F.lit("vectors"), F.lit("graph"))).when(sql | yaml, F.array(F.lit("vectors"))).otherwise(none)


def bursts(events: DataFrame, time: str, kind: str, gap: str, by: list[str] | None = None) -> DataFrame:
    """Trailing debounce: events with less than a gap between them are one burst (start, end, n, kinds)."""
    out = events.groupBy(*(by or []), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(kind)).alias("kinds"))
    return out.select(*(by or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "kinds")


def watch(events: DataFrame, reindex, checkpoint: str, gap: str = "2 seconds", late: str = "10 seconds"):  # noqa: ANN001, ANN201
    """A streaming query that calls reindex(spark, kinds) once for each quiet gap after changes.

    events: a stream of (path, ts). A rebuild of the graph is asked for only if a parsed language changed.
    """
    named = events.withColumn("kind", F.explode(kinds_of(F.col("path")))).withWatermark("ts", late)
    # Streams need a key beside a session window; this one is the same for all paths.
    done = named.groupBy((F.length("path") < 0).alias("_all"), F.session_window("ts", gap).alias("w")).agg(F.collect_set("kind").alias("kinds"))

    def each(batch: DataFrame, number: int) -> None:
        kinds = {k for r in batch.select("kinds").collect() for k in r["kinds"]}
        if kinds:
            reindex(batch.sparkSession, kinds)

    return done.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).start()


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of the files under a root, as they are now; a stream of new files alone would miss edits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return hashes(files)
