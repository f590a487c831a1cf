"""Source trees: which files count, whose they are, and diffs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import importable

#: Folders that never count, those that don't beside a build file, and build files.
PRUNED = ".git .idea .venv node_modules".split()
BUILD_OUTPUT = "target build out".split()
BUILD_FILES = "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts".split()


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file. Later rules win over earlier ones; ``!`` takes back."""

    pattern: str
    layer: str = "builtin"
    base: str = ""

    @property
    def negated(self) -> bool:
        return self.pattern.startswith("!")

    def regex(self) -> str:
        """gitignore syntax as a regular expression over the path relative to the root."""
        p = self.pattern.lstrip("!").rstrip()
        folder = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        p = p.lstrip("/")
        out, i = "", 0
        while i < len(p):
            if p.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif p.startswith("**", i):
                out, i = out + ".*", i + 2
            elif p[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif p[i] == "?":
                out, i = out + "[^/]", i + 1
            elif p[i] == "[" and "]" in p[i + 1 :]:
                j = p.index("]", i + 1)
                out, i = out + p[i : j + 1].replace("[!", "[^"), j + 1
            else:
                out, i = out + re.escape(p[i]), i + 1
        base = re.escape(self.base.strip("/")) + "/" if self.base.strip("/") else ""
        return f"^{base}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def rules_of(text: str, layer: str, base: str = "") -> list[IgnoreRule]:
    lines = [x.rstrip() for x in text.splitlines()]
    return [IgnoreRule(x, layer, base) for x in lines if x and not x.startswith("#")]


BUILTIN = [IgnoreRule(f"{p}/") for p in PRUNED]


def explained(files: DataFrame, rules: list[IgnoreRule], path: str = "path") -> DataFrame:
    """Adds ignored, and the layer and pattern of the rule that decides: the last one that matches."""
    hits = F.array(*[F.when(F.col(path).rlike(r.regex()), F.struct(F.lit(i).alias("at"), F.lit(not r.negated).alias("ignored"), F.lit(r.layer).alias("layer"), F.lit(r.pattern).alias("pattern"))) for i, r in enumerate(rules)])
    won = F.array_max(F.filter(hits, lambda x: x.isNotNull()))
    return files.withColumn("_w", won).select(*files.columns, F.coalesce("_w.ignored", F.lit(False)).alias("ignored"), F.col("_w.layer").alias("layer"), F.col("_w.pattern").alias("pattern"))


def glob_to_regex(glob: str) -> str:
    return IgnoreRule("/" + glob.lstrip("/")).regex()


def excluded(path: Column, globs: list[str]) -> Column:
    """Any of the globs, at the root or below any folder."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_to_regex(g)) | path.rlike(glob_to_regex(f"**/{g}"))
    return out


def without_build_output(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that are not below a build output folder which stands beside a build file."""
    folder = F.regexp_extract(path, r"^(.*?)[^/]+$", 1)
    beside = files.where(F.element_at(F.split(path, "/"), -1).isin(*BUILD_FILES)).select(folder.alias("_f")).distinct()
    roots = beside.select(F.explode(F.array(*[F.concat("_f", F.lit(f"{b}/")) for b in BUILD_OUTPUT])).alias("_out"))
    # Every folder of a path is a key, so the folders are joined by equality.
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    bad = files.select(path, F.explode(prefixes).alias("_out")).join(roots, "_out", "left_semi").select(path).distinct()
    return files.join(bad, path, "left_anti")


def scan(spark: SparkSession, root: str, glob: str = "*.{java,kt}", rules: list[IgnoreRule] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(filename relative to the root, content) of the files that count."""
    importable(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    rel = F.element_at(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), re.escape(base), 2), -1)
    files = raw.select(rel.alias("filename"), "content")
    files = explained(files, [*BUILTIN, *(rules or [])], "filename").where("not ignored").select("filename", "content")
    return files.where(~excluded(F.col("filename"), exclude)) if exclude else files


#: Kinds of chunked files and their path patterns.
SOURCES = {"java": r"\.java$", "kotlin": r"\.kt$", "sql": r"(^|/)src/main/resources/db/migration/[^/]*\.sql$", "yaml": r"(^|/)src/main/resources/application[^/]*\.ya?ml$"}


def kind_of(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(p), k) for k, p in SOURCES.items()])


def owners(files: DataFrame, all_paths: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Adds module (innermost folder with a build file) and microservice (an override, else the outermost such folder below the root, else the first folder)."""
    name = F.element_at(F.split("path", "/"), -1)
    marked = all_paths.where(name.isin(*BUILD_FILES)).select(F.regexp_replace("path", r"/?[^/]+$", "").alias("_dir")).distinct()
    parts = F.split("filename", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = files.select("filename", F.posexplode(dirs).alias("_d", "_dir")).join(marked, "_dir")
    found = up.groupBy("filename").agg(F.max_by("_dir", "_d").alias("_in"), F.min_by("_dir", "_d").alias("_out"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    first = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("")
    given = F.lit(None).cast("string")
    for prefix, service in (overrides or {}).items():
        given = F.when(F.col("filename").startswith(prefix), service).otherwise(given)
    return files.join(found, "filename", "left").withColumns({"module": F.coalesce(base("_in"), F.lit("")), "microservice": F.coalesce(given, base("_out"), first)}).drop("_in", "_out")


# --- chunks ---

CHUNKS = {"java": (1500, 350, 220), "kotlin": (1500, 350, 220), "sql": (800, 100, 80), "yaml": (600, 100, 60)}


def chunked(files: DataFrame) -> DataFrame:
    """(filename, kind, text, range_start, range_end): pieces of whole lines up to a size, with an overlap.

    files: filename, kind, text. A last piece below the least size joins the one before it.
    """

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            out = []
            for name, kind, text in zip(b["filename"], b["kind"], b["text"], strict=True):
                size, least, overlap = CHUNKS.get(kind, (1500, 350, 220))
                out += [(name, kind, text[a:e], a, e) for a, e in spans(text or "", size, least, overlap)]
            yield pd.DataFrame(out, columns=["filename", "kind", "text", "range_start", "range_end"])

    return files.select("filename", "kind", "text").mapInPandas(run, "filename string, kind string, text string, range_start long, range_end long")


def spans(text: str, size: int, least: int, overlap: int) -> list[tuple[int, int]]:
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text) and (cut := text.rfind("\n", start + least, end)) > 0:
            end = cut + 1
        out.append((start, end))
        if end >= len(text):
            break
        back = text.rfind("\n", start + 1, max(start + 1, end - overlap))
        start = max(start + 1, back + 1 if back > 0 and end - back <= 2 * overlap else end - overlap)
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        last = out.pop()
        out[-1] = (out[-1][0], last[1])
    return [s for s in out if text[s[0] : s[1]].strip()]


def enriched(chunks: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """Chunks with the type around them (the smallest that covers, else that of the largest overlap) and the names that begin in them.

    types and members: filename, fqn, kind, name, start_byte, end_byte (and role, annotations, capabilities of types).
    """
    c, t = chunks.withColumn("_id", F.xxhash64("filename", "range_start", "range_end")), types.select("filename", F.col("fqn").alias("primary_type_fqn"), F.col("kind").alias("primary_type_kind"), "role", "annotations", "capabilities", F.col("start_byte").alias("_a"), F.col("end_byte").alias("_b"))
    hit = c.join(t, "filename").where((F.col("_a") < F.col("range_end")) & (F.col("_b") > F.col("range_start")))
    covers = (F.col("_a") <= F.col("range_start")) & (F.col("_b") >= F.col("range_end"))
    overlap = F.least("_b", "range_end") - F.greatest("_a", "range_start")
    order = Window.partitionBy("_id").orderBy(F.desc(covers), F.when(covers, F.col("_b") - F.col("_a")), F.desc(overlap), "primary_type_fqn")
    best = hit.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_id", "primary_type_fqn", "primary_type_kind", "role", F.col("annotations").alias("annotations_on_type"), "capabilities")
    inside = c.select("_id", "filename", "range_start", "range_end").join(members.select("filename", "name", F.col("start_byte").alias("_s")), "filename").where("_s >= range_start and _s < range_end")
    names = inside.groupBy("_id").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("_s", "name")))["name"]).alias("symbols"))
    return c.join(best, "_id", "left").join(names, "_id", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>"))).drop("_id")


# --- diffs ---


def parse_diff(text: str) -> tuple[list[dict], list[str]]:
    """(hunks, notes) of a unified diff; renames, binary files and text that is no diff make notes, not hunks."""
    hunks, notes, source, target, renamed = [], [], "", "", False
    clean = lambda p: "" if p == "/dev/null" else re.sub(r"^[ab]/", "", p.split("\t")[0].strip())
    for line in text.splitlines():
        if line.startswith("diff --git"):
            renamed, source, target = False, "", ""
        elif line.startswith("rename from "):
            renamed = True
            notes.append(f"renamed: {line[12:]}")
        elif line.startswith(("Binary files", "GIT binary patch")):
            notes.append(f"binary: {line}")
        elif line.startswith("--- "):
            source = clean(line[4:])
        elif line.startswith("+++ "):
            target = clean(line[4:])
        elif (m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)) and not renamed:
            hunks.append({"source_path": source or target, "target_path": target or source, "source_start": int(m[1]), "source_len": int(m[2] or 1), "target_start": int(m[3]), "target_len": int(m[4] or 1)})
    return hunks, notes


def diff_hunks(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([tuple(h.values()) for h in parse_diff(text)[0]], "source_path string, target_path string, source_start int, source_len int, target_start int, target_len int")


# --- generated code ---

#: Banners in a file's head and values of @Generated, by generator.
BANNERS = {
    "openapi": r"(?i)This file was generated by the OpenAPI Generator",
    "protobuf": r"(?i)Generated by the protocol buffer compiler",
    "jsonschema2pojo": r"(?i)This file was generated by jsonschema2pojo",
    "wsimport": r"(?i)generated by wsimport",
    "mapstruct": r"(?i)WARNING: DO NOT EDIT.*generated by MapStruct",
}
GENERATED_VALUES = {
    "openapi": r"org\.openapitools\.codegen\.",
    "mapstruct": r"org\.mapstruct\.ap\.MappingProcessor",
    "autovalue": r"com\.google\.auto\.value\.processor\.AutoValueProcessor",
    "jooq": r"org\.jooq\.",
    "querydsl": r"com\.querydsl\.",
    "immutables": r"org\.immutables\.",
}


def generated_by(text: Column, annotations: Column, exclude: Column | None = None, extra: dict[str, str] | None = None) -> Column:
    """Family of the generator: by what stands in @Generated, by that annotation alone, then by a banner in the first 4096 characters; null for written code."""
    head = F.substring(text, 1, 4096)
    banner = F.coalesce(*[F.when(head.rlike(p), k) for k, p in {**BANNERS, **(extra or {})}.items()])
    value = F.regexp_extract(text, r"@(?:[\w.]+\.)?Generated\s*\(([^)]*)\)", 1)
    family = F.coalesce(*[F.when(value.rlike(p), k) for k, p in GENERATED_VALUES.items()])
    found = F.coalesce(family, F.when(F.array_contains(annotations, "Generated"), "annotation"), banner)
    return F.when(exclude, None).otherwise(found) if exclude is not None else found
