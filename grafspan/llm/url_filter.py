"""URL filter: a blocked Bloom filter lets possible hits through to an exact hash join.

A list has entries of two kinds under one form of key: ``host/path`` rules, which fit the host, its
subdomains and every path that starts with the rule's, and canonical URLs, which fit one page.
A URL asks for its own canonical form and for the (host suffix, path prefix) of each shape, labels and
length, that some rule has. Each key selects one 256-bit block of the filter and a few bits in it; only keys whose bits
are all set go on to the join with the list itself, which removes the false positives. The filter's size
follows the list's, 16 bits a key. Up to ``max_blocks`` blocks (8 MB) it is broadcast; a larger one is
joined by block. The list is never broadcast by us; its distinct keys are hashed by partition.

Defined cases: a null URL or one without ``://`` has empty host and path and no rule, and is
allowed; repeated rows are judged each for itself; an empty list allows everything; an empty
table gives an empty result. Of several rules that fit, the longest wins, then the longest host. Very long URLs cost
time in proportion to their length.
Names beginning with an underscore are used inside; other columns pass through,
but for those that bear the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, clear

WORDS = 4  # 64-bit words of a block
PROBES = 6  # bits of a key in its block


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path without scheme, leading www, m or blog, query, fragment, closing slash and .html or index page."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m|blog)\.(?=[^.]+\.)", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    return F.concat(F.lit("="), host, path)


def block_and_mask(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and its bits there, as one mask for each word of a block."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    bits = F.xxhash64(key, F.lit("bits"))
    at = [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(64 * WORDS - 1)) for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for a in at:
            mask = mask.bitwiseOR(F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return block, masks


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the keys in column ``key``: at most ``blocks`` rows."""
    block, masks = block_and_mask(F.col("key"), blocks)
    return keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def blocks_for(entries: int, bits: int = 16, max_blocks: int | None = None) -> int:
    blocks = max(1, -(-entries * bits // (64 * WORDS)))
    return min(blocks, max_blocks) if max_blocks else blocks


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url", max_blocks: int = 1 << 18) -> DataFrame:
    """Adds host, path, rule, listed (canonical URL is in the list) and verdict to pages.

    rules: (host, path, verdict), a short table. listed: column ``canonical`` of blocked canonical URLs.
    The filter holds the keys of both.
    """
    spark, pages = pages.sparkSession, clear(pages, "host", "path", "rule", "listed", "verdict")
    fixed = F.inline(F.array(*[F.struct(F.lit(f"{h}\n{p}").alias("key"), F.lit(v).alias("_verdict"), F.lit(h + p).alias("_rule"), F.lit(len(h + p) * 1000 + len(h)).alias("_len")) for h, p, v in rules])) if rules else None
    ruled = spark.range(1).select(fixed) if rules else None
    entries = listed.select(F.col("canonical").alias("key")).where("key is not null").distinct()
    every = entries.unionByName(ruled.select("key")) if rules else entries
    blocks = blocks_for(every.count())
    seen = bloom(every, blocks)
    seen = F.broadcast(seen) if blocks <= max_blocks else seen

    # Each distinct URL asks once; its keys carry no page.
    urls = pages.select(F.col(url).alias("_url")).where("_url is not null").distinct()
    asked = urls.select("_url", F.explode(keys_of(F.col("_url"), rules)).alias("key"))
    block, masks = block_and_mask(F.col("key"), blocks)
    probe = asked.withColumns({"_block": block} | {f"_m{i}": m for i, m in enumerate(masks)})
    passes = F.lit(True)
    for i in range(WORDS):
        passes = passes & (F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
    possible = probe.join(seen, F.col("_block") == F.col("block")).where(passes).select("_url", "key")
    hits = possible.where(F.col("key").startswith("=")).join(entries.hint("shuffle_hash"), "key").select("_url", F.lit(True).alias("_in"), F.lit(None).cast("struct<_len:int,_rule:string,_verdict:string>").alias("_top"))
    if rules:  # as many rows as the caller wrote down
        hits = hits.unionByName(possible.join(F.broadcast(ruled), "key").select("_url", F.lit(False).alias("_in"), F.struct("_len", "_rule", "_verdict").alias("_top")))
    hits = hits.groupBy("_url").agg(F.max("_in").alias("_in"), F.max("_top").alias("_top"))
    judged = pages.join(hits, F.col(url) == F.col("_url"), "left").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "rule": F.col("_top._rule"), "listed": F.coalesce("_in", F.lit(False))})
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(F.col("_top._verdict"), method)).drop("_url", "_top", "_in")


def keys_of(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The keys that a URL asks for: its canonical form, and host suffix with path prefix of each shape that a rule has."""
    host, path = host_of(url), path_of(url)
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    # A host of fewer labels, or a shorter path, gives a key of another shape, which is none of a rule of this one.
    asked = [F.concat(F.substring_index(host, ".", -n), F.lit("\n"), F.substring(path, 1, k) if k else F.lit("")) for n, k in shapes]
    return F.when(host != "", F.array_distinct(F.array(canonical(url), *asked))).otherwise(F.array().cast("array<string>"))
