"""Line dedup with a log-template tree (DataFrame functions only).

A line is a list of tokens; tokens with a digit are variable from the start (``<*>``). The tree has
a fixed depth: the number of tokens, then the first ``DEPTH`` tokens. Lines of one leaf are compared
place by place: tokens are counted by the documents that have them at their place there. In a template
``constant`` of the places are fixed, so as many of a line's tokens, the most frequent ones, give the
measure: the least count among them. A token with ``SHARE`` of that measure is constant, any other is
variable, so that a field is variable whatever the corpus' size and whatever else is in the leaf. What is
left is the line's template. One that occurs in enough different texts is boilerplate, and all its
lines are dropped. Enough are ``least_docs`` for up to ``SHORT`` tokens; the number falls with the line's
length, to two above ``LONG`` tokens. Lines of fewer than ``least_tokens`` tokens have no place for a
field: their whole masked text is their leaf and template.

Only leaves with enough lines can hold such a template. Lines are therefore counted by leaf
first (a 64-bit key each), and a blocked Bloom filter of the frequent leaves, of bounded size, picks
the lines that go on with their tokens; a join with the leaves themselves removes false positives.

Texts and lines are named by 128 bits; should two leaves share their 64, their tokens are counted together.

Defined cases: a null text stays null and has no lines; blank lines, and lines with too few tokens
without a digit, are kept; equal texts (known by their 128-bit digest) count as one document and lose the same lines;
very long texts and lines are like others; tokens of equal counts are constant or variable together; an empty table gives an
empty result. A text that loses nothing is unchanged. Names beginning with an underscore are used inside; other columns pass through,
but for those that bear the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stage, clear, words_of
from .url_filter import WORDS, block_and_mask, blocks_for, bloom

DEPTH = 3
SHARE = 0.5
SHORT, LONG = 10, 50
VARIABLE = "<*>"


def spaced(line: Column) -> Column:
    """The tokens of a line with one space between them."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for gap in ("  ", *"\t\n\x0b\f\r"):
        odd = odd | F.contains(line, F.lit(gap))
    return F.when(odd, F.array_join(words_of(line), " ")).otherwise(line)


def masked(tokens: Column) -> Column:
    """Tokens with one space between them; those with a digit are variable. Each is masked by itself, so leading ones can be masked alone."""
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, r"(?<![^ ])[^ ]*?[0-9][^ ]*", VARIABLE)).otherwise(tokens)


def enough(size: Column, least_docs: int) -> Column:
    """The number of different texts that a template of so many tokens must have."""
    falling = F.ceil(F.lit(least_docs * SHORT) / size).cast("int")
    return F.when(size <= SHORT, F.lit(least_docs)).when(size > LONG, F.lit(min(2, least_docs))).otherwise(F.greatest(falling, F.lit(min(2, least_docs))))


def _lines(docs: DataFrame, least_tokens: int) -> DataFrame:
    """(_text, _no, _line, _size, _leaf) of all lines, as yet unmasked; _leaf is null where a line is blank. _text stands for the whole text."""
    # Beside a generator the digest would be made again for every line.
    lines = docs.select("text", F.unhex(F.md5("text")).alias("_text")).select("_text", F.posexplode(F.split("text", "\n", -1)).alias("_no", "_raw"))
    # A generator of one row: what is above it reads the spaced line and doesn't make it again.
    lines = lines.select("_text", "_no", F.explode(F.array(spaced(F.col("_raw")))).alias("_line"))
    count = F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) + 1
    # The leading tokens are what stands before the DEPTH-th space. The rest is masked only in lines of frequent leaves.
    leaf = F.when(count >= least_tokens, F.xxhash64(count, masked(F.substring_index("_line", " ", DEPTH)))).when(F.col("_line") != "", F.xxhash64(F.lit(0), masked(F.col("_line"))))
    return lines.select("_text", "_no", "_line", count.alias("_size"), F.explode(F.array(leaf)).alias("_leaf"))


def templates(docs: DataFrame, least_docs: int = 10, least_tokens: int = 5, constant: float = 0.5, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """(_text, _no, template_id) of the lines to drop, and (template_id, template, docs) of the boilerplate."""
    stage = stage or Stage(docs.sparkSession, "lines")
    leaves = _lines(docs, least_tokens).groupBy("_leaf").agg(F.count("*").alias("n"), F.max("_size").alias("_size")).where((F.col("n") >= enough(F.col("_size"), least_docs)) & F.col("_leaf").isNotNull())
    leaves = stage.write(leaves.select("_leaf"), "leaves")
    blocks = blocks_for(leaves.count(), max_blocks=1 << 16)
    seen = bloom(leaves.select(F.col("_leaf").alias("key")), blocks)
    block, masks = block_and_mask(F.col("_leaf"), blocks)
    probe = _lines(docs, least_tokens).withColumns({"_block": block} | {f"_m{i}": m for i, m in enumerate(masks)})
    passes = F.lit(True)
    for i in range(WORDS):
        passes = passes & (F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
    # A line counts once for a text, however often the text has it.
    possible = probe.join(F.broadcast(seen), F.col("_block") == F.col("block")).where(passes).select("_text", "_no", "_leaf", masked(F.col("_line")).alias("_line"))
    lines = stage.write(possible.withColumn("_key", F.unhex(F.md5("_line"))), "lines")
    own = lines.groupBy("_leaf", "_key", "_text").agg(F.min("_line").alias("_line"))
    kinds = own.groupBy("_leaf", "_key").agg(F.count("*").alias("n"), F.min("_line").alias("_line")).join(leaves, "_leaf", "left_semi")
    kinds = stage.write(kinds, "kinds")
    # A token of fewer documents can't be constant in a template of that many.
    kinds = kinds.withColumn("_tokens", F.split("_line", " ")).withColumn("_enough", enough(F.size("_tokens"), least_docs))
    tokens = kinds.select("_leaf", "_key", "n", "_enough", F.posexplode("_tokens").alias("_at", "_token"))
    common = tokens.groupBy("_leaf", "_at", "_token").agg(F.sum("n").alias("_docs"), F.max("_enough").alias("_e")).where((F.col("_docs") >= F.col("_e")) & (F.col("_token") != VARIABLE)).drop("_e")
    counted = tokens.join(common, ["_leaf", "_at", "_token"], "left").withColumn("_docs", F.coalesce("_docs", F.lit(0)))
    whole = counted.groupBy("_leaf", "_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_token", "_docs"))).alias("_t"))
    whole = whole.withColumn("_measure", F.get(F.sort_array("_t._docs", asc=False), F.greatest(F.ceil(constant * F.size("_t")), F.lit(1)).cast("int") - 1)).where("_measure > 0")
    # Where the measure allows least_docs, a token of fewer stays variable.
    least = F.greatest(SHARE * F.col("_measure"), F.when(F.col("_measure") >= least_docs, F.lit(least_docs)).otherwise(F.lit(1)))
    whole = whole.withColumn("_t", F.transform("_t", lambda t: F.when(t["_docs"] >= least, t["_token"]).otherwise(VARIABLE)))
    whole = stage.write(whole.select("_key", F.array_join("_t", " ").alias("template"), enough(F.size("_t"), least_docs).alias("_enough")).withColumn("template_id", F.md5("template")), "templates")
    of_line = lines.select("_text", "_no", "_key").join(whole.select("_key", "template_id", "_enough"), "_key").select("_text", "_no", "template_id", "_enough")
    of_line = stage.write(of_line, "of-line")
    often = of_line.select("template_id", "_text", "_enough").distinct().groupBy("template_id").agg(F.count("*").alias("docs"), F.max("_enough").alias("_enough")).where(F.col("docs") >= F.col("_enough")).drop("_enough")
    often = stage.write(often, "often")
    report = whole.groupBy("template_id").agg(F.min("template").alias("template")).join(often, "template_id")
    return of_line.drop("_enough").join(often.select("template_id"), "template_id"), report


def drop_templates(docs: DataFrame, least_docs: int = 10, least_tokens: int = 5, constant: float = 0.5, stage: Stage | None = None) -> DataFrame:
    """docs without the lines of recurring templates; adds n_lines, n_dropped and dropped (their places, from 0)."""
    docs, stage = clear(docs, "n_lines", "n_dropped", "dropped"), stage or Stage(docs.sparkSession, "lines")
    lines, _ = templates(docs.select("text"), least_docs, least_tokens, constant, stage)
    # Written, so that the join below reads two shuffles: Spark can then split the rows of a text of many copies.
    gone = stage.write(lines.groupBy("_text").agg(F.array_sort(F.collect_set("_no")).alias("dropped")), "gone")
    cols = docs.columns
    out = docs.withColumn("_text", F.unhex(F.md5("text"))).join(gone, "_text", "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    none = F.array().cast("array<int>")
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in cols], F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size(F.coalesce("dropped", none)), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))
