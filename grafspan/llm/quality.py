"""Quality rules: a table of thresholds compiled into one projection (DataFrame functions only).

Every measure is a column expression over one row, so the whole check is a scan with a
projection: no shuffle, no user function, no state. A rule names a measure, a comparison and a
bound; a document fails a rule when the comparison holds.

Defined cases: a null or empty text has no words and fails; repeated rows are judged each for
itself; very long texts are measured whole, in n log n time; an empty table gives an empty
result. Names beginning with an underscore are used inside; other columns pass through,
but for those that bear the name of a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, clear, words_of

WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be at by this from or an not have which a "
    "der die das und in zu den von mit ist im für nicht eine ein dem des sich auf auch "
    "le la les de des et un une est que qui dans pour par sur avec au ne se du "
    "el los las y en que por con para una del se no su es al"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a document where ``measure op bound``; only where it has at least ``words`` words."""

    name: str
    measure: str
    op: str
    bound: float
    words: int = 0


#: Production thresholds. The first two are the base rules.
RULES = (
    Rule("too_short", "n_words", "<", 20),
    Rule("repeated_windows", "repeat_ratio", ">", 0.30),
    Rule("symbols_a_word", "symbol_ratio", ">", 0.25),
    Rule("shouted_words", "shout_ratio", ">", 0.30),
    Rule("repeated_lines", "dup_line_ratio", ">", 0.50, 40),
    Rule("same_word_again", "echo_ratio", ">", 0.30),
    Rule("bar_lists", "bar_ratio", ">", 0.20),
    Rule("word_too_long", "mean_word", ">", 30),
    Rule("word_too_short", "mean_word", "<", 2),
    Rule("no_stop_words", "stop_ratio", "<", 0.005, 200),
)


def repeated_words(words: Column, n: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in the array.

    Windows are hashed to 64 bits. An array without a repeated hash is done after one pass of
    array_distinct. Otherwise hashes are sorted with their places; a window equal to a
    neighbour is repeated; the union of equally long intervals is a sum over their sorted starts.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(width)]))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.element_at(F.transform(F.array(placed), lambda s: union(s)), 1)

    def union(s: Column) -> Column:
        m = F.size(s)
        twice = F.filter(
            F.transform(s, lambda x, i: F.when(
                ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < m - 1) & (F.get(s, i + 1)["h"] == x["h"])), x["i"])),
            lambda x: x.isNotNull(),
        )
        starts = F.sort_array(twice)
        return F.aggregate(starts, F.struct(F.lit(0).alias("sum"), F.lit(-width).alias("last")), lambda a, x: F.struct((a["sum"] + F.least(F.lit(width), x - a["last"])).alias("sum"), x.alias("last")))["sum"]

    both = F.transform(F.array(F.transform(F.array(hashes), windows)[0]), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(n >= width, F.element_at(both, 1)).otherwise(F.lit(0)).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_ratio", "symbol_ratio", "shout_ratio", "dup_line_ratio", "echo_ratio", "bar_ratio", "mean_word", "stop_ratio")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures that rules may name.

    Words and measures each come out of a generator of one row: a filter on what is derived from them
    then reads them, where it would else be pushed down and make each of them again.
    """
    docs = clear(docs, *MEASURES)
    whole = F.coalesce(F.col(text), F.lit(""))
    one = docs.select("*", F.explode(F.array(words_of(whole))).alias("_words"))
    words, n = F.col("_words"), F.size("_words")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    lines = F.transform(F.array(lines), lambda a: F.struct(F.size(a).alias("all"), F.size(F.array_distinct(a)).alias("own")))[0]
    count = lambda cond: F.size(F.filter(words, cond))
    made = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long"),
        "_lines": lines,
        "n_repeat_words": repeated_words(words, n),
        "_shout": count(lambda w: (F.length(w) > 2) & (F.upper(w) == w) & (F.lower(w) != w)),
        "_bars": count(lambda w: w == "|"),
        "_echo": n - F.size(F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, F.greatest(i - 1, F.lit(0))) != w), 1)), lambda x: x.isNotNull())),
        "_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
    }
    one = one.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("_made")).select(*docs.columns, "_made.*")
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return one.withColumns({
        "n_dup_lines": (F.col("_lines.all") - F.col("_lines.own")).cast("long"),
        "repeat_ratio": F.col("n_repeat_words") / per_word,
        "symbol_ratio": F.col("n_symbols") / per_word,
        "shout_ratio": F.col("_shout") / per_word,
        "dup_line_ratio": (F.col("_lines.all") - F.col("_lines.own")) / F.greatest(F.col("_lines.all"), F.lit(1)),
        "echo_ratio": F.col("_echo") / per_word,
        "bar_ratio": F.col("_bars") / per_word,
        "mean_word": F.col("word_chars") / per_word,
        "stop_ratio": F.col("_stop") / per_word,
    })


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row fails, as one array expression."""
    tests = []
    for r in rules:
        m, b = F.col(r.measure), F.lit(r.bound)
        hit = {"<": m < b, "<=": m <= b, ">": m > b, ">=": m >= b}[r.op]
        tests.append(F.when(hit & (F.col("n_words") >= r.words), F.lit(r.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs with the measures, failed (names of failed rules), base_failed and kept."""
    out = measured(clear(docs, "failed", "base_failed", "kept")).withColumn("failed", compiled(rules))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_lines", "_shout", "_bars", "_echo", "_stop")
