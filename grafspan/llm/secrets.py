"""Secret scan: fixed patterns, and a likelihood ratio of two character Markov models.

Spans come from three patterns (assign, access, hex) and from the models (kind ``random``). In a run
of ``LEAST`` or more key characters, every character is weighed by how much better a first-order Markov model of
random strings explains it than one of ordinary identifiers, less ``PER_CHAR`` nats. The part of the run with the
largest sum is a secret if that is ``EVIDENCE`` nats or more, if it has ``PART`` characters, a letter and a digit,
and no pattern has found it; names and paths before a key don't weaken it. Both models are counted with DataFrame
functions from labelled samples (text, label); the table of their log-ratios has 128 x 128 entries,
whatever the samples' size, and goes into the scan as one array literal. The scan is a projection
over each row: no shuffle and no user function.

Positions are code points; a pattern's matches are found by extracting them and splitting the text
at them, so the pieces' lengths add up to places.

Defined cases: a null text is an empty one and has no spans; repeated rows are scanned each for
itself; very long texts and runs are scanned whole; of parts with equal sums the first counts, and spans of one start
are listed by kind and end; an empty table gives an empty result. Names beginning
with an underscore are used inside; other columns pass through, but for base and spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import clear

#: The patterns, by kind, in the order in which spans of one start are listed.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
}
LEAST_VALUE = 6
LEAST, PART, PER_CHAR, EVIDENCE = 16, 12, 0.25, 7.0
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST
_BLOCK = 128


def _running(lengths: Column) -> Column:
    """Sums of an array up to and with each element, by blocks, so that no step copies the whole array."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    grow = lambda start: lambda block: F.aggregate(block, F.struct(start.alias("s"), F.array().cast("array<long>").alias("a")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")))
    every = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<long>>").alias("a")),
                        lambda acc, block: F.transform(F.array(grow(acc["s"])(block)), lambda g: F.struct(g["s"].alias("s"), F.concat(acc["a"], F.array(g["a"])).alias("a")))[0])
    return F.flatten(every["a"])


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value is the group's text."""
    p = F.lit(pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    whole = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(whole, lambda x: F.length(x).cast("long"))
    values = whole if not group else F.regexp_extract_all(text, p, F.lit(group))
    bound = F.transform(F.array(F.struct(gaps.alias("g"), sizes.alias("m"), values.alias("v"))), lambda r: F.struct(r["m"].alias("m"), r["v"].alias("v"), _running(F.zip_with(F.slice(r["g"], 1, F.size(r["m"])), r["m"], lambda g, m: g + m)).alias("e")))[0]
    spans = F.transform(F.array(bound), lambda b: F.transform(b["e"], lambda e, i: F.struct((e - F.get(b["m"], i)).alias("start"), e.alias("end"), F.get(b["v"], i).alias("value"))))[0]
    return F.when(text.rlike(pattern), spans).otherwise(none)


# --- the models ---

#: Parts of ordinary identifiers, for the labelled samples.
PARTS = (
    "user name file path config value index table column query result error message handler service client server request response "
    "buffer stream string number array object list map key node edge graph tree parent child root left right first last next previous "
    "start end begin stop count total average minimum maximum length size width height color style format version update delete insert "
    "create remove select filter order group limit offset page document report summary detail header footer title author date time year "
    "month week day hour minute second account balance payment invoice customer product category price amount discount shipping address "
    "street city country region image video audio media upload download network socket connection session cookie cache memory storage "
    "default custom global local public private static final abstract interface package module import export function method class type"
).split()


def labelled_samples(spark: SparkSession, rows: int = 6000, seed: str = "markov") -> DataFrame:
    """(text, label): as many random strings (1) as ordinary identifiers (0), made by DataFrame functions.

    Random strings are digests in base 64, in hexadecimal and in letters and digits; identifiers
    are two to five parts in snake, kebab, camel and path style, with numbers, dates and versions.
    """
    ids = spark.range(rows).withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 512))
    raw = F.unhex("h")
    b64 = F.regexp_replace(F.base64(raw), r"[=\r\n]", "")
    plain = F.regexp_replace(b64, r"[+/]", "")
    cut = lambda c: F.substring(c, F.lit(1), (20 + F.pmod(F.xxhash64("id"), F.lit(30))).cast("int"))
    which = F.pmod(F.col("id"), F.lit(4))
    random = ids.select(F.when(which == 0, cut(b64)).when(which == 1, cut("h")).when(which == 2, cut(plain)).otherwise(cut(F.upper(plain))).alias("text"), F.lit(1).alias("label"))
    parts = F.array(*[F.lit(x) for x in PARTS])
    word = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    some = F.slice(F.array(*[word(k) for k in range(5)]), F.lit(1), (3 + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3))).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(2100)).cast("string")
    camel = F.array_join(F.transform(some, lambda w: F.initcap(w)), "")
    date = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(11)), F.lit(12000)).cast("int")), "yyyy-MM-dd")
    style = F.pmod(F.col("id"), F.lit(7))
    name = (F.when(style == 0, F.concat_ws("_", F.array_join(some, "_"), number)).when(style == 1, F.concat_ws("-", F.array_join(some, "-"), number)).when(style == 2, F.concat(camel, number))
            .when(style == 3, F.concat_ws("/", F.array_join(some, "/"), date)).when(style == 4, F.concat_ws("_", F.upper(F.array_join(some, "_")), number)).when(style == 5, F.concat_ws("-", F.lit("v" ), number, F.array_join(some, "-"), date)).otherwise(F.array_join(some, "")))
    return random.unionByName(ids.select(name.alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, smooth: float = 0.5, alphabet: int = 66) -> list[int]:
    """Log-ratios of the two models in thousandths of a nat, at 128 * first + second character code.

    Only the 2 x 128 x 128 possible counts leave the executors. ``^`` (94) stands before the text.
    """
    chars = F.split(F.concat(F.lit("^"), F.regexp_replace("text", r"[^\x20-\x7e]", "~")), "")
    pairs = samples.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.ascii(F.element_at(chars, i)) * 128 + F.ascii(F.element_at(chars, i + 1)))).alias("pair"))
    counts: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] = r["count"]
    out = [0] * (128 * 128)
    sums = {k: [sum(v for p, v in c.items() if p // 128 == a) for a in range(128)] for k, c in counts.items()}
    for p in range(128 * 128):
        like = [math.log((counts[k].get(p, 0) + smooth) / (sums[k][p // 128] + smooth * alphabet)) for k in (0, 1)]
        out[p] = round(1000 * (like[1] - like[0]))
    return out


def ratio(value: Column, weights: list[int]) -> Column:
    """Thousandths of a nat by which the random model explains an ASCII string better."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    codes = F.transform(F.split(F.concat(F.lit("^"), value), ""), lambda c: F.ascii(c))
    return F.transform(F.array(codes), lambda a: F.aggregate(F.transform(a, lambda c, i: F.when(i == 0, 0).otherwise(F.get(table, F.get(a, F.greatest(i - 1, F.lit(0))) * 128 + c))), F.lit(0), lambda s, x: s + x))[0]


def best_part(value: Column, weights: list[int]) -> Column:
    """struct<best, a, b>: the part [a, b) of an ASCII string with the largest sum of ratios less PER_CHAR, in thousandths of a nat."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    codes = F.transform(F.split(F.concat(F.lit("^"), value), ""), lambda c: F.ascii(c))
    steps = lambda a: F.transform(F.slice(a, 2, F.size(a)), lambda c, i: F.get(table, F.get(a, i) * 128 + c) - int(1000 * PER_CHAR))
    zero = F.lit(0)
    start = F.struct(*[zero.alias(k) for k in ("i", "sum", "at", "best", "a", "b")])

    def step(s: Column, x: Column) -> Column:
        on = s["sum"] > 0
        total, at, end = F.when(on, s["sum"]).otherwise(zero) + x, F.when(on, s["at"]).otherwise(s["i"]), s["i"] + 1
        more = total > s["best"]
        return F.struct(end.alias("i"), total.alias("sum"), at.alias("at"), F.greatest(total, s["best"]).alias("best"), F.when(more, at).otherwise(s["a"]).alias("a"), F.when(more, end).otherwise(s["b"]).alias("b"))

    return F.transform(F.array(codes), lambda a: F.aggregate(steps(a), start, step, lambda s: F.struct(s["best"].alias("best"), s["a"].alias("a"), s["b"].alias("b"))))[0]


def suspects(text: Column, weights: list[int]) -> Column:
    """array<struct<start, end, value>> of the parts of a text's runs that the models hold for random."""
    parts = F.transform(located(text, CANDIDATE), lambda r: F.struct(r["start"].alias("s"), r["value"].alias("v"), best_part(r["value"], weights).alias("p")))
    parts = F.filter(parts, lambda r: (r["p"]["best"] >= int(1000 * EVIDENCE)) & (r["p"]["b"] - r["p"]["a"] >= PART))
    spans = F.transform(parts, lambda r: F.struct((r["s"] + r["p"]["a"]).alias("start"), (r["s"] + r["p"]["b"]).alias("end"), F.substring(r["v"], r["p"]["a"] + 1, r["p"]["b"] - r["p"]["a"]).alias("value")))
    return F.filter(spans, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))


def scan(docs: DataFrame, weights: list[int] | None = None, text: str = "text") -> DataFrame:
    """Adds base and all spans, array<struct<start, kind_no, end, kind>> in order, to docs."""
    weights = weights or train(labelled_samples(docs.sparkSession))
    whole = F.coalesce(F.col(text), F.lit(""))
    named = lambda spans, no, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    assign = F.filter(located(whole, PATTERNS["assign"], 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    docs = clear(docs, "base", "spans")
    out = docs.withColumn("_base", F.concat(named(assign, 0, "assign"), named(located(whole, PATTERNS["access"]), 1, "access"), named(located(whole, PATTERNS["hex"]), 2, "hex")))
    base = F.sort_array("_base")
    free = lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    odd = F.filter(suspects(whole, weights), free)
    return out.withColumn("base", base).withColumn("spans", F.sort_array(F.concat("_base", named(odd, 3, "random")))).drop("_base")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
