"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document of a source joins that source's queue in shuffled order. A document's virtual
finish time is the number of words its source has offered up to and with it, divided by the
source's target. The queues are merged by that clock: documents are range-sorted on it and
taken until the budget (the sum of all targets) is used up; a source that has reached its target
offers no more. A source whose target exceeds its
size offers its documents again, up to ``most`` times.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of
its own, last in order; repeated rows (equal doc_id, source and text) are one unit of
their joint size and are taken equally often; a null doc_id is shuffled like any other, since places in the queue
are drawn from id and text; equal finish times fall to the smaller draw, id and text; a very long text is one
document, so its source may end that much above or below its target; an empty table gives an empty result. Only
doc_id, text and source are read: extra columns of any name don't matter, and aren't in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Stage, count_words, draw, running_sum

#: The virtual clock is cut into this many ranges between 0 and 1.
TICKS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...], most: int, share: float = 1.0) -> DataFrame:
    """(source, source_size) to targets: weights repeat over the sources in code-point order, null last.

    A target stops at ``most`` times its source's size; what is cut off goes to the others by
    weight. The level at which the shares sum to the budget follows from one sort: with sources
    ordered by cap/weight, those below the level are exactly a prefix. There is one row per
    source here, so the sorts see no documents.
    """
    every = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("_n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap"))
    whole = Window.partitionBy()
    summed = (
        caps.withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(every.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    )
    # The level if this source and all after it are not capped; the first source whose cap lies above its level ends the prefix.
    level = summed.withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_rest"))
    free = F.min(F.when(F.col("_cap") >= F.col("_w") * F.col("_level"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("v")))).over(whole)
    return level.withColumn("_free", free).select(
        "source", "source_size", F.when(F.col("_free").isNull() | (F.col("_cap") < F.col("_w") * F.col("_free.v")), F.col("_cap")).otherwise(F.col("_w") * F.col("_free.v")).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", stage: Stage | None = None) -> DataFrame:
    """doc_id, text and source to one row a document: doc_id, source, size, source_size, target, times, taken, and _text, the text's MD5."""
    spark = docs.sparkSession
    stage = stage or Stage(spark, "mix")
    # A surrogate for the text keeps it out of every later shuffle.
    sized = stage.write(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_text")), "sizes")
    units = sized.groupBy("doc_id", "source", "_text", "size").agg(F.count("*").alias("_rows")).withColumn("_unit", F.col("size") * F.col("_rows"))
    queue = units.withColumn("_draw", draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text")))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    queue = running_sum(queue, ["source"], ["_draw", "doc_id", "_text"], "_unit", "_cum", spread="_draw")
    q, g = queue.alias("q"), goals.alias("g")
    queue = q.join(g, F.col("q.source").eqNullSafe(F.col("g.source"))).select("q.*", "g.source_size", "g.target")
    queue = stage.write(queue, "queue")

    # One offer for each time round.
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    finish = (F.col("_round") * F.col("source_size") + F.col("_cum")) / F.col("target")
    offers = queue.where((F.col("size") > 0) & (F.col("target") > 0)).select("*", rounds.alias("_round")).withColumn("_finish", finish)
    tick = F.floor(F.least(F.col("_finish"), F.lit(4.0 * most)) * TICKS).cast("long")
    # A source that has its target offers nothing more, so none ends further from it than its last document.
    offers = offers.where(F.col("_round") * F.col("source_size") + F.col("_cum") - F.col("_unit") < F.col("target")).withColumn("_tick", tick)
    budget = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("_budget"))
    ticks = offers.groupBy("_tick").agg(F.sum("_unit").alias("_sum"))
    upto = ticks.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_tick")))
    # The range in which the budget runs out, and what the ranges before it use: one row.
    edge = upto.crossJoin(F.broadcast(budget)).agg(
        F.min(F.when(F.col("_upto") > F.col("_budget"), F.col("_tick"))).alias("_edge"),
        F.max(F.when(F.col("_upto") <= F.col("_budget"), F.col("_upto"))).alias("_used"),
        F.first("_budget").alias("_budget"),
    )
    place = ["_finish", "_draw", "doc_id", "_text", "_round"]
    inside = offers.join(F.broadcast(edge), F.col("_tick") == F.col("_edge")).withColumn("_upto", F.coalesce("_used", F.lit(0)) + F.sum("_unit").over(Window.partitionBy("_tick").orderBy(*place)))
    last = inside.agg(F.max(F.when(F.col("_upto") <= F.col("_budget"), F.struct(*place))).alias("_last"))
    stop = edge.crossJoin(last)
    out = queue.crossJoin(F.broadcast(stop))
    times = F.lit(0)
    for k in range(most):
        at = (F.lit(k) * F.col("source_size") + F.col("_cum")) / F.col("target")
        on = F.floor(F.least(at, F.lit(4.0 * most)) * TICKS).cast("long")
        key = F.struct(at.alias("_finish"), "_draw", "doc_id", "_text", F.lit(k).alias("_round"))
        open_ = F.lit(k) * F.col("source_size") + F.col("_cum") - F.col("_unit") < F.col("target")
        times = times + F.when(~open_, 0).when(F.col("_edge").isNull() | (on < F.col("_edge")) | ((on == F.col("_edge")) & (key <= F.col("_last"))), 1).otherwise(0)
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0)
    out = out.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), times.alias("times"), (times * F.col("size")).cast("long").alias("taken"), "_text")
