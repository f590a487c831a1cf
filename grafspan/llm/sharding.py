"""Sharding by balanced label propagation: linked documents move together under quotas.

Documents that share a link key (by default: equal texts) are neighbours; a key's documents are a group.
Each document starts in a shard drawn from its id and text. The quotas are exact numbers of rows,
and for groups they are counted by size: from the number of groups of each size, ``quotas`` finds how
many groups of a size a shard can hold whole, largest size first, in the shards with the most room.

In every round a group without a place proposes to the shard that holds most of its documents, of
those with a place left for its size, and proposals are accepted up to the places. Neighbours are counted through
their common key, (key, shard, count), so no pairs within a group are ever made. Rounds end when no
proposal is accepted; groups that still have no place take what places are left, by rank. A group that
fits nowhere as a whole, since it is larger than a shard or the room is in fragments, is cut into as few parts
as the rooms allow. Unlinked documents cut no edge wherever they lie, so they fill up what is left;
counts of the shards then differ by one at most (law ``rows``). ``n_cut`` is the number of a
document's neighbours in other shards: summed over all rows, twice the number of cut edges.

What reaches the driver: the number of groups by size (there are at most sqrt(2 n) sizes of n rows), and of accepted
ones by size and shard. Keys with over 1 / 1024 of all rows are at most 1024, and are joined by a broadcast;
the others are too small to fill a task.

Defined cases: a null text has no bytes, checksum 0 and no neighbours; an empty text is a text
like any other; a very long text is only hashed; repeated rows are documents of their own and neighbours of each
other; a null doc_id is placed like any other; ties fall to the smaller hash of key and shard; with fewer rows than
shards some shards stay empty; an empty table gives an empty result. Only doc_id, text and what ``link`` names are
read, so extra columns of any name don't matter.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Stage, draw, running_sum

LAW = "rows"
#: A key is heavy with over one part in so many of all rows.
HEAVY = 1024


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _places(room: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups each shard takes: all that fit, or so many that the rooms left are even."""
    most = [r // size for r in room]
    if sum(most) <= count:
        return most
    at = lambda level: [max(0, r - level) // size for r in room]
    low, high = 0, max(room)
    while low < high:  # the highest level down to which the rooms hold them
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(at(mid)) >= count else (low, mid - 1)
    out = at(low)
    for _ in range(sum(out) - count):
        j = min((j for j in range(len(room)) if out[j]), key=lambda j: (room[j] - out[j] * size, j))
        out[j] -= 1
    return out


def quotas(sizes: dict[int, int], room: list[int]) -> tuple[dict[int, list[int]], list[tuple[int, int, int, int, int]], list[int]]:
    """Places for whole groups by size, (size, nth, first, end, shard) of the parts of those that fit nowhere, and the rooms left."""
    room, whole, parts = list(room), {}, []
    todo = [(-s, 0, 0, 0, c) for s, c in sizes.items()]  # (-rows, group's size, nth, first row, groups)
    heapq.heapify(todo)
    while todo:
        rows, size, nth, first, count = heapq.heappop(todo)
        rows = -rows
        if not size:
            whole[rows] = _places(room, rows, count)
            room = [r - n * rows for r, n in zip(room, whole[rows], strict=True)]
            for k in range(count - sum(whole[rows])):  # fewer than there are shards, as none has room for one
                heapq.heappush(todo, (-rows, rows, k, 0, 1))
            continue
        fits = [j for j, r in enumerate(room) if r >= rows]
        j = min(fits, key=lambda j: room[j]) if fits else max(range(len(room)), key=lambda j: room[j])
        n = min(rows, room[j])
        parts.append((size, nth, first, first + n, j))
        room[j] -= n
        if n < rows:
            heapq.heappush(todo, (n - rows, size, nth, first + n, 1))
    return whole, parts, room


def propagate(counts: DataFrame, places: dict[int, list[int]], stage: Stage) -> DataFrame:
    """(_key, _m, shard, n), the rows of each group by shard, to (_key, _m, _to, _nth): the group's shard, or its number among those to cut."""
    spark = counts.sparkSession
    open_ = {(m, j): n for m, row in places.items() for j, n in enumerate(row) if n}
    homes, left = None, counts
    while open_:
        free = spark.createDataFrame([(m, j, n) for (m, j), n in open_.items()], "_m long, shard int, _free long")
        wish = left.join(free, ["_m", "shard"]).groupBy("_key", "_m").agg(F.max_by(F.struct("shard", "_free"), F.struct("n", F.xxhash64("_key", "shard"))).alias("_best"))
        wish = wish.select("_key", "_m", F.col("_best.shard").alias("_to"), F.col("_best._free").alias("_free"), draw(F.lit("turn"), F.col("_key")).alias("_turn"), F.lit(1).alias("_one"))
        wish = running_sum(wish, ["_m", "_to"], ["_turn", "_key"], "_one", "_rank", spread="_turn").where(F.col("_rank") <= F.col("_free"))
        placed = stage.write(wish.select("_key", "_m", "_to"), "placed")
        got = placed.groupBy("_m", "_to").agg(F.count("*").alias("n")).collect()
        if not got:
            break
        homes = placed if homes is None else homes.unionByName(placed)
        for r in got:
            open_[r["_m"], r["_to"]] -= r["n"]
        open_ = {k: n for k, n in open_.items() if n}
        old, left = left, stage.write(left.join(placed.select("_key"), "_key", "left_anti"), "left")
        if old is not counts:
            stage.drop(old)
    # What no neighbour drew anywhere takes the places that are left, in order.
    ends: dict[int, list[tuple[int, int, int]]] = {}
    for (m, j), n in sorted(open_.items()):
        before = ends[m][-1][1] if m in ends else 0
        ends.setdefault(m, []).append((before, before + n, j))
    spans = spark.createDataFrame([(m, spans) for m, spans in ends.items()], "_m long, _spans array<struct<a:long,b:long,j:int>>")
    rest = left.select("_key", "_m").distinct().withColumns({"_turn": draw(F.lit("turn"), F.col("_key")), "_one": F.lit(1)})
    rest = running_sum(rest, ["_m"], ["_turn", "_key"], "_one", "_rank", spread="_turn").join(spans, "_m", "left")
    at = F.filter("_spans", lambda s: (s["a"] < F.col("_rank")) & (F.col("_rank") <= s["b"]))
    last = F.coalesce(F.element_at("_spans", -1)["b"], F.lit(0))
    rest = rest.select("_key", "_m", F.get(at, F.lit(0))["j"].alias("_to"), F.when(F.col("_rank") > last, F.col("_rank") - last - 1).cast("long").alias("_nth"))
    return rest if homes is None else homes.withColumn("_nth", F.lit(None).cast("long")).unionByName(rest)


def shard(docs: DataFrame, shards: int = 24, link: Column | None = None, seed: str = "shard", stage: Stage | None = None) -> DataFrame:
    """doc_id and text to doc_id, size, text_crc32, law, shard, slot, grown_shard, and n_cut (see above).

    link: the key that neighbours share; null for none.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark, "shard")
    raw = F.col("text").cast("binary")
    key = F.md5(raw) if link is None else link.cast("string")
    nodes = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("_key"), F.coalesce(F.md5(raw), F.lit("")).alias("_text"),
    )
    nodes = nodes.withColumns({"_draw": draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text")), "_row": F.xxhash64("doc_id", "_text")}).drop("_text")
    nodes = stage.write(nodes, "nodes")
    total = nodes.count()
    quota = _quota(total, shards)
    start = F.shiftright(F.col("_draw") * shards, 32).cast("int")
    counts = nodes.where("_key is not null").groupBy("_key", start.alias("shard")).agg(F.count("*").alias("n"))
    # A key has a row for each shard at most.
    counts = stage.write(counts.withColumn("_m", F.sum("n").over(Window.partitionBy("_key"))).where("_m > 1"), "counts")
    heavy = counts.where(F.col("_m") * HEAVY > total).select("_key").distinct()
    sizes = {r["_m"]: r["n"] for r in counts.groupBy("_m").agg(F.sum("n").alias("rows")).select("_m", (F.col("rows") / F.col("_m")).cast("long").alias("n")).collect()}
    places, parts, room = quotas(sizes, quota)
    homes = stage.write(propagate(counts, places, stage), "homes")

    large = F.broadcast(homes.where(F.col("_m") * HEAVY > total))  # fewer than HEAVY keys
    small = homes.where(F.col("_m") * HEAVY <= total)
    marked = nodes.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), "_key", "left")
    found = marked.where("_heavy").drop("_heavy").join(large, "_key").unionByName(marked.where("_heavy is null").drop("_heavy").join(small, "_key", "left"))
    found = stage.write(found, "found")
    own = ["doc_id", "size", "text_crc32", "_draw", "_row"]
    whole = found.where("_to is not null").select(*own, F.col("_to").alias("shard"), F.lit(0).cast("long").alias("n_cut"))
    cut = running_sum(found.where("_nth is not null").withColumn("_one", F.lit(1)), ["_key"], ["_draw", "_row"], "_one", "_rank", spread="_draw")
    pieces = spark.createDataFrame(parts, "_m long, _nth long, _first long, _end long, shard int")
    cut = cut.join(pieces, ["_m", "_nth"]).where((F.col("_rank") > F.col("_first")) & (F.col("_rank") <= F.col("_end")))
    cut = cut.select(*own, "shard", (F.col("_m") - F.col("_end") + F.col("_first")).alias("n_cut"))
    fill = running_sum(found.where("_m is null").withColumn("_one", F.lit(1)), [], ["_draw", "_row"], "_one", "_rank", spread="_draw")
    ends = [sum(room[: j + 1]) for j in range(shards)]
    to = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("_rank")))
    fill = fill.select(*own, to.alias("shard"), F.lit(0).cast("long").alias("n_cut"))
    out = whole.unionByName(cut).unionByName(fill).withColumn("_one", F.lit(1))
    out = running_sum(out, ["shard"], ["_draw", "_row"], "_one", "_rank", spread="_draw")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_cut")
