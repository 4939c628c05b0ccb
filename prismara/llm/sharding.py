"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every distinct text is a key: it hashes to one of 2^16 ring places and belongs to the next virtual
node clockwise, so copies of a text stay together. A shard that is full passes the keys which
overflow it on to the next node clockwise that has room. Large groups of copies, of which there are at
most a bounded number, are placed first and one by one; only one that no shard has room for is split.
For the other keys the loads that decide are sums per arc of the ring, a table of ``n_shards * vnodes``
rows whatever the input: the plan is made from that, and groups are then placed in parallel by their
offset inside their arc, each whole.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, numbered_copies, row_hash

RING_BITS = 16
ROWS_PER_BUCKET = 4096
LARGE_PARTS, HOT_PARTS = 256, 10_000  # a group is large from these shares of a shard's bytes or of all rows on


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (place, shard) of the virtual nodes; a place that is taken goes to the shard drawn first."""
    taken: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(n_shards):
            digest = hashlib.sha256(f"{s}/{v}".encode()).digest()
            taken.setdefault(int.from_bytes(digest[:8], "big") >> (64 - RING_BITS), s)
    return sorted(taken.items())


def place_groups(nodes: list[tuple[int, int]], groups: list[tuple[int, int, int, int]], room: list[int]) -> dict[int, list[tuple[int, int]]]:
    """key -> (rows up to, shard) pieces of groups (key, place, rows, bytes of each), largest first; ``room`` is used up.

    A group goes whole to the first shard clockwise with room for it; where none has, it fills shard
    after shard with whole rows, and a row that fits nowhere goes where most room is left.
    """
    places = [p for p, _ in nodes]
    pieces: dict[int, list[tuple[int, int]]] = {}
    for key, place, n, size in sorted(groups, key=lambda g: (-g[2] * g[3], g[0])):
        start = bisect.bisect_left(places, place)
        order = list(dict.fromkeys(nodes[(start + i) % len(nodes)][1] for i in range(len(nodes)))) if n * size > min(room) else [nodes[start % len(nodes)][1]]
        whole = next((s for s in order if room[s] >= n * size), None)
        out = pieces.setdefault(key, [])
        done = 0
        for shard in [whole] if whole is not None else order:
            if take := min(n - done, room[shard] // size):
                room[shard] -= take * size
                done += take
                out.append((done, shard))
        while done < n:
            shard = max(order, key=lambda s: room[s])
            room[shard] = max(0, room[shard] - size)
            done += 1
            out.append((done, shard))
    return pieces


def allocate(nodes: list[tuple[int, int]], loads: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which part of each arc's load goes to which shard; ``room`` is used up.

    Nodes first take their own arcs, in ring order, up to the shard's room; what overflows goes on
    clockwise. The rooms add up to the whole load at least, so everything finds a place.
    """
    parts, rest = [], []
    for arc, ((_, shard), load) in enumerate(zip(nodes, loads, strict=True)):
        own = min(load, room[shard])
        room[shard] -= own
        if own:
            parts.append((arc, 0, own, shard))
        if load > own:
            rest.append((arc, own, load))
    for arc, done, load in rest:
        step = arc
        while done < load:
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            if more := min(load - done, room[shard]):
                room[shard] -= more
                if parts and parts[-1][0] == arc and parts[-1][3] == shard:
                    parts[-1] = (arc, parts[-1][1], done + more, shard)
                else:
                    parts.append((arc, done, done + more, shard))
                done += more
    return parts


def ring_shards(docs: DataFrame, n_shards: int = 40, vnodes: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Sizes are UTF-8 bytes plus ``overhead``; every shard holds at most ``1 + slack`` times the mean
    bytes, but for a group of copies, of a small part of a shard's bytes, at each place where an arc is
    cut. Copies of a text share a shard; only a group that no shard has room for is split. Null and
    empty texts are one group of ``overhead`` bytes each. Repeated rows are kept, each with its own
    slot; null ids are like others; an empty table gives an empty table. Columns of the input called
    like an added one are replaced.
    """
    spark = docs.sparkSession
    added = ("size", "shard", "slot")
    docs = docs.drop(*added)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"size": (F.octet_length(text) + F.lit(overhead)).cast("long"), "__key": F.xxhash64(text)})
    # rows that are alike in everything are told apart by their number among their copies, so none of them crowd a task
    rows = numbered_copies(rows.withColumn("__same", row_hash(rows)), "__same", "__copy")
    rows = rows.withColumn("__draw", F.xxhash64(F.col(id_col).cast("string"), "__key", "__same", "__copy")).drop("__same", "__copy")
    groups = materialise(rows.groupBy("__key").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__n")))
    total, n_rows = (int(x or 0) for x in groups.agg(F.sum("__bytes"), F.sum("__n")).first())
    bound = math.ceil(total / n_shards * (1 + slack))
    nodes, room = ring(n_shards, vnodes), [bound] * n_shards

    large = (F.col("__bytes") > bound / LARGE_PARTS) | (F.col("__n") > n_rows / HOT_PARTS)
    # at most LARGE_PARTS * n_shards + HOT_PARTS rows, whatever the input
    few = [(r[0], (r[0] % (1 << 64)) >> (64 - RING_BITS), int(r[1]), int(r[2]) // int(r[1])) for r in groups.where(large).select("__key", "__n", "__bytes").collect()]
    pieces = place_groups(nodes, few, room)
    cuts = "array<array<long>>"
    placed = spark.createDataFrame([(k, [list(x) for x in p]) for k, p in pieces.items()], f"__key long, __large {cuts}")
    rows = rows.join(F.broadcast(placed), "__key", "left")

    def at(cuts: Column, offset: Column) -> Column:
        """Shard of an offset (bytes of an arc, rows of a group): the first cut beyond it."""
        return F.coalesce(F.filter(cuts, lambda c: c[0] > offset)[0][1], F.element_at(cuts, -1)[1]).cast("int")

    keep = [*docs.columns, "size", "shard", "__draw", "__key"]
    small = _by_arc(groups.where(~large), nodes, room, n_rows)
    # rows of large groups meet no other: they get a key of their own, spread like the rest
    rest = rows.where(F.col("__large").isNull() | (F.size("__large") == 1)).withColumn("__k", F.when(F.col("__large").isNull(), F.col("__key")).otherwise(F.col("__draw")))
    small = small.select(F.col("__key").alias("__k"), at(F.col("__cuts"), F.col("__from")).alias("__shard"))
    out = rest.join(small, "__k", "left").withColumn("shard", F.coalesce(F.when(F.col("__large").isNotNull(), F.col("__large")[0][1].cast("int")), "__shard")).select(*keep)
    if any(len(p) > 1 for p in pieces.values()):
        out = out.unionByName(_split(rows.where(F.size("__large") > 1), n_rows, at).select(*keep))

    # slots: offsets of (shard, bucket) counts and a rank inside the bucket, so that no task holds a shard
    buckets = max(8, math.ceil(n_rows / n_shards / ROWS_PER_BUCKET))
    out = out.withColumn("__bucket", F.pmod("__draw", F.lit(buckets)))
    counts = out.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__first", F.sum("__c").over(W.partitionBy("shard").orderBy("__bucket")) - F.col("__c")).drop("__c")
    local = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy("__draw", "__key")) - 1
    out = out.withColumn("__local", local).join(counts, ["shard", "__bucket"])
    return out.withColumn("slot", F.col("__first") + F.col("__local")).select(*docs.columns, *added)


def _by_arc(groups: DataFrame, nodes: list[tuple[int, int]], room: list[int], n_rows: int) -> DataFrame:
    """(__key, __from, __cuts): each group's offset inside its arc, and the arc's cuts (to, shard)."""
    spark = groups.sparkSession
    places = [p for p, _ in nodes]
    owner = [(p, bisect.bisect_left(places, p) % len(nodes)) for p in range(1 << RING_BITS)]
    arc_of = spark.createDataFrame(owner, "__place int, __arc int")
    groups = groups.withColumn("__place", F.shiftrightunsigned("__key", 64 - RING_BITS).cast("int"))
    groups = groups.join(F.broadcast(arc_of), "__place").drop("__place")
    # offset of each text's group inside its arc; groups have one row each, so no arc is hot
    fine = 1 << max(0, math.ceil(math.log2(max(1, n_rows / len(nodes) / ROWS_PER_BUCKET))))
    groups = groups.withColumn("__sub", F.pmod(F.shiftrightunsigned("__key", 20), F.lit(fine)))
    by_sub = groups.groupBy("__arc", "__sub").agg(F.sum("__bytes").alias("__b"))
    loads = [0] * len(nodes)
    for arc, load in by_sub.groupBy("__arc").agg(F.sum("__b")).collect():  # one row an arc
        loads[arc] = int(load)
    cut: dict[int, list[list[int]]] = {}
    for arc, _, to, shard in allocate(nodes, loads, room):
        cut.setdefault(arc, []).append([to, shard])
    plan = spark.createDataFrame(list(cut.items()), "__arc int, __cuts array<array<long>>")
    before = by_sub.withColumn("__base", F.sum("__b").over(W.partitionBy("__arc").orderBy("__sub")) - F.col("__b")).drop("__b")
    running = F.sum("__bytes").over(W.partitionBy("__arc", "__sub").orderBy("__key")) - F.col("__bytes")
    placed = groups.withColumn("__in", running).join(before, ["__arc", "__sub"]).join(F.broadcast(plan), "__arc")
    return placed.select("__key", (F.col("__base") + F.col("__in")).alias("__from"), "__cuts")


def _split(rows: DataFrame, n_rows: int, at) -> DataFrame:
    """Rows of groups that are cut, with their shard by their rank in the group. Ranks are counted in lots."""
    lots = max(1, math.ceil(n_rows / ROWS_PER_BUCKET))
    rows = rows.withColumn("__lot", F.pmod(F.shiftrightunsigned("__draw", 8), F.lit(lots)))
    per = rows.groupBy("__key", "__lot").agg(F.count(F.lit(1)).alias("__c"))
    per = per.withColumn("__skip", F.sum("__c").over(W.partitionBy("__key").orderBy("__lot")) - F.col("__c")).drop("__c")
    rank = F.row_number().over(W.partitionBy("__key", "__lot").orderBy("__draw")) - 1
    rows = rows.withColumn("__rank", rank).join(per, ["__key", "__lot"])
    return rows.withColumn("shard", at(F.col("__large"), F.col("__skip") + F.col("__rank")))
