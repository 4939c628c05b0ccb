"""Joins of boxes by tiles.

A box lies on the level of tiles just as wide as its longer side, so it touches four of them at most. Two boxes meet on the level of the larger
one, in the tile that holds the lower corner of what they share, and so once only. Of two boxes in a tile one is of its level: small boxes
in a large tile do not meet each other there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.tables import written

SIDES = ["x1", "y1", "x2", "y2"]
CROWD = 256


def crowded(boxes: DataFrame, on: Sequence[str], limit: int = CROWD) -> bool:
    """Whether a group has more than ``limit`` boxes; others are joined by their key alone."""
    return not boxes.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).isEmpty()


def _level(prefix: str = "") -> Column:
    x1, y1, x2, y2 = G.box(prefix)
    return F.ceil(F.log2(F.greatest(x2 - x1, y2 - y1).cast("double"))).cast("int")


def _tiled(boxes: DataFrame, prefix: str, levels: Column) -> DataFrame:
    """A row for each level and tile that a box touches."""
    x1, y1, x2, y2 = (c.cast("double") for c in G.box(prefix))
    size = F.pow(F.lit(2.0), F.col("__level").cast("double"))
    rows = boxes.withColumn("__level", F.explode(levels))
    rows = rows.withColumn("__x", F.explode(F.sequence(F.floor(x1 / size), F.ceil(x2 / size) - 1)))
    return rows.withColumn("__y", F.explode(F.sequence(F.floor(y1 / size), F.ceil(y2 / size) - 1)))


def candidates(left: DataFrame, right: DataFrame, on: Sequence[str], least: float = 0.0, prefix: str = "r_") -> DataFrame:
    """Pairs of boxes of a group that share some area, each once; the right box's columns get ``prefix``.

    ``least`` > 0: only pairs whose sides allow that much overlap of their union. Boxes without an area are in no pair. The pairs that
    are looked at are those whose tiles touch, so with boxes spread over the plane they grow with the boxes.
    """
    right = right.select(*on, *[F.col(c).alias(prefix + c) for c in right.columns if c not in on])
    a, b = G.box(), G.box(prefix)
    left = left.where((a[2] > a[0]) & (a[3] > a[1])).withColumn("__own", _level())
    right = right.where((b[2] > b[0]) & (b[3] > b[1])).withColumn("__rown", _level(prefix))
    if least > 0:  # the longer sides of such boxes are alike up to this many levels
        top = [F.col(c) + math.ceil(math.log2(1 / least)) for c in ("__own", "__rown")]
    else:
        most = left.agg(F.max("__own")).first()[0], right.agg(F.max("__rown")).first()[0]
        if None in most:
            most = (0, 0)
        top = [F.greatest(F.col("__own"), F.lit(most[1])), F.greatest(F.col("__rown"), F.lit(most[0]))]
    keys = [*on, "__level", "__x", "__y"]
    mine, theirs = _tiled(left, "", F.sequence("__own", top[0])), _tiled(right, prefix, F.sequence("__rown", top[1]))
    met = mine.where("__level = __own").join(theirs, keys).unionByName(mine.where("__level > __own").join(theirs.where("__level = __rown"), keys))
    size = F.pow(F.lit(2.0), F.col("__level").cast("double"))
    home = (F.floor(F.greatest(a[0], b[0]).cast("double") / size) == F.col("__x")) & (F.floor(F.greatest(a[1], b[1]).cast("double") / size) == F.col("__y"))
    shared = (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))
    return met.where(home & shared).drop("__own", "__rown", "__level", "__x", "__y")


def _places(boxes: DataFrame, on: Sequence[str]) -> DataFrame:
    return boxes.select(*on, *SIDES).distinct()


def best_overlaps(left: DataFrame, right: DataFrame, on: Sequence[str], right_order: str, least: float, prefix: str) -> DataFrame:
    """(on, box, b): for each place of left boxes the struct of ``__iou`` and the right box that overlaps it most, the earliest of equals.

    Boxes at the same place are one, so copies make no pairs.
    """
    rest = [c for c in right.columns if c not in (*on, *SIDES)]
    earliest = right.groupBy(*on, *SIDES).agg(F.min_by(F.struct(*rest), F.col(right_order)).alias("__r"))
    earliest = earliest.select(*on, *SIDES, *[F.col("__r")[c].alias(c) for c in rest])
    pairs = candidates(_places(left, on), earliest, on, least, prefix).withColumn("__iou", G.iou(G.box(), G.box(prefix)))
    taken = F.struct("__iou", *[prefix + c for c in right.columns if c not in on])
    return pairs.groupBy(*on, *SIDES).agg(F.max_by(taken, F.struct(F.col("__iou"), -F.col(prefix + right_order))).alias("b"))


def overlapped(candidate: DataFrame, seen: DataFrame, on: Sequence[str], limit: float) -> DataFrame:
    """(on, box) of candidates' places that overlap a seen box by ``limit`` or more."""
    pairs = candidates(_places(candidate, on), _places(seen, on), on, limit)
    return pairs.where(G.iou(G.box(), G.box("r_")) >= limit).select(*on, *SIDES).distinct()


def overlapping_pairs(boxes: DataFrame, on: Sequence[str], order: str) -> DataFrame:
    """Pairs of a group's boxes that share some area, the earlier one left; by key where groups are small, else by tiles."""
    if crowded(boxes, on):
        return candidates(boxes, boxes, on).where(F.col(order) < F.col("r_" + order))
    right = boxes.select(*on, *[F.col(c).alias("r_" + c) for c in boxes.columns if c not in on])
    return boxes.join(right, list(on)).where((F.col(order) < F.col("r_" + order)) & (G.iou(G.box(), G.box("r_")) > 0))


def first_apart(boxes: DataFrame, on: Sequence[str], order: str, limit: float) -> DataFrame:
    """Boxes that overlap no earlier one of those kept by ``limit`` or more: the fold over a group's boxes in order, in rounds.

    In each round the boxes that no undecided earlier one overlaps are kept, and those that they overlap go. A round decides every box at the
    head of its pairs, so there are as many as the longest chain of boxes that each hide the next.
    """
    nodes = written(boxes.select(*on, order, *SIDES).withColumn("__id", F.monotonically_increasing_id()), "boxes")
    rank = F.struct(F.col(order), *[F.col(c) for c in SIDES], F.col("__id"))
    placed = nodes.withColumn("__rank", rank)
    pairs = candidates(placed, placed, on, limit).where((F.col("__rank") < F.col("r___rank")) & (G.iou(G.box(), G.box("r_")) >= limit))
    left = written(pairs.select(F.col("__id").alias("a"), F.col("r___id").alias("b")), "pairs")
    gone = None
    while not left.isEmpty():
        heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        hidden = written(left.join(heads, "a", "left_semi").select(F.col("b").alias("__id")).distinct(), "hidden")
        gone = hidden if gone is None else gone.unionByName(hidden)
        decided = heads.select(F.col("a").alias("__id")).unionByName(hidden)
        left = left.join(decided.withColumnRenamed("__id", "a"), "a", "left_anti").join(hidden.withColumnRenamed("__id", "b"), "b", "left_anti").select("a", "b")
        left = written(left, "pairs")
    kept = nodes if gone is None else nodes.join(gone, "__id", "left_anti")
    return kept.select(*on, order, *SIDES)
