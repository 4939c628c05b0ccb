"""Panels of collages: grids between cuts, panels with persons, and the choice of a method."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import overlapping_pairs

#: Cuts count between these shares of a side; a panel has this share of both sides at least; coverage bounds of the methods.
INNER, LEAST_SIDE, LEAST_PANELS = (0.1, 0.9), 0.15, 2
COVERAGE = {"yolo": (0.5, 1.5), "contours": (0.5, 1.5), "hough_lines": (0.85, 1.15)}


def _intervals(cuts: Column, side: int) -> Column:
    """(at, size) structs between the inner cuts and the borders."""
    edge = lambda v: F.array(F.lit(v).cast("long"))
    inner = F.filter(cuts, lambda c: (c > side * INNER[0]) & (c < side * INNER[1]))
    all_ = F.array_sort(F.array_distinct(F.concat(edge(0), inner, edge(side))))
    pairs = F.transform(F.slice(all_, 1, F.size(all_) - 1), lambda c, i: F.struct(c.alias("at"), (F.get(all_, i + 1) - c).alias("size")))
    return F.filter(pairs, lambda p: p["size"] > side * LEAST_SIDE)


def drifts(side: int, degrees: int = 4) -> list[int]:
    """How far lines of up to ``degrees`` off the axis drift over a side, in pixels, a degree apart."""
    return sorted({round(math.tan(math.radians(d)) * side) for d in range(-degrees, degrees + 1)})


def dividing_lines(points: DataFrame, means: DataFrame, key: str, width: int, height: int, votes: int = 100, least: int = 200, gap: int = 50, margin: int = 10, contrast: float = 30.0) -> DataFrame:
    """(key, across, down): where vertical and horizontal lines divide a picture, as arrays of positions.

    ``points`` (key, x, y) are a picture's edges, ``means`` (key, across, down) the brightness of its columns and rows. Every point votes for the
    lines of each slope through it; lines with ``votes`` or more are parted where more than ``gap`` pixels are missing. Parts
    count that are ``least`` and two fifths of the shorter side long and go over more than half of the picture, with a ``contrast`` between the ``margin``
    pixels on their two sides. Positions closer than 3 % of the side are one. Votes are counted before they are shuffled, and only
    points of lines with enough of them go on; the work is linear in the points.
    """
    x, y = F.col("x"), F.col("y")

    def along(kind: str, side: int, at: Column, off: Column) -> DataFrame:
        drift = F.col("drift")
        rows = points.select(key, x, y, F.explode(F.array(*[F.lit(d) for d in drifts(side)])).alias("drift"))
        return rows.select(key, F.lit(kind).alias("kind"), "drift", (off - F.floor(drift * at / F.lit(side))).cast("long").alias("from"), at.cast("long").alias("at"))

    cast = along("v", height, y, x).unionByName(along("h", width, x, y))
    line = [key, "kind", "drift", "from"]
    strong = cast.groupBy(*line).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= votes).drop("n")
    order = W.partitionBy(*line).orderBy("at")
    run = F.sum(F.when(F.col("at") - F.lag("at").over(order) > gap, 1).otherwise(0))
    runs = cast.join(strong, line, "left_semi").withColumn("run", run.over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = runs.groupBy(*line, "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    side, other = F.when(F.col("kind") == "v", height).otherwise(width), F.when(F.col("kind") == "v", width).otherwise(height)
    extent = F.col("b") - F.col("a")
    place = lambda at: F.col("from") + F.floor(F.col("drift") * at / side)
    parts = parts.where((extent >= max(least, 0.4 * min(width, height))) & (extent > 0.5 * side))
    parts = parts.select(key, "kind", F.floor((place(F.col("a")) + place(F.col("b"))) / 2).cast("int").alias("pos"), other.alias("size")).distinct()
    values = F.when(F.col("kind") == "v", F.col("across")).otherwise(F.col("down"))
    mean = lambda start: F.aggregate(F.slice(values, start, F.lit(margin)), F.lit(0.0), lambda s, v: s + v) / margin
    inside = (F.col("pos") >= margin) & (F.col("pos") <= F.col("size") - margin)
    parts = parts.join(means, key).where(inside & (F.abs(mean(F.col("pos") - margin + 1) - mean(F.col("pos") + 1)) > contrast))
    near = W.partitionBy(key, "kind").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(near) > F.col("size") * 0.03, 1).otherwise(0)
    groups = parts.select(key, "kind", "pos", new.alias("new")).withColumn("group", F.sum("new").over(near.rowsBetween(W.unboundedPreceding, 0)))
    cuts = groups.groupBy(key, "kind", "group").agg(F.floor(F.avg("pos")).alias("cut"))
    wanted = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("cut"))))
    return cuts.groupBy(key).agg(wanted("v").alias("across"), wanted("h").alias("down"))


def grid(media: DataFrame, across: str, down: str, width: int, height: int) -> DataFrame:
    """One row a panel of a media's cuts (arrays): the columns' intervals with the rows' ones, both few."""
    kept = [c for c in media.columns if c not in (across, down)]
    rows = media.select(*kept, F.explode(_intervals(F.col(across), width)).alias("c"), F.lit(1).alias("__one"), _intervals(F.col(down), height).alias("__d"))
    rows = rows.select(*kept, "c", F.explode("__d").alias("r"))
    return rows.select(*kept, F.col("c.at").alias("x"), F.col("r.at").alias("y"), F.col("c.size").alias("w"), F.col("r.size").alias("h"))


def with_person(panels: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Panels with the centre of a box of their media inside."""
    b = boxes.select(F.col(key).alias("__k"), ((F.col("x1") + F.col("x2")) / 2.0).alias("__cx"), ((F.col("y1") + F.col("y2")) / 2.0).alias("__cy"))
    inside = (F.col("__cx") > F.col("x")) & (F.col("__cx") < F.col("x") + F.col("w")) & (F.col("__cy") > F.col("y")) & (F.col("__cy") < F.col("y") + F.col("h"))
    return panels.join(b, (F.col(key) == F.col("__k")) & inside, "left_semi")


def method(panels: DataFrame, key: str, kind: str, order: str, area: int) -> DataFrame:
    """(key, method): the first method, in the order of COVERAGE, whose panels are enough, cover the picture and overlap little; else none.

    Panels meet inside their picture and method only.
    """
    over = overlapping_pairs(panels.select(key, kind, order, "x1", "y1", "x2", "y2"), [key, kind], order)
    over = over.groupBy(key, kind).agg(F.count(F.lit(1)).alias("__over"))
    cover = F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / F.lit(area)
    per = panels.groupBy(key, kind).agg(F.count(F.lit(1)).alias("__n"), cover.alias("__cover")).join(over, [key, kind], "left")
    good, rank = F.lit(False), F.lit(len(COVERAGE))
    for i, (name, (low, high)) in enumerate(COVERAGE.items()):
        fits = (F.col("__cover") > low) & (F.col("__cover") < high)
        if name != "hough_lines":
            fits = fits & (F.coalesce("__over", F.lit(0)) < F.floor(F.col("__n") / 2))
        good = F.when(F.col(kind) == name, fits).otherwise(good)
        rank = F.when(F.col(kind) == name, i).otherwise(rank)
    first = F.min_by(kind, F.when(good & (F.col("__n") >= LEAST_PANELS), rank))
    return per.groupBy(key).agg(F.coalesce(first, F.lit("none")).alias("method"))
