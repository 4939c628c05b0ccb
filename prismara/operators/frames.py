"""Scenes from the frames' contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import content_difference

#: The difference from which a frame begins a new scene, and a scene's least number of frames.
CONTENT_THRESHOLD, LEAST_FRAMES = 27.0, 5
BLOCK = 4096


def content_values(frames: DataFrame, key: str, frame: str, pixels: str, kind: str = "hsv", block: int = BLOCK) -> DataFrame:
    """(key, frame, value): how much a frame differs from the one before it, null for a media's first frame and after a missing one.

    Frames are compared in blocks of consecutive numbers, each with a copy of the last frame before it, so a long video is the work of many tasks
    and each frame is shuffled once.
    """
    number = F.col(frame)
    home = F.floor(number / block)
    rows = frames.select(key, frame, pixels, F.explode(F.when((number + 1) % block == 0, F.array(home, home + 1)).otherwise(F.array(home))).alias("__block"))
    order = W.partitionBy(key, "__block").orderBy(frame)
    before = F.when(F.lag(frame).over(order) == number - 1, F.lag(pixels).over(order))
    paired = rows.withColumn("__before", before).where(F.floor(number / block) == F.col("__block"))
    return paired.select(key, frame, content_difference(F.col(pixels), F.col("__before"), kind).alias("value"))


def _last(candidates: Column, start: Column, least: int) -> Column:
    """The last cut after a fold over candidates, where the last one before them was ``start``."""
    return F.aggregate(candidates, start, lambda last, c: F.when(c - last >= least, c).otherwise(last))


def spaced(candidates: DataFrame, firsts: DataFrame, key: str, at: str, first: str, least: int = LEAST_FRAMES, block: int = BLOCK) -> DataFrame:
    """(key, at): candidates in their order, each at least ``least`` after the one kept before it, or after the key's ``first``.

    What a block of candidates keeps depends only on how far the last one kept lies before it, and beyond ``least`` no more. So each block
    is folded once for every such distance, a key's blocks are joined by their outcomes, which are few, and then every block knows what it keeps.
    """
    rows = candidates.select(key, F.col(at).cast("long").alias("at")).distinct().join(firsts.select(key, F.col(first).cast("long").alias("first")), key)
    blocks = rows.groupBy(key, F.floor(F.col("at") / block).alias("block")).agg(F.array_sort(F.collect_list("at")).alias("c"), F.min("first").alias("first"))
    start = F.col("block") * block
    ends = F.array(*[_last(F.col("c"), F.when(F.col("first") >= start, F.col("first")).otherwise(start - k), least) for k in range(1, least + 1)])
    outcomes = blocks.groupBy(key).agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", ends.alias("ends")))).alias("o"))

    def step(s: Column, b: Column) -> Column:
        away = F.greatest(F.least(b["block"] * block - s["last"], F.lit(least)), F.lit(1))
        return F.struct(F.get(b["ends"], (away - 1).cast("int")).alias("last"), F.array_append(s["before"], s["last"]).alias("before"))

    walk = F.aggregate("o", F.struct(F.col("first").alias("last"), F.array().cast("array<bigint>").alias("before")), step)
    known = outcomes.select(key, F.explode(F.arrays_zip(F.col("o.block").alias("block"), walk["before"].alias("before"))).alias("z"))
    met = blocks.join(known.select(key, F.col("z.block").alias("block"), F.col("z.before").alias("before")), [key, "block"])
    none = F.array().cast("array<bigint>")
    kept = F.aggregate("c", F.struct(F.col("before").alias("last"), none.alias("k")), lambda s, c: F.when(c - s["last"] >= least, F.struct(c.alias("last"), F.array_append(s["k"], c).alias("k"))).otherwise(s))
    return met.select(key, F.explode(kept["k"]).alias(at))


def content_cuts(frames: DataFrame, key: str, frame: str, pixels: str, kind: str = "hsv", threshold: float = CONTENT_THRESHOLD, least: int = LEAST_FRAMES, block: int = BLOCK) -> DataFrame:
    """(key, frame) where a new scene begins by its content; a media's first frame begins one as well and is not listed."""
    values = content_values(frames, key, frame, pixels, kind, block)
    firsts = frames.groupBy(key).agg(F.min(frame).alias("__first"))
    return spaced(values.where(F.col("value") >= threshold), firsts, key, frame, "__first", least, block)
