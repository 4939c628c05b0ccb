"""Joins that the pipeline needs beyond plain equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import spatial


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key by a total order; keys with many rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return ranked.select(*keys, *[F.col("__first")[c].alias(c) for c in rest])


def iou_best(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: Sequence[str], right_order: str, keep, right_prefix: str = "r_", least: float = 0.0) -> DataFrame:
    """Each left box with the right box of its group that overlaps it most (the earliest of equals), where ``keep(iou)``.

    Candidates meet on the group's key (a frame), so boxes of different frames never meet. Where a group has many boxes they meet
    by tiles; ``keep`` then sees only overlaps, and may need no more than ``least``.
    """
    if spatial.crowded(right, on):
        place = [*on, *spatial.SIDES]
        best = spatial.best_overlaps(left, right, on, right_order, least, right_prefix)
        met = left.join(best, place, "left")
        good = keep(F.col("b.__iou"))
        taken = [F.when(good, F.col("b")[right_prefix + c]).alias(right_prefix + c) for c in right.columns if c not in on]
        rest = [c for c in left.columns if c not in left_id]
        return met.select(*left_id, *rest, F.when(good, F.col("b.__iou")).alias("iou"), *taken)
    r = right.select(*on, *[F.col(c).alias(right_prefix + c) for c in right.columns if c not in on])
    both = left.join(r, list(on), "left").withColumn("__iou", G.iou(G.box(), G.box(right_prefix)))
    rest = [c for c in both.columns if c not in left_id and c != "__iou"]
    best = both.groupBy(*left_id).agg(
        F.max_by(F.struct("__iou", *rest), F.struct(F.col("__iou"), (-F.col(right_prefix + right_order)))).alias("b"), F.first(F.struct(*[c for c in left.columns if c not in left_id])).alias("l")
    )
    good = keep(F.col("b.__iou"))
    cols = [F.col("l")[c].alias(c) for c in left.columns if c not in left_id]
    taken = [F.when(good, F.col("b")[right_prefix + c]).alias(right_prefix + c) for c in right.columns if c not in on]
    return best.select(*left_id, *cols, F.when(good, F.col("b.__iou")).alias("iou"), *taken)


def iou_unseen(candidates: DataFrame, seen: DataFrame, on: Sequence[str], limit: float = G.IOU_SEEN) -> DataFrame:
    """Candidates that overlap no seen box of their group by ``limit`` or more; by tiles where a group has many seen boxes."""
    if spatial.crowded(seen, on):
        return candidates.join(spatial.overlapped(candidates, seen, on, limit), [*on, *spatial.SIDES], "left_anti").select(*candidates.columns)
    s = seen.select(*on, *[F.col(c).alias("s_" + c) for c in ("x1", "y1", "x2", "y2")]).alias("s")
    c = candidates.alias("c")
    equal = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in on]
    hit = G.iou([F.col(f"c.{x}") for x in ("x1", "y1", "x2", "y2")], [F.col(f"s.s_{x}") for x in ("x1", "y1", "x2", "y2")]) >= limit
    cond = hit
    for e in equal:
        cond = e & cond
    return c.join(s, cond, "left_anti")


def greedy_unseen(candidates: DataFrame, on: Sequence[str], order: str, limit: float = G.IOU_SEEN) -> DataFrame:
    """Second stage: a candidate is dropped when it overlaps an accepted earlier one; a fold over the group's boxes in order.

    A group is one frame of one file; where one has many boxes, pairs by tiles and rounds over them take the fold's place.
    """
    if spatial.crowded(candidates, on):
        return spatial.first_apart(candidates, on, order, limit)
    box = F.struct(F.col(order).alias("o"), "x1", "y1", "x2", "y2")
    kind = "array<struct<o:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"
    boxes = candidates.groupBy(*on).agg(F.array_sort(F.collect_list(box)).cast(kind).alias("b"))
    parts = lambda s: [s[c] for c in ("x1", "y1", "x2", "y2")]
    kept = F.aggregate("b", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: G.iou(parts(k), parts(x)) >= limit), acc).otherwise(F.array_append(acc, x)))
    return boxes.select(*on, F.explode(kept).alias("k")).select(*on, F.col("k.o").alias(order), "k.x1", "k.y1", "k.x2", "k.y2")


def interval_candidates(points: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """Points with the intervals (__k, __s, __e, ...) of their key that hold them; a point that none holds stands once, with nulls.

    An interval lies on the level of bins about as wide as itself and in three of them at most; a point asks one bin of each level that there
    is. So points meet only intervals that begin or end near them, whatever a key has of both, and a key is spread over its bins.
    """
    length = (F.col("__e").cast("double") - F.col("__s").cast("double")).alias("__length")
    real = intervals.where(F.col("__s") < F.col("__e")).withColumn("__level", F.greatest(F.ceil(F.log2(length)), F.lit(-64)).cast("int"))
    levels = sorted(r[0] for r in real.select("__level").distinct().collect() if r[0] is not None)  # as many as doubles have exponents, at most
    bin_of = lambda c: F.floor(c.cast("double") / F.pow(F.lit(2.0), F.col("__level").cast("double")))
    real = real.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__s")), bin_of(F.col("__e")))))
    asking = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels or [0]]))).withColumn("__asked", bin_of(F.col(at)))
    asking = asking.withColumnRenamed("__level", "__at_level")
    same = (F.col(key) == F.col("__k")) & (F.col("__at_level") == F.col("__level")) & (F.col("__asked") == F.col("__bin"))
    return asking.join(real, same & (F.col(at) >= F.col("__s")) & (F.col(at) < F.col("__e")), "left")


def interval_first(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, value: str, order: str, point_id: Sequence[str]) -> DataFrame:
    """Each point with the first interval [start, end) of its key that holds it, null without one. Empty and unbounded intervals hold nothing."""
    i = intervals.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(value).alias("__v"), F.col(order).alias("__o"))
    hit = interval_candidates(points.select(*point_id, *[c for c in (key, at) if c not in point_id]), i, key, at)
    return hit.groupBy(*point_id).agg(F.min_by("__v", "__o").alias(value))


def scene_at(points: DataFrame, cuts: DataFrame, key: str, at: str) -> DataFrame:
    """As-of lookup: scene number = cuts of the key at or before the point, 1 at least.

    Cuts and points are sorted together once a key; no pair of them is built.
    """
    cols = points.columns
    p = points.withColumn("__cut", F.lit(0))
    c = cuts.select(key, at).distinct().withColumn("__cut", F.lit(1))
    both = p.unionByName(c, allowMissingColumns=True)
    order = W.partitionBy(key).orderBy(F.col(at), F.col("__cut").desc()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("scene", F.greatest(F.lit(1), F.sum("__cut").over(order)).cast("int")).where("__cut = 0").select(*cols, "scene")


def bucket_at(position: Column, bounds: Column) -> Column:
    """Index of the bucket b[i] <= position < b[i+1]."""
    return F.size(F.filter(bounds, lambda b: b <= position)) - 1


def align_ordinal(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """i-th left row against i-th right row of a key, with ``row_type``: matched, left_only or right_only; right columns get ``r_``."""
    a = left.withColumn("ordinal", F.row_number().over(W.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("ordinal", F.row_number().over(W.partitionBy(key).orderBy(*right_order)))
    a = a.withColumn("__l", F.lit(1))
    b = b.select(key, "ordinal", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key], F.lit(1).alias("__r"))
    kind = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("matched")
    return a.join(b, [key, "ordinal"], "full_outer").withColumn("row_type", kind).drop("__l", "__r")


def attach_scores(packages: DataFrame, scores: DataFrame, scene: str, persons: str, track: str, score: str) -> DataFrame:
    """Packages (one row a scene, with an array of person structs) with the scores of (scene, track) put into their persons.

    A person without one keeps what it has. Scores of a scene are few, so they travel as one map.
    """
    by_scene = scores.groupBy(F.col(scene).alias("__s")).agg(F.map_from_entries(F.collect_list(F.struct(track, score))).alias("__m"))
    put = lambda p: p.withField(score, F.coalesce(F.try_element_at("__m", p[track]), p[score]))
    return packages.join(by_scene, F.col(scene) == F.col("__s"), "left").withColumn(persons, F.transform(persons, put)).drop("__s", "__m")


def pending(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Work without a finished row."""
    return work.join(done.select(*on).distinct(), list(on), "left_anti")
