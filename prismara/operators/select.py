"""Order-sensitive operators: best candidates, cuts and segments, gap clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Thresholds of the segmentation.
MAX_FRAME_GAP = 5
FRONTAL, PROFILE = 4, 2
DISPLACEMENT = 0.20
MIN_SCENE = 10
PERSON_CLASS, DETECTOR_CONF = 0, 0.35


def best_rows(df: DataFrame, keys: Sequence[str], score: Column, order: str) -> DataFrame:
    """Row of the largest score of each key; of equal scores the one that comes first by ``order``.

    A partial maximum is taken before the shuffle, so blocks of frames fold like the whole.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.where(score.isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(score.alias("score"), *rest), F.struct(score, -F.col(order))).alias("b"))
    return best.select(*keys, "b.*")


def confident_persons(boxes: DataFrame, cls: str, conf: str, least: float = DETECTOR_CONF) -> DataFrame:
    """Boxes of the person class that a detector is sure enough of."""
    return boxes.where((F.col(cls) == PERSON_CLASS) & (F.col(conf) >= least))


def demanding(persons: DataFrame, behaviour: str, demand_only: bool = False) -> DataFrame:
    """Persons whose faces are scored: all of them, or those who make a demand.

    The optimizer would put a parsed behaviour's whole expression into the filter and parse once more for each of its uses, so the choice is
    a list of one row or none, which is made once and unnested.
    """
    if not demand_only:
        return persons
    chosen = F.filter(F.array(F.struct(*[F.col(f"`{c}`") for c in persons.columns])), lambda p: F.coalesce(p[behaviour], F.lit("")).startswith("demand"))
    return persons.select(F.inline(chosen))


def face_turns(obs: DataFrame, key: str, frame: str, points: str) -> DataFrame:
    """Frames at which a track turns between frontal and profile within a few frames."""
    w = W.partitionBy(key).orderBy(frame)
    before, gap = F.lag(points).over(w), F.col(frame) - F.lag(frame).over(w)
    now = F.col(points)
    turned = ((before >= FRONTAL) & (now <= PROFILE)) | ((before <= PROFILE) & (now >= FRONTAL))
    return obs.withColumn("turn", F.coalesce((gap <= MAX_FRAME_GAP) & turned, F.lit(False))).where("turn").drop("turn")


def displacements(obs: DataFrame, keys: Sequence[str], frame: str, limit: float = DISPLACEMENT) -> DataFrame:
    """Rows whose centre moved by more than ``limit`` of the mean width since the row before."""
    w = W.partitionBy(*keys).orderBy(frame)
    cx, cy, width = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0, F.col("x2") - F.col("x1")
    step = F.hypot(cx - F.lag(cx).over(w), cy - F.lag(cy).over(w))
    mean = (width + F.lag(width).over(w)) / 2.0
    near = F.col(frame) - F.lag(frame).over(w) <= MAX_FRAME_GAP
    moved = near & (mean > 0) & (step / mean > limit)
    return obs.withColumn("moved", F.coalesce(moved, F.lit(False))).where("moved").drop("moved")


def thin_cuts(cuts: Column, total: Column, least: int = MIN_SCENE) -> Column:
    """Of ascending cuts those ``least`` or more after the last kept one (0 at first) and before the end; a fold, as each choice depends on the one before."""
    state = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        keep = (c - acc["last"] >= least) & (total - c >= least)
        return F.struct(F.when(keep, c).otherwise(acc["last"]).alias("last"), F.when(keep, F.array_append(acc["kept"], c)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(F.array_distinct(cuts)).cast("array<bigint>"), state, step, lambda acc: acc["kept"])


def intervals(cuts: DataFrame, key: str, at: str, total: str) -> DataFrame:
    """(key, start, end, ordinal): half-open intervals from ascending starts, the last one up to the total."""
    w = W.partitionBy(key).orderBy(at)
    return cuts.select(key, F.col(at).alias("start"), F.coalesce(F.lead(at).over(w), F.col(total)).alias("end"), F.row_number().over(w).alias("ordinal"))


def sub_labels(parts: DataFrame, scene: Sequence[str], order: str) -> DataFrame:
    """Label ``n`` of a scene in one part, else ``n.k``."""
    w = W.partitionBy(*scene)
    k = F.row_number().over(w.orderBy(order))
    number = F.col(scene[-1]).cast("string")
    return parts.withColumn("label", F.when(F.count(F.lit(1)).over(w) == 1, number).otherwise(F.concat_ws(".", number, k.cast("string"))))


def gap_clusters(df: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Rows with ``cluster``, which grows where the position is more than ``gap`` after the one before."""
    w = W.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("__new")


def cluster_means(df: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    return gap_clusters(df, key, at, gap).groupBy(key, "cluster").agg(F.floor(F.avg(at)).cast("long").alias("centre"), F.count(F.lit(1)).alias("n"))


def gap_splits(df: DataFrame, key: str, at: str, gap: Column) -> DataFrame:
    """Midpoints of neighbours that are more than ``gap`` apart."""
    nxt = F.lead(at).over(W.partitionBy(key).orderBy(at))
    return df.withColumn("__n", nxt).where(F.col("__n") - F.col(at) > gap).select(key, ((F.col(at) + F.col("__n")) / 2.0).alias("split"))


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key, by a total order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("f")).select(*keys, "f.*")


def forward_fill(df: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Each row with the last non-null value of its key up to it."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(w))
