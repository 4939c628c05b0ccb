"""Ranks over segments of any size: rows go to tasks by range, each task counts its own, and a small table says what lies before.

A window over a segment would put all of it into one task. Here a segment's rows lie in as many tasks as they need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def before(df: DataFrame, segment: Sequence[str], order: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: how many rows of the segment stand before a row, or the sum of their ``weight``. Nulls come first; of rows that are the same in ``order`` any comes first.

    The first pass sorts by range and numbers the rows where they are; the second adds what the tasks before hold of the segment, a row for
    each segment and task.
    """
    keys = [*segment, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = written(rows.withColumn("__task", F.shiftright("__at", 33).cast("int")), "ranges")
    mass = F.count(F.lit(1)) if weight is None else F.sum(weight)
    parts = rows.groupBy(*segment, "__task").agg(mass.alias("__n"), F.min("__at").alias("__low"))
    earlier = W.partitionBy(*segment).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias("__s" + str(i)) for i, c in enumerate(segment)], F.col("__task").alias("__t"), "__low", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    if weight is None:
        inside: Column = F.col("__at") - F.col("__low")
    else:  # a task's part of a segment
        here = W.partitionBy(*segment, "__task").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__inside", F.coalesce(F.sum(weight).over(here), F.lit(0)))
        inside = F.col("__inside")
    same = F.col("__task") == F.col("__t")
    for i, c in enumerate(segment):
        same = F.col(c).eqNullSafe(F.col("__s" + str(i))) & same
    return rows.join(parts, same).select(*df.columns, (F.col("__before") + inside).alias(name))


def tied(df: DataFrame, segment: Sequence[str], value: str, low: str, count: str) -> DataFrame:
    """``df`` with ``low``, the number of the segment's rows with a smaller value, and ``count``, of those with the same.

    Equal values are counted before anything is sorted, so ties of any number are one row of the ranking.
    """
    counted = df.groupBy(*segment, value).agg(F.count(F.lit(1)).alias(count))
    placed = before(counted, segment, [value], low, count)
    keys = [*segment, value]
    named = placed.select(*[F.col(c).alias("__k" + str(i)) for i, c in enumerate(keys)], low, count)
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col("__k" + str(i)))
    return df.join(named, same).drop(*["__k" + str(i) for i in range(len(keys))])


def sized(df: DataFrame, segment: Sequence[str], name: str) -> DataFrame:
    """``df`` with its segment's number of rows; the table joined has a row a segment."""
    counts = df.groupBy(*segment).agg(F.count(F.lit(1)).alias(name))
    named = counts.select(*[F.col(c).alias("__c" + str(i)) for i, c in enumerate(segment)], name)
    same = F.lit(True)
    for i, c in enumerate(segment):
        same = same & F.col(c).eqNullSafe(F.col("__c" + str(i)))
    return df.join(named, same).drop(*["__c" + str(i) for i in range(len(segment))])


def percent_rank(df: DataFrame, segment: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the share of the segment's other rows that have a smaller value; 0 for a segment's only row."""
    ranked = sized(tied(df, segment, value, "__low", "__same"), segment, "__all")
    share = F.when(F.col("__all") > 1, F.col("__low") / (F.col("__all") - 1)).otherwise(0.0)
    return ranked.select(*df.columns, share.alias(name))


def average_rank(df: DataFrame, segment: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of its value from 1, ties sharing their mean."""
    ranked = tied(df, segment, value, "__low", "__same")
    return ranked.select(*df.columns, (F.col("__low") + (F.col("__same") + 1) / 2.0).alias(name))


def ntile(df: DataFrame, segment: Sequence[str], order: Sequence[str], parts: int, name: str) -> DataFrame:
    """``df`` with its part, from 1, when each segment's rows are cut in order into ``parts`` of sizes at most one apart, larger ones first."""
    ranked = sized(before(df, segment, order, "__at"), segment, "__all")
    at, small, large = F.col("__at"), F.floor(F.col("__all") / parts), F.col("__all") % parts
    edge = large * (small + 1)
    tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(large + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    return ranked.select(*df.columns, (tile + 1).cast("int").alias(name))


def medians(df: DataFrame, segment: Sequence[str], value: str, name: str) -> DataFrame:
    """(segment, ``name``): the exact median of each segment's values that are not null; of an even number the mean of the two in the middle.

    Values are counted and placed by range, so no task holds all different values of a segment.
    """
    known = df.where(F.col(value).isNotNull()).select(*segment, F.col(value).alias("__v"))
    counted = known.groupBy(*segment, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = before(counted, segment, ["__v"], "__low", "__n")
    total = counted.groupBy(*segment).agg(F.sum("__n").alias("__all")).select(*[F.col(c).alias("__c" + str(i)) for i, c in enumerate(segment)], "__all")
    same = F.lit(True)
    for i, c in enumerate(segment):
        same = same & F.col(c).eqNullSafe(F.col("__c" + str(i)))
    inside = lambda at: (F.col("__low") <= at) & (at < F.col("__low") + F.col("__n"))
    lower, upper = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    share = (F.when(inside(lower), F.col("__v")).otherwise(0) + F.when(inside(upper), F.col("__v")).otherwise(0)) / 2
    return placed.join(total, same).where(inside(lower) | inside(upper)).groupBy(*segment).agg(F.sum(share).alias(name))
