"""Distributions, statistics, status and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rounding as R
from ..functions import textparse as T
from . import ranks

FAILED_RATE = 0.5  # fixed value: failed from this rate on


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """JSON object of value counts by sorted value; a missing value counts as ''."""
    counts = df.groupBy(*keys, F.coalesce(value, F.lit("")).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__v"), F.col("__n"))))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("distribution"))


def any_flag(c: Column) -> Column:
    """1 if any is 1, 0 if there is one at all, else null."""
    return F.max(c)


def score_statistics(df: DataFrame, keys: Sequence[str], score: str, digits: int = 2) -> DataFrame:
    """Number, mean, exact median, least, greatest and population deviation of the scores there are, a row a key; keys without any have a row of nulls.

    The median is found by ranges of values; the other figures are sums that are taken before the shuffle.
    """
    x = F.col(score)
    rest = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_pop(x).alias("spread"))
    middle = ranks.medians(df.select(*keys, score), keys, score, "median").select(*[F.col(k).alias(f"__{k}") for k in keys], "median")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rest.join(middle, same, "left")
    return out.select(*keys, "n", *[R.scaled_round(c, digits).alias(c) for c in ("mean", "median", "low", "high", "spread")])


def first_mode(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Most common value that says something; of equals the one seen first; ``NA`` without any."""
    v = T.normal(F.col(value))
    counts = df.withColumn("__v", v).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    said = F.when(F.col("__v") != "NA", F.struct("n", (-F.col("first")).alias("f")))
    return counts.groupBy(*keys).agg(F.coalesce(F.max_by("__v", said), F.lit("NA")).alias("mode"))


def analysis_status(persons: Column, valid: Sequence[Column]) -> tuple[Column, Column]:
    """(failure rate, status) of a file: answers missing among persons times attributes."""
    missing = F.lit(0)
    for n in valid:
        missing = missing + F.greatest(F.lit(0), persons - n)
    expected = persons * len(valid)
    rate = F.when(expected > 0, R.scaled_round(missing / expected, 3)).otherwise(0.0)
    status = F.when(expected == 0, "ok").when(missing / F.greatest(expected, F.lit(1)) >= FAILED_RATE, "failed").when(missing > 0, "partial").otherwise("ok")
    return rate, status


def mismatches(pairs: Sequence[tuple[Column, Column, bool]]) -> Column:
    """How many (machine, manual, binary) pairs say something on both sides and differ."""
    out = F.lit(0)
    for a, b, binary in pairs:
        x, y = T.normal(a, binary), T.normal(b, binary)
        says = ~x.isin("NA", "no analizado", "") & ~y.isin("NA", "")
        out = out + F.when(says & (x != y), 1).otherwise(0)
    return out


def name_counts(df: DataFrame, keys: Sequence[str], names: str, track: str) -> DataFrame:
    """Of lists of names: how many rows, the JSON counts of the names, and of how many tracks."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.countDistinct(track).alias("tracks"))
    each = df.select(*keys, F.explode(names).alias("__name"))
    return per.join(distribution(each, keys, "__name"), list(keys), "left")


def face_means(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Faces of an image and the mean of their scores that are numbers, to 2 decimals, ``NA`` without any."""
    mean = R.scaled_round(F.avg(F.col(score).try_cast("double")), 2)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_faces"), F.coalesce(mean.cast("string"), F.lit("NA")).alias("mean_score"))


def means_in_order(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], digits: int) -> DataFrame:
    """Answers, scores that are numbers and their mean, null without any, a row a key; the scores are added up by ``order``.

    A sum of doubles in another order may differ in its last bit and put a mean on the other side of a half. The running sum is a window that
    spills, so no key's scores are held in memory at once.
    """
    rows = df.select(*keys, *order, F.col(score).try_cast("double").alias("__x"))
    so_far = F.sum("__x").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("__sum", so_far).groupBy(*keys)
    out = out.agg(F.count(F.lit(1)).alias("answers"), F.count("__x").alias("scores"), F.max_by("__sum", F.struct(*order)).alias("__sum"))
    return out.select(*keys, "answers", "scores", R.scaled_round(F.col("__sum") / F.nullif("scores", F.lit(0)), digits).alias("mean_score"))


def most_common(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Values that say something with their counts, the most common first, of equals the one seen first."""
    counts = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__f"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "__f"))).drop("__f")


def cell_state(machine: Column, manual: Column, binary: bool, row_type: Column) -> Column:
    """How a cell of the comparison is shown: a side alone, not analysed, not comparable, equal or different."""
    x, y = T.normal(machine, binary), T.normal(manual, binary)
    alone = F.when(row_type == "left_only", "manual_only").when(row_type == "right_only", "ai_only")
    return F.coalesce(alone, F.when(x == "no analizado", "not_analysed").when((x == "NA") | (y == "NA"), "blank").when(x == y, "equal").otherwise("different"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, from the confusion table's margins."""
    table = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = table.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = table.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("r")), table.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("e"))
    both = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return both.select(F.col("t").alias("n"), F.when(F.col("t") > 0, po).alias("agreement"), F.when((F.col("t") > 0) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"))


def moving_rate(df: DataFrame, key: str, order: Sequence[Column], amount: str, seconds: str, calls: int = 20) -> DataFrame:
    """Amount a second over the last ``calls`` rows of a key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(1 - calls, 0)
    return df.withColumn("rate", F.try_divide(F.sum(amount).over(w), F.sum(seconds).over(w)))
