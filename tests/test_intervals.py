"""Points in intervals by bins, against plain search; one key with most of both."""

import random

import pytest
from pyspark.sql import functions as F

from prismara.operators import joins


def found(spark, points, intervals, kind="long"):
    p = spark.createDataFrame(points, f"k string, at {kind}, id long")
    i = spark.createDataFrame(intervals, f"k string, s {kind}, e {kind}, v long, o long")
    return {r["id"]: r["v"] for r in joins.interval_first(p, i, "k", "at", "s", "e", "v", "o", ["id"]).collect()}


def plain(points, intervals):
    out = {}
    for k, at, ident in points:
        held = [(o, v) for key, s, e, v, o in intervals if k is not None and key == k and at is not None and s is not None and e is not None and s <= at < e]
        out[ident] = min(held)[1] if held else None
    return out


@pytest.mark.parametrize("kind", ["long", "double"])
def test_first_interval(spark, kind):
    draw = random.Random(4)
    number = (lambda a, b: draw.randint(a, b)) if kind == "long" else (lambda a, b: draw.uniform(a, b))
    points = [(draw.choice(["a", "b", None]), number(-50, 1200), n) for n in range(400)] + [("a", None, 1000), ("z", number(0, 1), 1001)]
    intervals = []
    for n in range(150):
        start = number(-40, 1000)
        length = draw.choice([number(0, 3), number(1, 40), number(100, 900)])
        intervals.append((draw.choice(["a", "b", None]), start, start + length, n, n))
    intervals += [("a", number(5, 5), number(4, 4), 900, -1), ("a", None, number(9, 9), 901, -1), ("a", number(1, 1), None, 902, -1)]
    assert found(spark, points, intervals, kind) == plain(points, intervals)
    assert found(spark, points, intervals[:0], kind) == dict.fromkeys((p[2] for p in points))


def test_bounds_are_half_open(spark):
    assert found(spark, [("a", t, t) for t in range(6)], [("a", 1, 3, 10, 5), ("a", 2, 5, 20, 9)]) == {0: None, 1: 10, 2: 10, 3: 20, 4: 20, 5: None}


def test_one_key_of_many_points_and_intervals(spark):
    """A hundred thousand points and ten thousand intervals of one key make a few candidates a point."""
    points = spark.range(100_000).select(F.lit("k").alias("k"), (F.col("id") * 7).alias("at"), "id")
    intervals = spark.range(10_000).select(F.lit("k").alias("__k"), (F.col("id") * 70).alias("__s"), (F.col("id") * 70 + 20 + F.col("id") % 100).alias("__e"), F.col("id").alias("__v"), F.col("id").alias("__o"))
    # without the bounds every interval in a point's bins counts
    widened = joins.interval_candidates(points, intervals, "k", "at")
    assert 0 < widened.where("__v IS NOT NULL").count() < 300_000
    sizes = intervals.withColumn("level", F.ceil(F.log2((F.col("__e") - F.col("__s")).cast("double"))))
    binned = sizes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("__s") / F.pow(F.lit(2.0), "level")), F.floor(F.col("__e") / F.pow(F.lit(2.0), "level")))))
    assert binned.groupBy("level", "bin").count().agg(F.max("count")).first()[0] <= 4 and binned.count() <= 30_000
    best = joins.interval_first(points, intervals.select(F.col("__k").alias("k"), F.col("__s").alias("s"), F.col("__e").alias("e"), F.col("__v").alias("v"), F.col("__o").alias("o")), "k", "at", "s", "e", "v", "o", ["id"])
    wrong = best.join(points, "id").where("v IS NOT NULL AND NOT (at >= v * 70 AND at < v * 70 + 20 + v % 100)")
    assert wrong.count() == 0 and best.count() == 100_000


def test_places_are_shuffled_into_tasks_of_bounded_size(spark, monkeypatch):
    """A task's memory in gap_clusters does not follow from a fixed number of tasks."""
    from prismara.plans import catalog
    from prismara.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for name in ("gap_clusters", "gap_splits"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-rows // 100)
