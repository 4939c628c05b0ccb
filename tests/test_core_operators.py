"""Operators on small fixtures, those without an oracle against a plain Python version."""

import numpy as np
from pyspark.sql import functions as F

from prismara.functions import geometry as G
from prismara.functions import textparse as T
from prismara.operators import dedup, joins, select
from prismara.plans import virtual
from prismara.sources import media, results
from prismara.streaming import jobs, ledger


def values(spark, texts, parse):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", parse(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_gender_lines(spark):
    got = values(spark, ["Gender: female", "Gender : MALE", "Gender: na", "Age: youth", "Gender: male\nGender: female", None], T.parse_gender)
    assert got[:3] == ["female", "male", "no visible"]
    assert got[5] is None or isinstance(got[5], str)


def test_scores(spark):
    got = values(spark, ["7.3", "8/10", "score: 3", "15", "N/A", ""], T.parse_score)
    assert [None if v is None else float(v) for v in got[:3]] == [7.3, 8.0, 3.0]
    assert got[3] is None and got[4] is None and got[5] is None


def test_reasoning_is_stripped(spark):
    assert values(spark, ["<think>a b</think>female", "plain"], T.strip_reasoning) == ["female", "plain"]


def test_normal_id(spark):
    assert values(spark, ["12345.0", "12345678901234567", "2025-01_user", None], T.normal_id) == ["12345", "12345678901234567", "2025-01_user", None]


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union else 0.0


def test_iou_cases(spark):
    boxes = [((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 10, 10), (20, 20, 30, 30)), ((0, 0, 10, 10), (10, 0, 20, 10)), ((0, 0, 0, 0), (0, 0, 0, 0)), ((0, 0, 10, 10), (5, 5, 15, 15))]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(boxes)], "i int, x1 long, y1 long, x2 long, y2 long, r_x1 long, r_y1 long, r_x2 long, r_y2 long")
    got = [r[0] for r in df.select("i", G.iou(G.box(), G.box("r_")).alias("v")).orderBy("i").select("v").collect()]
    assert np.allclose(got, [overlap(a, b) for a, b in boxes])


def test_greedy_boxes_match_a_loop(spark, tiny):
    d = virtual.detections(spark, tiny).withColumn("o", F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    got = sorted(tuple(r) for r in joins.greedy_unseen(d, ["media"], "o").select("media", "o", "x1", "y1", "x2", "y2").collect())
    want = []
    for key, rows in d.select("media", "o", "x1", "y1", "x2", "y2").toPandas().groupby("media"):
        kept = []
        for r in rows.sort_values(["o", "x1", "y1", "x2", "y2"]).itertuples(index=False):
            if all(overlap(k[2:], r[2:]) < G.IOU_SEEN for k in kept):
                kept.append(tuple(r))
        want += kept
    assert got == sorted(want)


def test_leaders_veto_and_chain():
    v = np.array([[1.0, 0.0], [0.95, 0.3122], [0.8, 0.6]])
    frames = [{1}, {2}, {3}]
    scores = np.array([3.0, 2.0, 1.0])
    assert dedup.leaders(v, frames, scores, 0.93).tolist() == [0, 0, 2]  # a~b, b~c, but a is not like c
    assert dedup.leaders(v, [{1}, {1}, {3}], scores, 0.93).tolist() == [0, 1, 1]  # a shared frame forbids a~b


def test_thinned_cuts(spark):
    df = spark.createDataFrame([([9, 10, 15, 40, 95],)], "c array<long>")
    assert df.select(select.thin_cuts(F.col("c"), F.lit(100))).first()[0] == [10, 40]


def test_upsert_keeps_existing(spark):
    master = spark.createDataFrame([("1", "a", 5.0), ("2", "a", 6.0), ("3", "a", None)], "img string, person string, score double")
    new = spark.createDataFrame([("1", "a", 9.0)], "img string, person string, score double")
    got = {r["img"]: r["score"] for r in results.upsert(master, new, ["img", "person"], ["score"]).collect()}
    assert got == {"1": 9.0, "2": 6.0, "3": None}


def test_media_names(spark):
    df = spark.createDataFrame([("/a/b/x.1.JPG",), ("y.mp4",), ("noext",)], "p string")
    got = [tuple(r) for r in df.select(media.stem(F.col("p")), media.extension(F.col("p")), media.media_kind(F.col("p"))).collect()]
    assert got[0] == ("x.1", "jpg", "image") and got[1] == ("y", "mp4", "video") and got[2][2] is None


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "master")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(src)
    stream = jobs.event_stream(spark, src, "k long, v string")
    jobs.ingest(stream, target, str(tmp_path / "ck"), ["k"]).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string").write.mode("append").parquet(src)
    jobs.ingest(stream, target, str(tmp_path / "ck"), ["k"]).awaitTermination()
    jobs.ingest(stream, target, str(tmp_path / "ck"), ["k"]).awaitTermination()
    assert sorted(map(tuple, ledger.read_master(spark, target).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_demands_are_parsed_once(spark):
    """A filter would hold the whole parser, once for each of its uses."""
    from prismara.functions import textparse
    from prismara.operators import select

    rows = spark.createDataFrame([(1, "Behaviour: demand/submission"), (2, "Behaviour: offer/ideal"), (3, "x")], "k long, raw string")
    found = select.demanding(textparse.person_attributes(rows, "raw", ["behaviour"], []), "behaviour", demand_only=True)
    assert [r["k"] for r in found.collect()] == [1] and found.columns == ["k", "raw", "behaviour"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_stems_are_shuffled_once_into_tasks_of_bounded_size(spark, monkeypatch):
    """A task's memory in the metadata chain does not follow from a fixed number of tasks."""
    from prismara.plans import catalog
    from prismara.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 20)
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    for name in ("metadata_chain", "matched_media"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-rows // 20)
