"""Exactly-once masters and candidate slots as state."""

import random
import time

import pytest
from pyspark.sql import functions as F

from prismara.streaming import jobs, ledger

FRAMES = "track string, frame long, general double, body double, face double"


class Killed(Exception):
    pass


def kill(step):
    def after(done):
        if done == step:
            raise Killed(step)

    return after


def content(spark, target):
    return sorted(map(tuple, ledger.read_master(spark, target).collect()))


@pytest.mark.parametrize("step", ["staged", "published", "recorded"])
def test_a_batch_killed_between_steps_is_merged_once(spark, tmp_path, step):
    draw = random.Random(1)
    batches = [spark.createDataFrame([(draw.randint(0, 40), f"{n}-{k}") for k in range(30)], "k long, v string") for n in range(3)]
    whole, hurt = str(tmp_path / "whole"), str(tmp_path / "hurt")
    for n, batch in enumerate(batches):
        ledger.merge_batch(batch, n, whole, str(tmp_path / "w"), ["k"], 8)
        with pytest.raises(Killed):
            ledger.merge_batch(batch, n, hurt, str(tmp_path / "h"), ["k"], 8, kill(step))
        ledger.merge_batch(batch, n, hurt, str(tmp_path / "h"), ["k"], 8)
        assert content(spark, hurt) == content(spark, whole)
        ledger.merge_batch(batches[0], n, hurt, str(tmp_path / "h"), ["k"], 8)  # its number is in the ledger
        assert content(spark, hurt) == content(spark, whole)


def test_half_published_buckets_are_published_again(spark, tmp_path):
    target, book = tmp_path / "t", str(tmp_path / "b")
    first = spark.createDataFrame([(k, "old") for k in range(50)], "k long, v string")
    second = spark.createDataFrame([(k, "new") for k in range(0, 50, 2)], "k long, v string")
    ledger.merge_batch(first, 0, str(target), book, ["k"], 4)
    with pytest.raises(Killed):
        ledger.merge_batch(second, 1, str(target), book, ["k"], 4, kill("published"))
    lost = sorted(p for p in target.iterdir() if p.name.startswith("__bucket"))[0]
    for f in lost.iterdir():
        f.unlink()
    ledger.merge_batch(second, 1, str(target), book, ["k"], 4)
    assert content(spark, str(target)) == [(k, "old" if k % 2 else "new") for k in range(50)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    target, book = tmp_path / "t", str(tmp_path / "b")
    ledger.merge_batch(spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("v")), 0, str(target), book, ["k"], 16)
    before = {f: f.stat().st_mtime_ns for f in target.rglob("*.parquet")}
    ledger.merge_batch(spark.createDataFrame([(5, 1)], "k long, v int"), 1, str(target), book, ["k"], 16)
    after = {f: f.stat().st_mtime_ns for f in target.rglob("*.parquet")}
    kept = [f for f in before if after.get(f) == before[f]]
    assert len({f.parent for f in before} - {f.parent for f in kept}) == 1
    assert ledger.read_master(spark, str(target)).agg(F.count("*"), F.sum("v")).first()[:] == (1000, 1)
    ledger.merge_batch(spark.createDataFrame([], "k long, v int"), 2, str(target), book, ["k"], 16)
    assert ledger.read_master(spark, str(target)).count() == 1000


def test_a_stream_that_fails_goes_on_with_the_same_batch(spark, tmp_path):
    source, target, check = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(source)
    stream = jobs.event_stream(spark, source, "k long, v string")
    failing = lambda batch, n: ledger.merge_batch(batch, n, target, f"{check}-ledger", ["k"], 64, kill("published"))
    with pytest.raises(Exception, match="published"):
        stream.writeStream.foreachBatch(failing).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    jobs.ingest(stream, target, check, ["k"]).awaitTermination()
    assert content(spark, target) == [(1, "a"), (2, "b")]


def run_slots(spark, frames, tmp_path, name, idle=None, trigger=None):
    with jobs.rocks_state(spark):
        query = jobs.candidate_slots(frames, idle).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-ck"))
        return query.trigger(**(trigger or {"availableNow": True})).start()


def test_slots_match_a_batch(spark, tmp_path):
    draw = random.Random(6)
    score = lambda: draw.choice([None, 1.0, 2.0, 2.0, draw.uniform(0, 2)])
    rows = [(draw.choice("abc"), k, score(), score(), score()) for k in range(300)] + [("none", 1, None, None, None)]
    draw.shuffle(rows)
    source = str(tmp_path / "frames")
    for part in range(3):
        spark.createDataFrame(rows[part::3], FRAMES).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(source)
    run_slots(spark, stream, tmp_path, "slots").awaitTermination()
    seen = spark.table("slots").collect()
    assert len(seen) > 4  # a row a batch
    for track in ("a", "b", "c", "none"):
        mine = [r for r in seen if r["track"] == track]
        for slot in jobs.SLOTS:
            place = jobs.SLOTS.index(slot) + 2
            known = [(-r[place], r[1]) for r in rows if r[0] == track and r[place] is not None]
            want = (-min(known)[0], min(known)[1]) if known else (None, None)
            assert want in [(r[slot], r[f"{slot}_frame"]) for r in mine]
            assert max((r[slot] for r in mine if r[slot] is not None), default=None) == want[0]


def test_idle_tracks_are_closed(spark, tmp_path):
    source = tmp_path / "frames"
    spark.createDataFrame([("a", 1, 5.0, None, 2.0)], FRAMES).write.parquet(str(source))
    query = run_slots(spark, jobs.event_stream(spark, str(source), FRAMES), tmp_path, "closing", 1.0, {"processingTime": "1 second"})
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("closing").where("closed").count():
            time.sleep(0.5)
        closed = spark.table("closing").where("closed").collect()
        assert [tuple(r) for r in closed] == [("a", 5.0, 1, None, None, 2.0, 1, True)]
    finally:
        query.stop()
