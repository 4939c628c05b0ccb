"""Structured Streaming: resumable result ingestion, live best candidates, sessions over event time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ledger import merge_batch


def ingest(stream: DataFrame, target: str, checkpoint: str, key: Sequence[str], buckets: int = 64, output: str = "append"):
    """Micro-batches replace the keys they hold in a bucketed master; restarting goes on after the last batch.

    The ledger lies beside the stream's checkpoint, as batch numbers are the checkpoint's. ``ledger.read_master`` reads the table.
    """
    book = f"{checkpoint.rstrip('/')}-ledger"
    write = lambda batch, number: merge_batch(batch, number, target, book, key, buckets)
    return stream.writeStream.foreachBatch(write).outputMode(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Event-time sessions with a watermark."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windows(events: DataFrame, at: str, length: str, late: str, kind: str) -> DataFrame:
    """Counts a tumbling window and kind."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def best_so_far(frames: DataFrame, keys: Sequence[str], score: Column, order: str) -> DataFrame:
    """Best score and its first row of each key, as a running (update mode) aggregate."""
    return frames.groupBy(*keys).agg(F.max(score).alias("score"), F.max_by(order, F.struct(score, -F.col(order))).alias("at"))


SLOTS = ("general", "body", "face")
SLOT_SCHEMA = ", ".join(["track string", *[f"{s} double, {s}_frame long" for s in SLOTS], "closed boolean"])


class CandidateSlots(StatefulProcessor):
    """Three slots of a track, each the best score so far and the first frame that has it. A track without frames for ``idle`` seconds is
    closed: its slots are given out once more and its state is dropped."""

    def __init__(self, idle: float | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = {s: handle.getValueState(s, "score double, frame long") for s in SLOTS}

    def _row(self, key: tuple[Any, ...], closed: bool) -> pd.DataFrame:
        row: dict[str, list] = {"track": [key[0]]}
        for name, state in self.slots.items():
            held = state.get() if state.exists() else (None, None)
            row |= {name: pd.Series([held[0]], dtype="float64"), f"{name}_frame": pd.Series([held[1]], dtype="Int64")}
        return pd.DataFrame(row | {"closed": [closed]})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        best = {s: state.get() if state.exists() else None for s, state in self.slots.items()}
        for pdf in rows:
            for name in SLOTS:
                known = pdf[pdf[name].notna()]
                if known.empty:
                    continue
                top = known[known[name] == known[name].max()]
                score, frame = float(top[name].iloc[0]), int(top["frame"].min())
                held = best[name]
                if held is None or score > held[0] or (score == held[0] and frame < held[1]):
                    best[name] = (score, frame)
        for name, value in best.items():
            if value is not None:
                self.slots[name].update((value[0], value[1]))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        row = self._row(key, True)
        for state in self.slots.values():
            state.clear()
        yield row

    def close(self) -> None:
        pass


def candidate_slots(frames: DataFrame, idle: float | None = None) -> DataFrame:
    """Live slots of each track (general, body, face), each a score and its first frame; frames: track, frame, and the slots' scores, null where a frame is no candidate.

    A batch's rows are reduced to their maxima before the state is touched, so a track's state is written once a batch. The state store must be
    RocksDB's (``rocks_state``) when the stream is started.
    """
    mode = "None" if idle is None else "ProcessingTime"
    return frames.groupBy("track").transformWithStateInPandas(CandidateSlots(idle), SLOT_SCHEMA, "update", mode)


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
