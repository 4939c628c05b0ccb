"""Masters that a stream's batches are merged into exactly once.

A master is a Parquet table parted by buckets of its key. A batch rewrites only the buckets of its keys, in three steps: the buckets' new
content is staged, the master's buckets are overwritten from the stage, and the batch's number is put into the ledger. A batch that ends
between two steps is run again by the stream under the same number: what is staged whole is not made again, overwriting from it again changes nothing, and
a number in the ledger is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import append_replace

BUCKET = "__bucket"


class Ledger:
    """Numbers of finished batches, one empty file each, made in one step by the file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def done(self, batch: int) -> bool:
        return self.exists(f"batch-{batch:012d}")

    def record(self, batch: int) -> None:
        path, fs = self._path(f"batch-{batch:012d}")
        fs.create(path, False).close()


def _there(spark: SparkSession, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_master(spark: SparkSession, target: str) -> DataFrame:
    """The master's rows without their buckets."""
    return spark.read.parquet(target).drop(BUCKET)


def merge_batch(batch: DataFrame, number: int, target: str, ledger: str, key: Sequence[str], buckets: int = 64, after: Callable[[str], None] = lambda step: None) -> None:
    """Puts a batch's rows in the place of the master's rows of the same keys; of a key's several rows the greatest by its values holds.

    ``after`` is called with the name of each step when it is done. The number of ``buckets`` must stay what it was when the master was made.
    """
    spark, book, stage = batch.sparkSession, Ledger(batch.sparkSession, ledger), f"stage-{number:012d}"
    if book.done(number):
        return
    if not book.exists(f"{stage}/_SUCCESS"):
        book.delete(stage)
        rest = [c for c in batch.columns if c not in key]
        rows = batch.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__r")).select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in batch.columns])
        rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets``
        if touched:
            if _there(spark, target):
                rows = append_replace(spark.read.parquet(target).where(F.col(BUCKET).isin(touched)), rows, [*key, BUCKET])
            rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{book.folder}/{stage}")
    after("staged")
    if book.exists(f"{stage}/_SUCCESS"):
        staged = spark.read.parquet(f"{book.folder}/{stage}")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(target)
    after("published")
    book.record(number)
    after("recorded")
    book.delete(stage)
