"""Reading the tables of a data set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = (1 << 20, 1 << 26)
TASK_ROWS = 1 << 19
METHOD_LIMIT, JVM_METHOD, SPARK_METHOD = "spark.sql.codegen.hugeMethodLimit", "8000", "65535"


def small_methods(spark: SparkSession) -> None:
    """Code of long expressions in small methods, where the session has Spark's default.

    HotSpot compiles no method of more than 8,000 bytes. Spark makes the branches of a stage's projection one method and takes those of
    up to 65,535 bytes, which then are interpreted row by row; beyond the limit it makes many small methods instead.
    """
    if spark.conf.get(METHOD_LIMIT, SPARK_METHOD) == SPARK_METHOD:
        spark.conf.set(METHOD_LIMIT, JVM_METHOD)


def whole_methods(spark: SparkSession) -> None:
    """Takes ``small_methods`` back, for plans that are faster without it."""
    if spark.conf.get(METHOD_LIMIT, SPARK_METHOD) == JVM_METHOD:
        spark.conf.unset(METHOD_LIMIT)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. One of a few megabytes may be a single row group, which one task would read and
    work through alone; it is dealt over the cores. Larger tables are read as they are split, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if SMALL_BYTES[0] < size < SMALL_BYTES[1] else df


def parts_of(table: DataFrame) -> int:
    """Into how many tasks to shuffle a table's rows: one for each TASK_ROWS of them, which its files' footers tell, and no fewer than the
    session says, whose fixed number would let every task grow with the input."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset (local runs)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a table in the shared folder: what is read from it stays the same, whatever is lost or computed again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
