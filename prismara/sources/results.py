"""Result files and masters: reading, upserts that never overwrite, replacement, resumption."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("img_id", T.StringType()),
        T.StructField("input_path", T.StringType()),
        T.StructField("persons_detected", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("result", T.StructType([T.StructField("persons_detected", T.LongType()), T.StructField("vlm_status", T.StringType()), T.StructField("timestamp", T.StringType())])),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row a readable result file, wrapped or flat."""
    raw = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "summary_*.json").json(path)
    good = raw.where(F.col("_corrupt_record").isNull())
    return good.select("run_id", "img_id", "input_path", F.coalesce("result.persons_detected", "persons_detected").alias("persons_detected"), F.col("result.vlm_status").alias("vlm_status"), F.coalesce("result.timestamp", "timestamp").alias("timestamp"))


def latest_run(results: DataFrame, file: str = "img_id") -> DataFrame:
    """Row of the newest run of each file."""
    w = W.partitionBy(file).orderBy(F.col("run_id").desc())
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(master: DataFrame, new: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """New values where there are any, else the present ones; rows of the master only."""
    # of a key's several new rows the greatest by its values holds, so that no master row is multiplied or mixes two of them
    fresh = new.groupBy(*on).agg(F.max(F.struct(*columns)).alias("__n")).select(*on, *[F.col("__n")[c].alias(f"__{c}") for c in columns])
    joined = master.join(fresh, list(on), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in master.columns])


def backfill(master: DataFrame, new: DataFrame, on: str, column: str, target) -> DataFrame:
    """Fills a column of the ``target`` rows only."""
    fresh = new.groupBy(F.col(on).alias("__k")).agg(F.max(column).alias("__v"))
    joined = master.join(fresh, F.col(on) == F.col("__k"), "left")
    return joined.select(*[F.when(target & F.col("__v").isNotNull(), F.col("__v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in master.columns])


def append_replace(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Old rows of keys that the new ones do not have, and the new ones."""
    return old.join(new.select(*on).distinct(), list(on), "left_anti").unionByName(new, allowMissingColumns=True)


def in_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in this order, missing ones as null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def stale_packages(references: DataFrame, listing: DataFrame, package: str, file: str) -> DataFrame:
    """(package, stale): whether any file that a package refers to is missing."""
    have = listing.select(F.col(file)).distinct().withColumn("__have", F.lit(1))
    return references.join(have, file, "left").groupBy(package).agg(F.bool_or(F.col("__have").isNull()).alias("stale"))


def swap_in(df: DataFrame, path: str) -> None:
    """Writes beside the target and renames. The old table is deleted only when the new one is in place."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(new)
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(conf)
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(old), True)
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(new), hadoop(path))
    fs.delete(hadoop(old), True)


def write_results(results: DataFrame, folder: str, degraded: str = "degraded") -> None:
    """Appends results as JSON by run. A row is its file's completion mark, so degraded ones are left out and done again later."""
    good = results.where(~F.coalesce(F.col(degraded), F.lit(False))).drop(degraded) if degraded in results.columns else results
    good.write.mode("append").partitionBy("run_id").json(folder)


def write_sheet(df: DataFrame, path: str, columns: Sequence[str], fallback: str | None = None) -> str:
    """Writes the columns in their order as CSV; where the store refuses, to the fallback path. Returns where it went.

    The rows are made before the target is touched, so an error in them is raised and not taken for a blocked file.
    """
    rows = in_columns(df, columns)
    if fallback is None:
        rows.write.mode("overwrite").option("header", True).csv(path)
        return path
    made = written(rows, "sheet")
    try:
        made.write.mode("overwrite").option("header", True).csv(path)
    except (Py4JJavaError, PySparkException):
        made.write.mode("overwrite").option("header", True).csv(fallback)
        return fallback
    return path


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder a sheet."""
    for name, df in sheets.items():
        write_sheet(df, f"{folder.rstrip('/')}/{name}", df.columns)


def console_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a text table."""
    return df._jdf.showString(rows, 40, False)
