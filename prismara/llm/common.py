"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import read_table, shared_dir, whole_methods

#: Fixed value: the white space that separates words in the contracts (space, \t \n \v \f \r).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table for the operators, whose loops over words are faster as whole stages."""
    whole_methods(spark)
    return read_table(spark, sf_dir, name)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/prismara-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of texts of at most ``rows`` rows, where the session has Spark's default of 10,000 or more: texts are
    long, and both the JVM and the Python worker of every task hold a batch."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) >= 10_000:
        spark.conf.set(setting, str(rows))


def give_back(batches: Iterator) -> Iterator:
    """A task's ``batches``. At its end the freed memory goes back to the system: a Python worker serves later tasks as well, and what its
    allocators keep of the largest one would count beside the memory of all that follow."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
    if trim is not None:
        trim(0)


def discard(df: DataFrame) -> None:
    """Deletes the table of a ``materialise``d frame that nothing reads any more; other frames are left alone."""
    path = getattr(df, "written_to", None)
    if path is not None:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", share: int = 2000, parts: int = 32) -> DataFrame:
    """``big`` (written before) with ``small``, which has one row a key at most. Hot keys are dealt over ``parts`` tasks by the column ``by``.

    A key is hot with more than a ``share``-th of the rows, so fewer than ``share`` keys are, and are broadcast.
    """
    spark = big.sparkSession
    rows = big.count()
    hot = big.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows / share).select(*on).collect()  # fewer than ``share``
    if not hot:
        return big.join(small, on, how)
    known = F.broadcast(spark.createDataFrame([(*r, True) for r in hot], T.StructType([*(big.schema[c] for c in on), T.StructField("__hot", T.BooleanType())])))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(F.lit(0).cast("long"))
    every = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = big.join(known, on, "left").withColumn("__part", part).drop("__hot")
    right = small.join(known, on, "left").withColumn("__part", F.explode(every)).drop("__hot")
    return left.join(right, [*on, "__part"], how).drop("__part")


def numbered_copies(rows: DataFrame, same: str, name: str, most: int = 1 << 20) -> DataFrame:
    """``rows`` with ``name``: 0 for each row whose hash ``same`` stands once, else the numbers from 0 on, one for each copy.

    Copies are numbered where they lie, a few thousand here and there, after what earlier tasks hold of them; no task gathers a row's copies.
    Which copy gets which number is open, as they are alike. ``most`` repeated hashes are broadcast; with more, rows are joined to them.
    """
    twice = materialise(rows.groupBy(same).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(same))
    n = twice.count()
    if not n:
        return rows.withColumn(name, F.lit(0).cast("long"))
    if n <= most:
        marked = rows.join(F.broadcast(twice.withColumn("__twice", F.lit(True))), same, "left")
    else:
        marked = rows.join(twice.withColumn("__twice", F.lit(True)), same, "left")
    single = marked.where("__twice IS NULL").drop("__twice").withColumn(name, F.lit(0).cast("long"))
    repeated = materialise(marked.where("__twice").drop("__twice").withColumn("__task", F.spark_partition_id()))
    here = repeated.groupBy(same, "__task").agg(F.count(F.lit(1)).alias("__n"))
    here = here.withColumn("__before", F.sum("__n").over(W.partitionBy(same).orderBy("__task")) - F.col("__n")).drop("__n")
    place = F.row_number().over(W.partitionBy(same, "__task").orderBy(F.lit(0))) - 1
    repeated = repeated.withColumn("__place", place).join(here, [same, "__task"]).withColumn(name, F.col("__place") + F.col("__before")).drop("__task", "__place", "__before")
    return single.unionByName(repeated)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Hash of all columns that can be hashed: rows without a difference share it."""
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if (columns is None or c in columns) and "map<" not in kind and kind != "variant"])


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
