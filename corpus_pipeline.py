"""Corpus pipeline: language ID, near-duplicate removal, decontamination, source mixing, sharding.

Each stage is written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.llm.common import materialise, table
from prismara.llm.decontaminate import contaminated_words
from prismara.llm.jaccard_join import keep_one
from prismara.llm.language_id import with_language
from prismara.llm.mixing import mix_sources
from prismara.llm.queries import language_model
from prismara.llm.sharding import ring_shards


def whole(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator reads, and every row as it is in ``__doc``: no column is lost to one that an operator adds."""
    return docs.select(*needed, F.struct(*docs.columns).alias("__doc"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept.

    Null texts and texts without a letter are rejected; repeated rows fare alike. Rows with a null id
    are learned from like others. Without any learned language nothing is accepted.
    """
    found = with_language(whole(docs, "text"), "text", language_model(docs))
    return found.where("__language.accepted").select("__doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by Jaccard similarity 0.8 over five words.

    Texts without words are linked with nothing and stay, each row of them; null ids come last in a group.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Null and empty texts stay."""
    found = contaminated_words(whole(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select("__doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, a part of a round counting from half a document on.

    Texts without words are of no size, so none is taken; a null source is one of its own.
    """
    mixed = mix_sources(whole(docs, "doc_id", "text", "source"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    copies = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(times > 0)
    return copies.select("__doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, shard, slot) of the mix's rows; equal texts share a shard, and each row has its own slot."""
    return ring_shards(docs.select("doc_id", "text"), n_shards=40).select("doc_id", "size", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
    ("shard", shard),
]

#: Language models cannot be stated in SQL; the stages are tested one by one against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
