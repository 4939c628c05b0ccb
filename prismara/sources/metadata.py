"""The prioritised metadata chain: posts, album members and their resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textparse as T
from ..operators.joins import first_by


def read_source(spark: SparkSession, path: str) -> DataFrame | None:
    """All-string CSV with empty cells as ''; null for a source that cannot be read."""
    from pyspark.errors import PySparkException

    try:
        return spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("")
    except PySparkException:
        return None


def chain(sources: Sequence[DataFrame], order_col: str | None = None) -> DataFrame:
    """Union by name over all columns, with ``priority`` (the source) and ``row_order``."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("row_order", F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()).withColumn("priority", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def posts(rows: DataFrame) -> DataFrame:
    """First row of every non-empty id, by source and row."""
    return first_by(rows.where(F.coalesce(F.col("id"), F.lit("")) != ""), ["id"], [F.col("priority"), F.col("row_order")])


def members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member -> owning post, member -> url): the owner by first listing, the url by first non-empty one."""
    each = rows.select("id", "priority", "row_order", F.posexplode(T.parse_multimedia(F.col("multimedia"))).alias("pos", "m"))
    each = each.select("id", "priority", "row_order", "pos", F.col("m.id").alias("member"), F.col("m.url").alias("url")).where("member IS NOT NULL AND member <> ''")
    order = [F.col("priority"), F.col("row_order"), F.col("pos")]
    owner = first_by(each.select("member", F.col("id").alias("owner"), "priority", "row_order", "pos"), ["member"], order).select("member", "owner")
    url = first_by(each.where("url IS NOT NULL AND url <> ''"), ["member"], order).select(F.col("member").alias("url_member"), "url")
    return owner, url


def resolve(stems: DataFrame, rows: DataFrame) -> DataFrame:
    """(stem, post_id, url, match_source): a post itself, an album's member with or without its post's row, or none."""
    post = posts(rows).select(F.col("id").alias("p"), F.col("source_tag").alias("tag"))
    owner, url = members(rows)
    own_post = post.select(F.col("p").alias("op"), F.col("tag").alias("own_tag"))
    # owners get their posts before the stems, which are many, come in: all of the stems' joins are by one key
    owner = owner.join(own_post, F.col("owner") == F.col("op"), "left")
    out = stems.join(post, F.col("stem") == F.col("p"), "left").join(owner, F.col("stem") == F.col("member"), "left")
    out = out.join(url, F.col("stem") == F.col("url_member"), "left")
    source = F.when(F.col("p").isNotNull(), F.col("tag")).when(F.col("op").isNotNull(), F.concat("own_tag", F.lit("-album"))).when(F.col("owner").isNotNull(), "album-nometa").otherwise("none")
    return out.select("stem", F.coalesce("p", "owner").alias("post_id"), "url", source.alias("match_source"))


def matched(resolved: DataFrame) -> DataFrame:
    """Rows of ``resolve`` that some source has a match for."""
    return resolved.where(F.col("match_source") != "none")


def attach(df: DataFrame, meta: DataFrame, key: str, prefix: str = "Meta ") -> DataFrame:
    """Left join with prefixed columns."""
    renamed = meta.select(F.col(key).alias("__k"), *[F.col(f"`{c}`").alias(prefix + c) for c in meta.columns if c != key])
    return df.join(renamed, F.col(key) == F.col("__k"), "left").drop("__k")
