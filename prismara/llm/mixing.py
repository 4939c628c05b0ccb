"""Mixing sources to target weights with a low-discrepancy source schedule.

The mix is a row of slots, of equal token length within a source. Slot ``i`` gets the golden-ratio
point ``frac(i * phi)``, which the cumulative numbers of slots that the targets ask for map to a source;
so every prefix of the mix holds the sources near their weights. A slot is ranked within its source, and
rank ``r`` takes block ``r mod n_blocks`` of that source, whose documents are laid out in a shuffled order
and cut into blocks of the slot's length. Every source has ``LEAST_BLOCKS`` or more, or blocks of one word.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, numbered_copies, word_count

GOLDEN = 0.6180339887498949  # fixed value: the golden ratio's fractional part
CELLS = 4096
ROWS_PER_BUCKET = 4096
SLOTS_PER_CHUNK = 1024
LEAST_BLOCKS = 1024
MOST_BROADCAST = 1_000_000  # rows of the blocks' table that may be broadcast; more are joined by block, of which none is hot


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, documents, target): weights repeat over the sources by code point, null last.

    A target stops at ``most`` times its source's size and the excess is shared anew by weight: the
    level ``v`` with ``sum(min(most * size, v * weight)) = share * total`` is found by at most one
    small aggregate for each further set of stopped sources; only sums reach the driver.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    per = checkpointed(per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most))))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        stopped, open_weight = per.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        new = max(0.0, share * total - stopped) / open_weight
        if new <= level * (1 + 1e-12):
            break
        level = new
    return per.select("source", "source_size", "documents", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def unit_point(i: Column) -> Column:
    """``frac(i * phi)`` of a slot number."""
    return F.pmod(i * F.lit(GOLDEN), F.lit(1.0))


def cut_blocks(targets: DataFrame, block: int) -> DataFrame:
    """Adds ``length`` and ``blocks``, a source's blocks of ``block`` words or less, and ``slots``, how many its target asks for."""
    least = F.greatest(F.lit(1), F.floor(F.col("source_size") / F.lit(LEAST_BLOCKS)))
    out = targets.withColumn("length", F.least(F.lit(block), least).cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    return out.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))


def source_schedule(targets: DataFrame, slots: int, most: float = 2.0) -> DataFrame:
    """(slot, source, rank, block): the slots that take a block, each source's ranked from 0.

    ``targets`` has one row a source, with ``cut_blocks``. Ranks are counted per chunk of slots and source and shifted by
    the counts of earlier chunks, so no task holds all slots of a source. A source whose target is at
    its limit takes no slot beyond ``most`` rounds of its blocks.
    """
    spark = targets.sparkSession
    whole = targets.where("target > 0")
    bounds = whole.withColumn("__to", F.sum("slots").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)))
    bounds = bounds.withColumn("__all", F.max("__to").over(W.partitionBy()))
    bounds = bounds.select(
        "source",
        "blocks",
        ((F.col("__to") - F.col("slots")) / F.col("__all")).alias("__lo"),
        F.when(F.col("__to") == F.col("__all"), F.lit(2.0)).otherwise(F.col("__to") / F.col("__all")).alias("__hi"),
    )
    # the points' cells: a slot meets only the sources that reach into its 1/4096th of the line
    last = F.least(F.lit(CELLS - 1), F.floor(F.least(F.col("__hi"), F.lit(1.0)) * CELLS)).cast("int")
    bounds = bounds.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") * CELLS).cast("int"), last)))
    slot = spark.range(slots).withColumnRenamed("id", "slot").withColumn("__u", unit_point(F.col("slot") + 1))
    slot = slot.withColumn("__cell", F.floor(F.col("__u") * CELLS).cast("int"))
    hit = slot.join(bounds, "__cell").where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    hit = hit.withColumn("__chunk", F.floor(F.col("slot") / SLOTS_PER_CHUNK)).select("slot", "source", "blocks", "__chunk")
    per = hit.groupBy("source", "__chunk").agg(F.count(F.lit(1)).alias("__c"))
    before = per.withColumn("__skip", F.sum("__c").over(W.partitionBy("source").orderBy("__chunk")) - F.col("__c")).drop("__c")
    inside = F.row_number().over(W.partitionBy("__chunk", "source").orderBy("slot")) - 1
    before = before.withColumnsRenamed({"source": "__s", "__chunk": "__k"})
    ranked = hit.withColumn("__in", inside).join(before, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__chunk") == F.col("__k")))
    ranked = ranked.withColumn("rank", F.col("__skip") + F.col("__in")).where(F.col("rank") < F.floor(F.col("blocks") * F.lit(float(most))))
    return ranked.select("slot", "source", "rank", F.pmod(F.col("rank"), F.col("blocks")).alias("block"))


def lay_out(rows: DataFrame, targets: DataFrame, n_rows: int, seed: int, content: str = "size") -> DataFrame:
    """Adds ``__from``, the words before the document in its source's shuffled order, and the source's ``__length``, ``__size`` and ``__target``.

    Running sums inside buckets of a few thousand rows, plus the sums of earlier buckets: a source
    that holds a third of all rows is spread like the rest, and is joined by bucket, never as a whole. The order is by a hash of
    id, source and ``content`` and of the row's number among its copies, so it is the same whatever the partitions, and rows of one id are spread as well.
    """
    buckets = max(1, math.ceil(n_rows / ROWS_PER_BUCKET))
    rows = numbered_copies(rows.withColumn("__same", F.xxhash64(F.col("__id").cast("string"), F.col("__source").cast("string"), content)), "__same", "__copy")
    rows = rows.withColumn("__draw", F.xxhash64("__same", "__copy", F.lit(seed)))
    rows = rows.withColumn("__bucket", F.pmod("__draw", F.lit(buckets)))
    per = rows.groupBy("__source", "__bucket").agg(F.sum("size").alias("__words"))
    base = per.withColumn("__base", F.sum("__words").over(W.partitionBy("__source").orderBy("__bucket")) - F.col("__words"))
    about = targets.select(F.col("source").alias("__t"), F.col("length").alias("__length"), F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    base = base.join(about, F.col("__source").eqNullSafe(F.col("__t")))
    base = base.select(F.col("__source").alias("__bs"), F.col("__bucket").alias("__bb"), "__base", "__length", "__size", "__target")
    inside = W.partitionBy("__source", "__bucket").orderBy("__draw", "__same", "__copy").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(base, F.col("__source").eqNullSafe(F.col("__bs")) & (F.col("__bucket") == F.col("__bb")))
    return rows.withColumn("__from", F.col("__base") + F.col("__in")).drop("__bs", "__bb", "__base", "__in", "__bucket", "__draw", "__same", "__copy")


def _prepared(docs: DataFrame, weights: Sequence[float], share: float, most: float, slots: int, seed: int, columns: tuple[str, str, str], size: Column | None):
    id_col, text_col, source_col = columns
    rows = docs.withColumn("size", word_count(F.col(text_col)) if size is None else size).withColumn("__source", F.col(source_col)).withColumn("__id", F.col(id_col))
    thin = rows.select(F.col("__source").alias("source"), "size")
    targets = source_targets(thin, weights, share, most)
    n, total = targets.agg(F.sum("documents"), F.sum("source_size")).first()
    block = max(1, math.ceil(share * (total or 0) / slots))
    targets = checkpointed(cut_blocks(targets, block))
    asked = targets.agg(F.sum("slots")).first()[0] or 0
    return lay_out(rows, targets, n or 0, seed, text_col), targets, source_schedule(targets, max(1, math.ceil(asked)), most)


def mixed_pieces(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slots: int = 1 << 17, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (slot, doc id, begin, words), the word range of the document in that slot, in slot order of a stream.

    Each document meets the schedule at the blocks it reaches into; a source's blocks have equal lengths, so no key is hot.
    """
    rows, _, schedule = _prepared(docs, weights, share, most, slots, seed, (id_col, text_col, source_col), None)
    rows = rows.where("size > 0")
    reach = F.sequence(F.floor(F.col("__from") / F.col("__length")), F.floor((F.col("__from") + F.col("size") - 1) / F.col("__length")))
    pieces = rows.select("__id", "__source", "__from", "size", "__length", F.explode(reach).alias("__block"))
    hit = pieces.join(schedule, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__block") == F.col("block")))
    begin = F.greatest(F.lit(0), F.col("__block") * F.col("__length") - F.col("__from"))
    end = F.least(F.col("size"), (F.col("__block") + 1) * F.col("__length") - F.col("__from"))
    return hit.select("slot", F.col("__id").alias(id_col), begin.alias("begin"), (end - begin).alias("words"))


def taken_blocks(targets: DataFrame, schedule: DataFrame) -> DataFrame:
    """(source, block, times, before): how many slots take each block, and the words that those of earlier blocks take."""
    each = targets.select("source", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("blocks"), F.lit(1)).cast("long") - 1)).alias("block"))
    slots_of = schedule.groupBy(F.col("source").alias("__s"), F.col("block").alias("__b")).agg(F.count(F.lit(1)).alias("times"))
    each = each.join(slots_of, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # running sums inside chunks of blocks, plus those of earlier chunks: a source's blocks are never in one task
    each = each.withColumn("words", F.col("times") * F.col("length")).withColumn("chunk", F.floor(F.col("block") / SLOTS_PER_CHUNK))
    per = each.groupBy("source", "chunk").agg(F.sum("words").alias("__w"))
    base = per.select(F.col("source").alias("__cs"), F.col("chunk").alias("__ck"), (F.sum("__w").over(W.partitionBy("source").orderBy("chunk")) - F.col("__w")).alias("__base"))
    inside = F.sum("words").over(W.partitionBy("source", "chunk").orderBy("block")) - F.col("words")
    out = each.withColumn("__in", inside).join(base, F.col("source").eqNullSafe(F.col("__cs")) & (F.col("chunk") == F.col("__ck")))
    return out.select("source", "block", "times", (F.col("__base") + F.col("__in")).alias("before"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slots: int = 1 << 17, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words the mix takes of each.

    A null source is a source of its own, the last. Null, empty and blank texts have size 0 and are
    taken with 0 words. The blocks are at most ``ceil(share * words / slots)`` words long and at most
    a ``LEAST_BLOCKS``-th of their source (but a word at least): taken words of a source are within a
    few of its blocks of its target, at every size of input and of source. Nothing is taken more than ``most`` times. Repeated rows are separate documents. An empty
    table gives an empty table. Columns of the input called like an added one are replaced. ``size``
    gives the number of words where the caller has it already.

    Each document meets its source's blocks where it begins and where it ends: what the slots take up to a
    place is what they take of the blocks before it and of that part of its block, and the difference is
    the sum of the document's pieces in ``mixed_pieces``, which nothing has to gather again.
    """
    added = ("size", "source_size", "target", "taken")
    kept = docs.columns
    docs = docs.select(*[c for c in kept if c not in added], *([size.alias("__words")] if size is not None else []))
    rows, targets, schedule = _prepared(docs, weights, share, most, slots, seed, (id_col, text_col, source_col), None if size is None else F.col("__words"))
    taken = taken_blocks(targets, schedule)
    if taken.count() <= MOST_BROADCAST:
        taken = F.broadcast(taken)
    for place, at in (("lo", F.col("__from")), ("hi", F.col("__from") + F.col("size"))):
        # a document that ends with its source ends in its last block
        block = F.least(F.floor(at / F.col("__length")), F.greatest(F.ceil(F.col("__size") / F.col("__length")), F.lit(1)) - 1)
        block = F.coalesce(block, F.lit(0).cast("long"))
        there = taken.select(F.col("source").alias("__ts"), F.col("block").alias("__tb"), F.col("times").alias(f"__times_{place}"), F.col("before").alias(f"__before_{place}"))
        rows = rows.withColumn("__b", block).join(there, F.col("__source").eqNullSafe(F.col("__ts")) & (F.col("__b") == F.col("__tb"))).drop("__ts", "__tb")
        rows = rows.withColumn(f"__{place}", F.col(f"__before_{place}") + F.col(f"__times_{place}") * (at - F.col("__b") * F.col("__length")))
    out = rows.withColumn("taken", (F.col("__hi") - F.col("__lo")).cast("long"))
    out = out.withColumn("source_size", F.col("__size")).withColumn("target", F.col("__target"))
    return out.select(*[c for c in kept if c not in added], *added)
