"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (10 consecutive words; an item of fewer words is one window) are sets of word
shingles, and a document contains a window only if it contains all of them. So the necessary prefix
is one token: the window's rarest shingle, by counts over all documents. Documents are matched
against the windows of that token only; the token's place in the window bounds where the window can
stand (position) and whether it fits into the document (length), and candidates are verified on the
words themselves.

The benchmark is a stated query set. It is dealt with in blocks of ``block_windows`` windows, each of
which is broadcast, so what is broadcast is bounded however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytekernel import ALNUM, Words, slices, string_bytes
from .common import give_back, modest_batches

SHINGLE = 3


@dataclass
class Windows:
    """Distinct windows of a block of items, with their shingles; ``use_prefix`` adds the index of their rarest ones."""

    text: list[bytes]
    length: np.ndarray
    items: list[list[str]]
    shingle: np.ndarray  # uint64, of all windows in a row
    owner: np.ndarray  # the window of each
    place: np.ndarray  # its place there
    width: np.ndarray  # its words
    key: np.ndarray | None = None  # sorted prefix tokens
    window: np.ndarray | None = None  # the window of each
    offset: np.ndarray | None = None
    span: np.ndarray | None = None  # the token's words
    start: np.ndarray | None = None  # by the keys' top bits

    TOP = 16

    def use_prefix(self, counts: dict[int, int]) -> Windows:
        n = np.fromiter((counts.get(int(h), 0) for h in self.shingle.view(np.int64)), np.int64, len(self.shingle))
        order = np.lexsort((self.place, self.shingle, n, self.owner))
        first = order[np.concatenate(([True], self.owner[order][1:] != self.owner[order][:-1]))] if len(order) else order
        first = first[np.argsort(self.shingle[first], kind="stable")]
        self.key, self.window, self.offset, self.span = self.shingle[first], self.owner[first], self.place[first], self.width[first]
        tops = (self.key >> np.uint64(64 - self.TOP)).astype(np.int64)
        self.start = np.searchsorted(tops, np.arange((1 << self.TOP) + 1))
        return self

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, row of the index) of the hashes that are a window's prefix token."""
        top = (hashes >> np.uint64(64 - self.TOP)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        places, rows = [], []
        while len(left):
            hit = self.key[at[left]] == hashes[left]
            places.append(left[hit])
            rows.append(at[left[hit]])
            at[left] += 1
            left = left[at[left] < end[left]]
        return (np.concatenate(places), np.concatenate(rows)) if places else (left, left)


def windows_of(items: list[tuple[str, str | None]], length: int) -> Windows:
    """The distinct windows of (item id, text) rows."""
    data, offs = string_bytes(pa.array([t for _, t in items], pa.string()))
    words = Words(data, offs, ALNUM)
    known: dict[bytes, int] = {}
    owners: list[dict[str, None]] = []
    sizes: list[int] = []
    shingle, owner, place, width = [], [], [], []
    by_width = {k: words.shingles(k) for k in range(1, SHINGLE + 1)}
    for i, (item, _) in enumerate(items):
        a, b = words.offs[i], words.offs[i + 1]
        n = min(length, b - a)
        for s in range(a, b - n + 1) if n else ():
            text = words.text(s, s + n)
            if text not in known:
                known[text] = len(known)
                owners.append({})
                sizes.append(n)
                w = min(SHINGLE, n)
                for j in range(n - w + 1):
                    shingle.append(by_width[w][s + j])
                    owner.append(known[text])
                    place.append(j)
                    width.append(w)
            owners[known[text]][item] = None
    as_int = lambda x: np.array(x, dtype=np.int64)
    return Windows(list(known), as_int(sizes), [list(o) for o in owners], np.array(shingle, dtype=np.uint64), as_int(owner), as_int(place), as_int(width))


def _occurrences(words: Words, ask: Windows, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every verified place of a window."""
    found = []
    for w in widths:
        place, row = ask.candidates(words.shingles(w))
        same = ask.span[row] == w
        place, row = place[same], row[same]
        window = ask.window[row]
        begin = place - ask.offset[row]
        of = np.searchsorted(words.offs, place, "right") - 1
        fits = (begin >= words.offs[of]) & (begin + ask.length[window] <= words.offs[of + 1])
        found += [(b, v) for b, v in zip(begin[fits].tolist(), window[fits].tolist(), strict=True) if words.text(b, b + int(ask.length[v])) == ask.text[v]]
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _count_shingles(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the windows' shingles in a partition."""
    seen = np.zeros(len(hashes), dtype=np.int64)
    for batch in batches:
        for _, data, offs in slices(batch, "text"):
            words = Words(data, offs, ALNUM)
            for w in widths:
                h = words.shingles(w)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                seen += np.bincount(at[hashes[at] == h], minlength=len(hashes))
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(seen[at])], ["h", "n"])


def _match(batches: Iterator[pa.RecordBatch], ask: Windows, sparse: bool) -> Iterator[pa.RecordBatch]:
    """Adds n_words, the sorted hit words and the items; ``sparse`` leaves out rows without a hit."""
    widths = sorted(set(ask.width.tolist()))
    for batch in batches:
        for part, data, offs in slices(batch, "__text"):
            words = Words(data, offs, ALNUM)
            n = np.diff(words.offs)
            hits: list[list[int] | None] = [None] * len(n)
            items: list[list[str] | None] = [None] * len(n)
            begin, window = _occurrences(words, ask, widths)
            of = np.searchsorted(words.offs, begin, "right") - 1
            for d in np.unique(of):
                mine = of == d
                flags = np.zeros(n[d] + 1, dtype=np.int64)
                np.add.at(flags, begin[mine] - words.offs[d], 1)
                np.add.at(flags, begin[mine] - words.offs[d] + ask.length[window[mine]], -1)
                hits[d] = np.flatnonzero(np.cumsum(flags)[:-1] > 0).tolist()
                items[d] = sorted({i for v in set(window[mine].tolist()) for i in ask.items[v]})
            rest = [part.column(c) for c in range(part.num_columns) if part.schema.names[c] != "__text"]
            names = [c for c in part.schema.names if c != "__text"]
            lists = pa.list_(pa.int64())
            out = pa.RecordBatch.from_arrays([*rest, pa.array(n), pa.array([h or [] for h in hits], lists), pa.array([i or [] for i in items], pa.list_(pa.string()))], [*names, "n_words", "hit_words", "items"])
            yield out.filter(pa.array([h is not None for h in hits])) if sparse else out


def contaminated_words(docs: DataFrame, benchmark: DataFrame, length: int = 10, block_windows: int = 1 << 19, item_col: str = "item_id", item_text: str = "text", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (ascending word numbers inside a benchmark window) and ``items`` (ids, as texts in their order, whose windows occur).

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Null and
    empty texts have no words, and null, empty or wordless items no window. Repeated items count
    under each id; an empty benchmark hits nothing. Windows that overlap or repeat count their words
    once. Columns of the input called like an added one are replaced.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    added = ["n_words", "hit_words", "items"]
    docs = docs.drop(*added)
    asked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = asked.agg(F.sum(F.greatest(F.lit(1), words)), F.sum(F.length("text"))).first()
    # a block holds at most block_windows windows, and an item of any length is in one block
    blocks = max(1, -(-(total[0] or 0) // block_windows), -(-(total[1] or 0) // (16 * block_windows)))
    thin = docs.select(F.col(text_col).alias("text"))
    rows = docs.withColumn("__text", F.col(text_col))
    plain = docs.schema.fields
    extra = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    if blocks == 1:
        ask = _prepared(spark, thin, asked, length)
        return rows.mapInArrow(lambda b: give_back(_match(b, ask.value, sparse=False)), T.StructType([*plain, *extra]))
    # several blocks: each row gets a number for joining the blocks' hits, which are few, to it again
    rows = rows.withColumn("__row", F.xxhash64(F.struct(*[c for c in docs.columns])))
    part = None
    for k in range(blocks):
        ask = _prepared(spark, thin, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k), length)
        one = rows.select("__row", "__text").mapInArrow(lambda b, ask=ask: give_back(_match(b, ask.value, sparse=True)), T.StructType([T.StructField("__row", T.LongType()), *extra]))
        part = one if part is None else part.unionByName(one)
    merged = part.groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = F.array().cast("array<long>")
    out = rows.withColumn("n_words", F.coalesce(F.regexp_count("__text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")).join(merged, "__row", "left")
    return out.select(*docs.columns, "n_words", F.coalesce("hit_words", empty).alias("hit_words"), F.coalesce("items", empty.cast("array<string>")).alias("items"))


def _prepared(spark, thin: DataFrame, asked: DataFrame, length: int):
    """Windows of a block with their prefix tokens chosen by the shingles' counts over all documents; broadcast."""
    items = [(r[0], r[1]) for r in asked.collect()]  # a block: bounded by block_windows
    ask = windows_of(items, length)
    counts: dict[int, int] = {}
    if len(ask.shingle):
        hashes, widths = np.unique(ask.shingle), sorted(set(ask.width.tolist()))
        found = thin.mapInArrow(lambda b: give_back(_count_shingles(b, hashes, widths)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        counts = {r[0]: r[1] for r in found.collect()}  # at most one row a shingle of the block
    return spark.sparkContext.broadcast(ask.use_prefix(counts))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``; options as ``contaminated_words``."""
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = contaminated_words(docs.drop(*added), benchmark, **options)
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        *[c for c in docs.columns if c not in added],
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
