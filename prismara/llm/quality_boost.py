"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted on the texts' bytes in Arrow batches. The trees are grown on a bounded sample of
labelled rows, and flattened into arrays (feature, threshold, leaf) that numpy walks level by level for
all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytekernel import SPACED, Words, byte_table, slices
from .common import modest_batches

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "lower", "upper", "digits", "symbols", "pipes", "bangs", "stops", "commas", "other_marks",
    "beyond_ascii", "distinct_words", "distinct_shingles", "top_word", "log_lines", "distinct_lines", "line_bytes", "words_a_stop",
)

#: Byte classes, in the order of their counts.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~\\{}[]=+_", b"|", b"!", b".?", b",;:", b"'\"()-/`"]
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
_KINDS = len(_GROUPS) + 2
_LINES = byte_table(b"\n", lower=False)


def _distinct(hashes: np.ndarray, offs: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct hashes in each range, and the share of the most common one; ``less`` are left off a range's end."""
    share, top = np.ones(len(offs) - 1), np.zeros(len(offs) - 1)
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:] - less, strict=True)):
        if b > a:
            own = np.sort(hashes[a:b])
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            share[i], top[i] = (len(new) - 1) / (b - a), np.diff(new).max() / (b - a)
    return share, top


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """float64 [documents, FEATURES]; empty texts have zeros and shares of 1."""
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(doc * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS) / np.maximum(size, 1)[:, None]
    words, lines = Words(data, offs, SPACED), Words(data, offs, _LINES)
    count = np.diff(words.offs).astype(float)
    length = (words.end - words.start).astype(float)
    owner = np.repeat(np.arange(n), np.diff(words.offs))
    mean = np.bincount(owner, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(owner, length**2, n) / np.maximum(count, 1) - mean**2))
    distinct, top = _distinct(words.hash, words.offs)
    shingles, _ = _distinct(words.shingles(3), words.offs, 2)
    n_lines = np.diff(lines.offs).astype(float)
    distinct_lines, _ = _distinct(lines.hash, lines.offs)
    stops = kinds[:, 6] * size
    columns = [np.log1p(size), np.log1p(count), mean, spread, *kinds.T[:9], kinds[:, -1], distinct, shingles, top, np.log1p(n_lines), distinct_lines, size / np.maximum(n_lines, 1), count / np.maximum(stops, 1)]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete trees of one depth as arrays; a row goes right where its value is above the threshold."""

    depth: int
    base: float
    feature: np.ndarray  # int [trees, 2^depth - 1]
    threshold: np.ndarray
    leaf: np.ndarray  # float [trees, 2^depth]

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic boosting on binned features; a split needs ``least`` rows' worth of second derivatives on each side."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    positive = (y.sum() + 1) / (n + 2)
    inner, ends = (1 << depth) - 1, 1 << depth
    out = Trees(depth, float(np.log(positive / (1 - positive))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, ends)))
    if n == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # value <= edges[b] is bin <= b
    offset = np.arange(width) * bins
    margin = np.full(n, out.base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            at = ((node - first) * (width * bins))[:, None] + offset + binned
            shape = (nodes, width, bins)
            g = np.bincount(at.ravel(), np.repeat(grad, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(at.ravel(), np.repeat(hess, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
            gain[(h < least / 4) | (whole_h - h < least / 4)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, c = divmod(int(b), bins)
                if gain[k, j, c] > 1e-6 and c < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        place = node - inner
        leaf = -rate * np.bincount(place, grad, ends) / (np.bincount(place, hess, ends) + ridge)
        margin += leaf[place]
        grown.append((feature, threshold, leaf))
    out.feature, out.threshold, out.leaf = (np.stack(z) for z in zip(*grown, strict=True))
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in slices(batch, "text"):
            x = features(data, offs)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("label")), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def _scored(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in slices(batch, "__text"):
            score = trees.score(features(data, offs))
            rest = part.select([c for c in part.schema.names if c != "__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*rest.schema.names, "score", "predicted"])


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Trees:
    """Trees from at most about ``bound`` labelled rows of ``docs``, drawn by their ids' hashes.

    Rows without a label or id are left out; of an id's several labels the largest holds, of its several texts the first. Without
    rows of both classes the score is the smoothed share of the class there is.
    """
    modest_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1 << 30, (bound << 30) // max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(id_col, F.lit("draw")), F.lit(1 << 30)) < share)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), id_col)  # bounded: about ``bound`` ids
    rows = rows.groupBy(id_col).agg(F.min("text").alias("text"), F.max("label").alias("label"))  # one row an id, so that the bound holds for rows
    table = rows.select("text", "label").mapInArrow(_featured, "label int, x array<double>").toPandas()
    x = np.stack(table.x.to_list()) if len(table) else np.zeros((0, len(FEATURES)))
    return boost(x, table.label.to_numpy(dtype=float), **options)


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts are scored by their zero statistics; texts of any length are read whole.
    Repeated rows get equal scores. Columns of the input called like an added one are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.withColumn("__text", F.col(text_col)).mapInArrow(lambda b: _scored(b, shared.value), schema)
