"""Fill-in-the-middle rewriting over succinct boundary bitvectors.

Every byte that starts a character is a set bit of one packed bitvector over all texts of a slice; a directory
of popcounts a block answers ``rank`` and ``select``. The popcount of a text is its number of units, and
``select`` on the two drawn ranks gives the byte positions of the cuts, without decoding the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekernel import slices

#: The sentinels before a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = "n long, prefix_units long, middle_units long, prefix_end int, middle_end int"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
_U = np.uint64


class Bitvector:
    """Set bits of a boolean array, packed into 64-bit words; eight words are a block of the directory."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        padded = np.zeros((len(packed) // 64 + 1) * 64, dtype=np.uint8)  # at least one bit beyond the last, for rank(len)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8").reshape(-1, 8)
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, word = at >> 9, (at >> 6) & 7
        below = (_U(1) << (at & 63).astype(_U)) - _U(1)
        words = self.words[block]
        inside = np.where(np.arange(8) < word[:, None], words, np.where(np.arange(8) == word[:, None], words & below[:, None], _U(0)))
        return self.directory[block] + np.bitwise_count(inside).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the set bit number ``k``, from 0; there must be one."""
        block = np.searchsorted(self.directory, k, "right") - 1
        left, words = k - self.directory[block], self.words[block]
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (sums <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(word > 0, sums[rows, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[rows, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
        return block * 512 + word * 64 + bit


def cuts_of(data: np.ndarray, offs: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each text, and where its prefix and its middle end, in units and in bytes."""
    bits = Bitvector((data & 0xC0) != 0x80)
    before = bits.rank(offs)
    n = np.diff(before)
    a, b = first % (n + 1), second % (n + 1)
    found = []
    for units in (np.minimum(a, b), np.maximum(a, b)):
        end = np.diff(offs)
        inside = units < n
        end[inside] = bits.select((before[:-1] + units)[inside]) - offs[:-1][inside]
        found += [units, end]
    return n, found[0], found[2], found[1], found[3]


def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, first, second in batches:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        rows = pa.RecordBatch.from_arrays([texts, first, second], ["text", "first", "second"])
        for part, data, offs in slices(rows, "text"):
            for kept, values in zip(out, cuts_of(data, offs, *(part.column(c).to_numpy() for c in ("first", "second"))), strict=True):
                kept.append(values)
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        names = [c.split()[0] for c in CUTS.split(", ")]
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(out, kinds, strict=True)], names)


def drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The ``k``-th eight hex digits of the SHA-256 of ``seed:id``, as a number. Null ids count as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rewritten: int = 90, suffix_first: int = 20) -> DataFrame:
    """``docs`` with ``n`` (characters), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Of 100 texts ``rewritten`` are cut in three at two drawn characters, and of 100 of these ``suffix_first`` have the
    suffix first. Null and empty texts, and those that contain a sentinel, stay plain: their ``output`` is the text (null: empty)
    and their two lengths are null. Rows of the same id and text are cut alike; null ids draw as one id. An empty table gives an empty one.
    Columns of the input called like an added one are replaced; the text and the id may be among them and are read first.
    Each row is cut by itself, in one pass over the table without a shuffle, so a lost executor costs only its tasks.
    """
    text, doc_id = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    cut = F.arrow_udf(_cut, CUTS)(text, drawn(doc_id, seed, 0), drawn(doc_id, seed, 1))
    kept = [c for c in docs.columns if c not in ADDED]
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (drawn(doc_id, seed, 2) % 100 >= rewritten)
    form = F.when(plain, "plain").when(drawn(doc_id, seed, 3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(*kept, text.alias("__whole"), form.alias("__form"), cut.alias("__cut"))
    raw, first, second = F.col("__whole").cast("binary"), F.col("__cut.prefix_end"), F.col("__cut.middle_end")
    prefix, middle = F.substring(raw, F.lit(1), first), F.substring(raw, first + 1, second - first)
    suffix = F.substring(raw, second + 1, F.octet_length(raw) - second)
    sign = [F.lit(x).cast("binary") for x in (PREFIX, SUFFIX, MIDDLE)]
    psm, spm = F.concat(sign[0], prefix, sign[1], suffix, sign[2], middle), F.concat(sign[1], suffix, sign[0], prefix, sign[2], middle)
    output = F.when(F.col("__form") == "plain", F.col("__whole")).when(F.col("__form") == "psm", psm.cast("string")).otherwise(spm.cast("string"))
    moved = F.col("__form") != "plain"
    return rows.select(
        *kept,
        F.col("__cut.n").alias("n"),
        F.col("__form").alias("form"),
        F.when(moved, F.col("__cut.prefix_units")).alias("prefix_chars"),
        F.when(moved, F.col("__cut.middle_units") - F.col("__cut.prefix_units")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text that ``output`` was made from. Its parts hold no sentinel, so there are four between them, the first empty."""
    part = F.split(output, "<[PSM]>")
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
