"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of its language's common words are held
against that language's references, which are the pooled histograms of all its documents. The common
words of a language are learned from the table. A document whose Jensen-Shannon distance to a reference is
above the limit is dropped, if it is long enough for the histogram to mean something. Counts are taken in
one pass over the texts and written; references and verdicts come from the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise

SYMBOLS = "#*$%&|<>"
COMMON, LONGEST_COMMON = 16, 6  # how many common words of a language, and of how many characters at most

#: Character classes that are counted, as inside brackets; white space, SYMBOLS, what is beyond ASCII and the rest come without.
CLASSES = {"upper": "A-Z", "digit": "0-9", "mark": r".,;:'\"()?!-"}
N_CLASSES = len(CLASSES) + 4


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _words(text: Column) -> Column:
    """What lies between runs of white space; splitting there is quicker than asking for each word."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of counts; 1 where one is all zero."""

    def shares(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return F.transform(a, lambda x: F.when(total > 0, x / total).otherwise(0.0))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, 0.5 * x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(shares(p), shares(q), lambda x, y: part(x, y) + part(y, x))
    some = F.exists(p, lambda x: x > 0) & F.exists(q, lambda x: x > 0)
    return F.when(some, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))).otherwise(1.0)


def _windows(words: Column) -> Column:
    """64-bit hashes of the 3-word windows."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    turned = lambda x, k: F.shiftleft(x, k).bitwiseXOR(F.shiftrightunsigned(x, 64 - k))
    from_ = lambda k: F.slice(h, k + 1, F.greatest(F.size(words) - 2, F.lit(0)))
    pairs = F.zip_with(from_(0), from_(1), lambda a, b: turned(a, 21).bitwiseXOR(turned(b, 42)))
    return F.zip_with(pairs, from_(2), lambda ab, c: ab.bitwiseXOR(c))


def _sorted_spots(windows: Column) -> Column:
    """The windows' hashes with their places, equal ones side by side."""
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(sorted_spots: Column) -> Column:
    """Places, ascending, of the windows that stand twice or more."""
    n = F.size(sorted_spots)
    kept = F.filter(sorted_spots, lambda s, i: ((i > 0) & (F.get(sorted_spots, i - 1)["h"] == s["h"])) | ((i < n - 1) & (F.get(sorted_spots, i + 1)["h"] == s["h"])))
    return F.sort_array(F.transform(kept, lambda s: s["i"]))


def _union_length(starts: Column) -> Column:
    """Total length of the 3-word ranges from ``starts``, ascending."""
    gaps = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(__of, list): each language's most common short words over all its documents, of equals the first by code points."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__of")
    each = docs.select(lang, F.explode(_words(_text(text_col))).alias("w")).where(F.length("w") <= LONGEST_COMMON)
    counts = each.groupBy("__of", "w").agg(F.count(F.lit(1)).alias("n"))
    # the first of each hundredth of the words, then of those: no task ranks all words of a language
    parts = counts.withColumn("__p", F.pmod(F.xxhash64("w"), F.lit(128)))
    some = parts.withColumn("r", F.row_number().over(W.partitionBy("__of", "__p").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    first = some.withColumn("r", F.row_number().over(W.partitionBy("__of").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON)
    return first.groupBy("__of").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("list"))


def count_statistics(docs: DataFrame, keep: Sequence[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms."""
    common = materialise(common_words(docs, text_col, lang_col))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, lang.alias("__lang"), _text(text_col).alias("__t"))
    rows = rows.join(_small(common), F.col("__lang") == F.col("__of"), "left").drop("__of")
    rows = rows.withColumn("__words", _words(F.col("__t")))
    rows = rows.withColumn("__windows", _windows(F.col("__words")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    rows = rows.withColumn("__lines", lines)
    # a hash set tells texts whose windows are all different; only others are sorted
    rows = rows.withColumn("__some", F.size(F.array_distinct("__windows")) < F.size("__windows"))
    rows = rows.withColumn("__sorted", F.when(F.col("__some"), _sorted_spots(F.col("__windows"))))
    rows = rows.withColumn("__starts", F.when(F.col("__some"), _repeated(F.col("__sorted"))))
    listed = F.coalesce("list", F.array().cast("array<string>"))
    rows = rows.withColumn("__list", listed).withColumn("__hits", F.filter("__words", lambda w: F.array_contains("__list", w)))
    rows = rows.withColumn("__some_class", F.array(*[F.length(F.regexp_replace("__t", f"[^{p}]+", "")).cast("double") for p in CLASSES.values()]))
    rows = rows.withColumn("word_chars", F.aggregate("__words", F.lit(0), lambda a, w: a + F.length(w)).cast("long"))
    rows = rows.withColumn("n_symbols", F.regexp_count("__t", F.lit(f"[{SYMBOLS}]")).cast("long"))
    chars = F.length("__t")
    others = F.array((chars - F.col("word_chars")).cast("double"), F.col("n_symbols").cast("double"), (F.octet_length("__t") - chars).cast("double"))
    rows = rows.withColumn("__class", F.concat("__some_class", others))
    rest = F.greatest(F.lit(0.0), chars - F.aggregate("__class", F.lit(0.0), lambda a, x: a + x))
    n = F.size("__words").cast("long")
    found = F.transform("__list", lambda k: (F.size("__hits") - F.size(F.array_remove("__hits", k))).cast("double"))
    return rows.select(
        *keep,
        "__lang",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("__some"), _union_length(F.col("__starts"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.concat("__class", F.array(rest)).alias("class_counts"),
        F.concat(found, F.array((n - F.size("__hits")).cast("double"))).alias("word_counts"),
    )


def _small(per_language: DataFrame) -> DataFrame:
    """A written table of a row a language, for broadcast while that many are few."""
    return F.broadcast(per_language) if per_language.count() <= 10_000 else per_language


def references(counts: DataFrame) -> DataFrame:
    """(__ref, class_ref, word_ref): sums of the documents' shares, so a long document weighs like a short one."""

    def share(col: str, i: int) -> Column:
        total = F.aggregate(col, F.lit(0.0), lambda a, x: a + x)
        return F.coalesce(F.sum(F.when(total > 0, F.get(col, F.lit(i)) / total)), F.lit(0.0))

    sums = [share("class_counts", i).alias(f"c{i}") for i in range(N_CLASSES)] + [share("word_counts", i).alias(f"w{i}") for i in range(COMMON + 1)]
    per = counts.groupBy(F.col("__lang").alias("__ref")).agg(*sums, F.max(F.size("word_counts")).alias("__size"))
    return per.select("__ref", F.array(*[f"c{i}" for i in range(N_CLASSES)]).alias("class_ref"), F.slice(F.array(*[f"w{i}" for i in range(COMMON + 1)]), F.lit(1), F.col("__size")).alias("word_ref"))


def judge_quality(docs: DataFrame, keep: Sequence[str] = ("doc_id",), class_limit: float = 0.28, word_limit: float = 0.5, least_chars: int = 100, least_words: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``keep`` columns of every row with its counts, both distances, ``base_failed`` and ``kept``.

    A document fails the base rules with fewer than 50 words, or more than half of its words in
    3-word windows that repeat. Otherwise it is dropped where ``class_distance`` or ``word_distance``
    is above its limit, by the histograms of texts of ``least_chars`` characters and ``least_words``
    words at least. Null and empty texts have zero counts and fail. A null language has a
    reference of its own. Repeated rows get equal results; an empty table gives an empty table.
    """
    counts = materialise(count_statistics(docs, keep, text_col, lang_col))
    rows = counts.join(_small(materialise(references(counts))), F.col("__lang") == F.col("__ref"))
    rows = rows.withColumn("class_distance", js_distance(F.col("class_counts"), F.col("class_ref"))).withColumn("word_distance", js_distance(F.col("word_counts"), F.col("word_ref")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars = F.aggregate("class_counts", F.lit(0.0), lambda a, x: a + x)
    odd = ((chars >= least_chars) & (F.col("class_distance") > class_limit)) | ((F.col("n_words") >= least_words) & (F.col("word_distance") > word_limit))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~odd).alias("kept"), "class_distance", "word_distance")
