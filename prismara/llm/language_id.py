"""Language identification with interpolated Kneser-Ney character language models.

A text is a row of letter runs (its other characters only part them), and the models predict each
run's characters and its end from up to ``ORDER - 1`` characters before them, never across the run's
start. N-gram counts of all labelled rows, of every order, are added up by Spark; the model is a
sorted array of n-gram hashes with one log-probability a language beside it. As a run's score does not
depend on its neighbours, each Arrow batch scores its distinct tokens once.

Where the longest orders are too many for a broadcast, they stay a table of what their grams add to a score. That is joined to
the grams of the distinct tokens of all texts; what a token gets is broadcast for frequent tokens and joined for the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekernel import slices
from .common import discard, give_back, materialise, modest_batches

ORDER = 5
HELD_GRAMS = 100_000
WORDS_AT_ONCE = 10_000
UNSEEN_LETTERS = 100_000  # how many letters share what is left for those that a language has not shown
MODEL_BYTES = 1 << 26
HOT_LETTERS = 64  # longer tokens are joined, whatever their number
STEPS = 1 << 32  # of a nat, in which the longest orders' sums are kept, so that they do not depend on an order of adding up
EDGE = "\x20"
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """bool[0x110000]: the code points that are letters (or marks, which belong to the letter before)."""
    import unicodedata

    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def gram_hashes(codes: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` code points that end at each place."""
    h = np.full(len(places), length, dtype=np.uint64)
    for back in range(length - 1, -1, -1):
        h = h * _STEP + codes[places - back].astype(np.uint64) + _U(1)
    return _mix(h)


def string_hash(grams: list[str]) -> np.ndarray:
    """``gram_hashes`` of whole strings; 0 for an empty one."""
    out = np.zeros(len(grams), dtype=np.uint64)
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    for k in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == k)
        codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32)
        out[at] = gram_hashes(codes, np.arange(k - 1, len(codes), k), int(k))
    return out


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased tokens of a batch (parted by white space), the token of each place, and the places of each text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(text.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def runs(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, depth, word): ``words`` as letter runs with an edge before and after each.

    ``depth`` is the number of characters before a place that belong to its run, its opening edge
    included, and 0 at an opening edge; ``word`` is the word that a place stands in.
    """
    codes = np.frombuffer((EDGE + (2 * EDGE).join(words.to_pylist()) + EDGE).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), pc.utf8_length(words).to_numpy(zero_copy_only=False) + 2)
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the character after a run is its end
    keep[:-1] |= letter[1:]  # and that before it is its beginning
    codes, letter, word = np.where(letter, codes, ord(EDGE))[keep].astype(np.uint32), letter[keep], word[keep]
    place = np.arange(len(codes))
    edge = np.maximum.accumulate(np.where(~letter, place, 0))
    before = np.concatenate(([0], edge[:-1])) if len(edge) else edge
    depth = np.where(letter, place - edge, place - before)
    # an edge after an edge opens a run only; one edge may both end a run and open the next
    opens = ~letter & np.concatenate(([True], ~letter[:-1]))[: len(letter)]
    depth[opens] = 0
    return codes, depth, word


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): counts of a partition; grams of ORDER characters, and shorter ones where they begin at a run's edge.

    Texts are taken in slices of a few megabytes and counts given out by the hundred thousand, so a
    worker's memory depends neither on its rows nor on the number of different grams.
    """
    held: dict[str, dict[str, int]] = {}
    for batch in batches:
        for part, _, _ in slices(batch, "text"):
            _add_grams(held, part.column("text"), part.column("lang").to_pylist())
            if sum(map(len, held.values())) > HELD_GRAMS:
                yield from _counted(held)
                held.clear()
    yield from _counted(held)


def _add_grams(held: dict[str, dict[str, int]], text: pa.Array, langs: list[str]) -> None:
    words, index, offs = tokens(text)
    if not len(words):
        return
    names = sorted(set(langs))
    lang_of = np.repeat(np.array([names.index(x) for x in langs]), np.diff(offs))
    times = np.bincount(lang_of * len(words) + index, minlength=len(names) * len(words)).reshape(len(names), len(words))
    codes, depth, word = runs(words)
    for k in range(2, ORDER + 1):
        at = np.flatnonzero(depth >= k - 1 if k == ORDER else depth == k - 1)
        if not len(at):
            continue
        hashes, first, inverse = np.unique(gram_hashes(codes, at, k), return_index=True, return_inverse=True)
        grams = [codes[p - k + 1 : p + 1].tobytes().decode("utf-32-le") for p in at[first]]
        for i, name in enumerate(names):
            n = np.bincount(inverse, weights=times[i][word[at]], minlength=len(hashes))
            own = held.setdefault(name, {})
            for j in np.flatnonzero(n).tolist():
                own[grams[j]] = own.get(grams[j], 0) + int(n[j])


def _counted(held: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    for lang, grams in held.items():
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])


@dataclass
class Model:
    """Sorted n-gram hashes; per language their log-probabilities and, as contexts, their back-off weights."""

    langs: list[str]
    keys: np.ndarray  # uint64, sorted
    logp: np.ndarray  # float32 [n, langs]; the probability of the last character after the others
    back: np.ndarray  # float32 [n, langs]; 0 where a language never saw the gram as a context
    floor: np.ndarray  # float32 [langs]; an unseen character
    start: np.ndarray | None = None  # where the keys with given top bits begin
    reject: np.ndarray | None = None  # per language, the cross-entropy beyond which a text is of none of them
    whole: int = ORDER  # the longest order held
    rest: DataFrame | None = None  # of longer ones, ``rest_weights``
    words: tuple[np.ndarray, np.ndarray] | None = None  # sorted hashes of frequent tokens, and what longer orders add to their nats

    TOP = 18

    def indexed(self) -> Model:
        tops = (self.keys >> _U(64 - self.TOP)).astype(np.int64)
        self.start = np.searchsorted(tops, np.arange((1 << self.TOP) + 1)).astype(np.int32)
        return self

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the sorted keys, else -1: a look at its top bits' bucket, then along it."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        top = (hashes >> _U(64 - self.TOP)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == hashes[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def score(self, codes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """float32 [places, langs]: log-probability of the character at each place, opening edges 0."""
        out = np.zeros((len(codes), len(self.langs)), dtype=np.float32)
        left = np.flatnonzero(depth > 0)
        for k in range(self.whole, 1, -1):
            sized = depth[left] >= k - 1
            at = left[sized]
            found = self.find(gram_hashes(codes, at, k))
            hit = found >= 0
            out[at[hit]] += self.logp[found[hit]]
            miss = at[~hit]
            context = self.find(gram_hashes(codes, miss - 1, k - 1))
            seen = context >= 0
            out[miss[seen]] += self.back[context[seen]]
            left = np.concatenate((left[~sized], miss))
        found = self.find(gram_hashes(codes, left, 1))
        out[left] += np.where((found >= 0)[:, None], self.logp[np.maximum(found, 0)] if len(self.logp) else self.floor, self.floor)
        return out


def levels(counts: DataFrame) -> list[DataFrame]:
    """(lang, gram, n) of each order from ORDER down to 1, of ``counts`` of the longest grams and those that begin at an edge.

    Lower orders count distinct left neighbours instead; grams from an edge on have none and keep their counts.
    """
    out = [materialise(counts.where(F.length("gram") == ORDER))]
    for k in range(ORDER - 1, 0, -1):
        onward = out[-1].select("lang", F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("n"))
        level = counts.where(F.length("gram") == k).select("lang", "gram", "n").unionByName(onward)
        out.append(materialise(level.groupBy("lang", "gram").agg(F.sum("n").alias("n"))))
    return out


@dataclass
class Cuts:
    """Discounts by language and order, the unigrams' (total, kinds), and the longest order that a model holds."""

    discount: dict[tuple[str, int], float]
    letters: dict[str, tuple[int, int]]
    orders: int


def plan_cuts(orders: list[DataFrame], room: int) -> Cuts:
    """Discounts from all grams, and how many orders fit into a model of ``room`` (language, gram) pairs; longer ones stay tables.

    All contexts and shorter grams of an order are in the one below, so a model of whole orders is one of its own.
    """
    counted = reduce(DataFrame.unionByName, [x.withColumn("k", F.length("gram")) for x in orders])
    kinds = counted.groupBy("lang", "k").agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.sum("n")).collect()  # one row a language and order
    discount = {(r[0], r[1]): min(0.95, max(0.1, r[3] / (r[3] + 2 * r[4]))) if r[3] else 0.5 for r in kinds}
    letters = {r[0]: (r[5], r[2]) for r in kinds if r[1] == 1}
    whole = 0
    # single characters are as many as there are code points, and are always held
    while whole < ORDER and ((size := sum(r[2] for r in kinds if r[1] == whole + 1)) <= room or whole == 0):
        whole, room = whole + 1, room - size
    return Cuts(discount, letters, whole)


def _by_language(values: dict[str, float], otherwise: float) -> Column:
    """Column of a number by ``lang``; languages are few."""
    pairs = [F.lit(x) for lang, v in sorted(values.items()) for x in (lang, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(float(otherwise))) if pairs else F.lit(float(otherwise))


def shares(level: DataFrame, k: int, cuts: Cuts) -> tuple[DataFrame, DataFrame | None]:
    """(lang, gram, share) of the grams of an order, and (lang, gram, back) of their contexts.

    A share is of the context's counts, less the discount. A context's weight for its shorter ones is what its grams leave of 1.
    """
    if k == 1:
        mass = _by_language({lang: total + kinds + 1 for lang, (total, kinds) in cuts.letters.items()}, 1)
        return level.select("lang", "gram", ((F.col("n") + 0.5) / mass).alias("share")), None
    discount = _by_language({lang: d for (lang, size), d in cuts.discount.items() if size == k}, 0.5)
    level = level.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
    held = F.greatest(F.lit(0.0), F.col("n") - discount)
    sums = materialise(level.groupBy("lang", "context").agg(F.sum("n").alias("sum"), F.sum(held).alias("held")))
    grams = level.join(sums, ["lang", "context"]).select("lang", "gram", (held / F.col("sum")).alias("share"))
    back = sums.select("lang", F.col("context").alias("gram"), (1 - F.col("held") / F.col("sum")).alias("back"))
    back.written_to = sums.written_to
    return grams, back


def rest_weights(orders: list[DataFrame], langs: list[str], cuts: Cuts) -> DataFrame:
    """(lang, gram, as_gram, as_context): what the orders beyond those that a model holds add to a language's nats, in ``1 / STEPS``.

    A character's log-probability is that of its longest gram known, and the weights of the longer contexts known. Of a known gram all
    ends are known, so it is also a sum over its known grams, of their steps from the next shorter gram, and over the other known
    contexts, of their weights: a weight a gram, as the gram that ends in a character and as the context of one.
    """
    zero, parts, written = F.lit(0.0), [], []
    shorter = shares(orders[ORDER - 1], 1, cuts)[0].withColumnRenamed("share", "p")
    for k in range(2, ORDER + 1):
        grams, contexts = shares(orders[ORDER - k], k, cuts)
        grams = grams.withColumn("head", F.expr(f"substring(gram, 1, {k - 1})")).withColumn("tail", F.expr("substring(gram, 2)"))
        grams = grams.join(contexts.withColumnRenamed("gram", "head"), ["lang", "head"]).join(shorter.withColumnsRenamed({"gram": "tail", "p": "below"}), ["lang", "tail"])
        level = materialise(grams.select("lang", "gram", "back", "below", (F.col("share") + F.col("back") * F.col("below")).alias("p")))
        written += [level, contexts]
        if k > cuts.orders:
            parts.append(level.select("lang", "gram", (F.log(F.col("p") / F.col("below")) - F.log("back")).alias("as_gram"), zero.alias("as_context")))
            parts.append(contexts.select("lang", "gram", zero.alias("as_gram"), F.log("back").alias("as_context")))
        shorter = level.select("lang", "gram", "p")
    steps = lambda c: F.round(F.sum(c) * STEPS).cast("long").alias(c)
    place = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int").alias("lang")
    out = materialise(reduce(DataFrame.unionByName, parts).groupBy("lang", "gram").agg(steps("as_gram"), steps("as_context")).select(place, "gram", "as_gram", "as_context"))
    for df in written:
        discard(df)
    return out


def _hashed(batches: Iterator[pa.RecordBatch], langs: list[str], value: str) -> Iterator[pa.RecordBatch]:
    """(lang, gram, value) with the language's place and the gram's hash; of shares also those of its context and its shorter gram."""
    place = {x: i for i, x in enumerate(langs)}
    for batch in batches:
        lang, grams = batch.column("lang").to_pylist(), batch.column("gram").to_pylist()
        parts = [grams, [g[:-1] for g in grams], [g[1:] for g in grams]] if value == "share" else [grams]
        hashes = [pa.array(string_hash(x).view(np.int64)) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.array([place[x] for x in lang], pa.int32()), *hashes, batch.column(value)], ["lang", *("key", "head", "tail")[: len(parts)], value])


def _arrays(df: DataFrame, langs: list[str], value: str) -> dict[str, np.ndarray]:
    """A bounded table of an order, as arrays."""
    longs = ["key", "head", "tail"] if value == "share" else ["key"]
    table = df.withColumn(value, F.col(value).cast("float")).mapInArrow(lambda b: give_back(_hashed(b, langs, value)), f"lang int, {', '.join(f'{c} long' for c in longs)}, {value} float").toArrow()
    return {c: table.column(c).to_numpy().view(np.uint64) if c in longs else table.column(c).to_numpy() for c in table.column_names}


def kneser_ney(grams: list[dict[str, np.ndarray]], contexts: list[dict[str, np.ndarray]], langs: list[str], cuts: Cuts) -> Model:
    """Interpolated Kneser-Ney model of each language over the union of their n-grams, of ``_arrays`` of each order from 1 on.

    A gram that a language lacks gets what it backs off to.
    """
    keys = np.unique(np.concatenate([x["key"] for x in (*grams, *contexts)]))  # some contexts, as an edge alone, are no grams
    logp, back = (np.zeros((len(keys), len(langs)), dtype=np.float32) for _ in range(2))
    floor = np.zeros(len(langs), dtype=np.float32)
    for i, name in enumerate(langs):
        total, kinds = cuts.letters.get(name, (0, 0))
        floor[i] = np.log(0.5 / (total + kinds + 1) / UNSEEN_LETTERS) if total else np.log(1e-12)
    logp[:] = floor
    for x in contexts:
        back[np.searchsorted(keys, x["key"]), x["lang"]] = np.log(x["back"])
    for k, x in enumerate(grams, 1):
        row = np.searchsorted(keys, x["key"])
        if k == 1:
            logp[row, x["lang"]] = np.log(x["share"])
            continue
        union, first = np.unique(row, return_index=True)
        above, below = (np.searchsorted(keys, x[c][first]) for c in ("head", "tail"))
        logp[union] = back[above] + logp[below]
        logp[row, x["lang"]] = np.log(x["share"] + np.exp(logp[row, x["lang"]]))
    return Model(langs, keys, logp, back, floor, whole=cuts.orders).indexed()


def score_texts(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(nats [texts, langs], predicted characters) of each text."""
    words, index, offs = tokens(text)
    nats, chars = np.zeros((len(text), len(model.langs))), np.zeros(len(text))
    if not len(words):
        return nats, chars
    each, size = np.zeros((len(words), len(model.langs))), np.zeros(len(words))
    for a in range(0, len(words), WORDS_AT_ONCE):
        codes, depth, word = runs(words.slice(a, WORDS_AT_ONCE))
        part = model.score(codes, depth)
        n = min(WORDS_AT_ONCE, len(words) - a)
        size[a : a + n] = np.bincount(word, weights=depth > 0, minlength=n)[:n]
        for i in range(len(model.langs)):
            each[a : a + n, i] = np.bincount(word, weights=part[:, i], minlength=n)[:n]
    if model.words is not None:
        at, row = _hot(words, model.words[0])
        each[at] += model.words[1][row] / STEPS
    full = np.flatnonzero(np.diff(offs) > 0)
    starts = offs[:-1][full]
    chars[full] = np.add.reduceat(size[index], starts)
    for i in range(len(model.langs)):
        nats[full, i] = np.add.reduceat(each[index, i], starts)
    return nats, chars


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", model_bytes: int = MODEL_BYTES) -> Model:
    """Fit on all rows with a language and a text.

    Counts, continuation counts, discounts and context sums are taken in Spark over all grams. The model's
    arrays have at most ``model_bytes`` (keys, and two numbers a language and key) beside single characters, whatever
    the input: orders that do not fit stay a table, ``rest``, of which ``predict`` adds up what its texts need.
    Languages are a closed set of labels, so tables of one row a language are small.
    """
    modest_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = materialise(rows.mapInArrow(lambda b: give_back(count_grams(b)), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32)).indexed()
    orders = levels(counts)
    cuts = plan_cuts(orders, model_bytes // (8 + 8 * len(langs)))
    grams, contexts = [], []
    for k in range(1, cuts.orders + 1):  # each order by itself: at most model_bytes in all
        of, sums = shares(orders[ORDER - k], k, cuts)
        grams.append(_arrays(of, langs, "share"))
        if sums is not None:
            contexts.append(_arrays(sums, langs, "back"))
            discard(sums)
    model = kneser_ney(grams, contexts, langs, cuts)
    if cuts.orders < ORDER:
        model.rest = rest_weights(orders, langs, cuts)
    for df in (counts, *orders):
        discard(df)
    return model


PREDICTED = "lang_pred string, score double, cross_entropy double, accepted boolean"


def _scored(model: Model, text: pa.Array, more: pa.Array | None = None) -> pa.Array:
    """PREDICTED structs of a column of texts, scored in slices of a few megabytes; ``more`` is what a text's rare tokens add, in ``1 / STEPS``."""
    out: list[list[pa.Array]] = [[pa.array([], t)] for t in (pa.string(), pa.float64(), pa.float64(), pa.bool_())]
    rows = pa.RecordBatch.from_arrays([text, pa.nulls(len(text)) if more is None else more], ["text", "more"])
    for part, _, _ in slices(rows, "text"):
        nats, chars = score_texts(model, part.column("text"))
        if more is not None:
            nats += np.array([x or [0] * len(model.langs) for x in part.column("more").to_pylist()], dtype=float).reshape(nats.shape) / STEPS
        pred, score, ok, entropy = decide(model, nats, chars)
        langs = pa.array([model.langs[p] if p >= 0 else "und" for p in pred], pa.string())
        for kept, values in zip(out, (langs, pa.array(score), pa.array(entropy), pa.array(ok)), strict=True):
            kept.append(values)
    return pa.StructArray.from_arrays([pa.concat_arrays(x) for x in out], ["lang_pred", "score", "cross_entropy", "accepted"])


def decide(model: Model, nats: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language or -1, confidence, accepted, nats a character) of each text."""
    n = len(chars)
    if not model.langs:
        return np.full(n, -1), np.zeros(n), np.zeros(n, bool), np.zeros(n)
    entropy = -nats / np.maximum(chars, 1)[:, None]
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(n), best]
    # softmax of the length-normalised scores over a few characters' worth of evidence
    odds = np.exp(-(entropy - low[:, None]) * np.minimum(chars, 20)[:, None])
    score = 1 / odds.sum(axis=1)
    limit = model.reject[best] if model.reject is not None else np.inf
    any_letter = chars > 0
    return np.where(any_letter, best, -1), np.where(any_letter, score, 0.0), any_letter & (low <= limit), np.where(any_letter, low, 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``accepted``.

    Null texts and texts without a letter are ``und``, with score 0, and not accepted; so is every
    text where no language was learned. Texts of any length are scored whole. Repeated rows get equal
    results. Columns of the input called like an added one are replaced.
    """
    added = ["lang_pred", "score", "cross_entropy", "accepted"]
    docs = docs.drop(*added)
    return with_language(docs, text_col, model).select(*docs.columns, "__language.*")


def with_language(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``docs`` with a PREDICTED struct, ``__language``, of each text; only texts, and what their rare tokens add, go to Python."""
    spark = docs.sparkSession
    modest_batches(spark)
    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    if model.rest is None:
        return docs.select("*", _language(spark, model)(text).alias("__language"))
    hot, rare = rare_tokens(docs.select(F.sha2(text, 256).alias("__digest"), text.alias("text")).where("text IS NOT NULL"), model)
    held = docs.withColumn("__digest", F.sha2(text, 256)).join(rare, "__digest", "left")
    return held.select(*docs.columns, _language(spark, replace(model, rest=None, words=hot), True)(text, F.col("__more")).alias("__language"))


def _language(spark: SparkSession, model: Model, more: bool = False):
    """The function of a text, and with ``more`` of what its rare tokens add, that gives PREDICTED structs."""
    shared = spark.sparkContext.broadcast(model)  # at most train's model_bytes, and as much of frequent tokens

    @F.arrow_udf(PREDICTED)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from give_back(_scored(shared.value, batch) for batch in batches)

    @F.arrow_udf(PREDICTED)
    def scored_with(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from give_back(_scored(shared.value, batch, added) for batch, added in batches)

    return scored_with if more else scored


def rare_tokens(texts: DataFrame, model: Model) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """What the orders in ``rest`` add to texts (__digest, text), in ``1 / STEPS``: arrays of the most frequent tokens, as in
    ``Model.words``, and (__digest, __more), a list of a number a language, of the other tokens of each text that has such.
    """
    langs, whole = range(len(model.langs)), model.whole
    tokens_of = texts.select("text").mapInArrow(lambda b: give_back(_token_counts(b)), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    vocabulary = materialise(tokens_of.withColumn("__token", F.monotonically_increasing_id()))
    grams = vocabulary.select("__token", "token").mapInArrow(lambda b: give_back(_long_grams(b, whole)), "__token long, gram string, grams long, contexts long")
    added = grams.join(model.rest, "gram").withColumn("value", F.expr("grams * as_gram + contexts * as_context"))
    summed = lambda c: F.array(*[F.sum(c(i)) for i in langs]).alias("__more")
    known = vocabulary.join(added.groupBy("__token").agg(summed(lambda i: F.when(F.col("lang") == i, F.col("value")).otherwise(0))), "__token").select("token", "n", "__more")
    known = materialise(known.withColumn("power", F.when(F.length("token") <= HOT_LETTERS, F.floor(F.log2("n")).cast("int")).otherwise(-1)))
    room, least = MODEL_BYTES // (8 + 8 * len(model.langs)), 64
    for power, n in known.where("power >= 0").groupBy("power").count().orderBy(F.desc("power")).collect():  # a row a power of two
        room -= n
        if room < 0:
            break
        least = power
    table = known.where(F.col("power") >= least).select("token", "__more").toArrow()
    keys = string_hash(table.column("token").to_pylist())
    order = np.argsort(keys)
    values = table.column("__more").combine_chunks()
    hot = keys[order], (values.flatten().to_numpy() if len(values) else np.zeros(0, np.int64)).reshape(-1, len(model.langs))[order]
    shared = texts.sparkSession.sparkContext.broadcast(hot[0])
    rare = texts.mapInArrow(lambda b: give_back(_rare_counts(b, shared.value, whole)), "__digest string, token string, times long")
    rare = rare.groupBy("__digest", "token").agg(F.max("times").alias("times"))  # equal texts count once
    rare = rare.join(known.where(F.col("power") < least).select("token", "__more"), "token")
    return hot, rare.groupBy("__digest").agg(summed(lambda i: F.col("times") * F.col("__more")[i]))


def _hot(words: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of frequent tokens in ``words``, and their rows among the sorted hashes ``keys``."""
    short = np.flatnonzero(pc.utf8_length(words).to_numpy(zero_copy_only=False) <= HOT_LETTERS)
    if not len(keys):
        return short[:0], short[:0]
    hashes = string_hash(words.take(pa.array(short)).to_pylist())
    row = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    found = keys[row] == hashes
    return short[found], row[found]


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in slices(batch, "text"):
            words, index, _ = tokens(part.column("text"))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(index, minlength=len(words)).astype(np.int64))], ["token", "n"])


def _long_grams(batches: Iterator[pa.RecordBatch], whole: int) -> Iterator[pa.RecordBatch]:
    """(__token, token) -> (__token, gram, grams, contexts): grams of more than ``whole`` characters, and the contexts that they would follow."""
    for batch in batches:
        for part, _, _ in slices(batch, "token"):
            codes, depth, word = runs(part.column("token"))
            ident = part.column("__token").to_numpy()
            for k in range(whole + 1, ORDER + 1):
                at = np.flatnonzero(depth >= k - 1)
                for size, last, is_gram in ((k, at, 1), (k - 1, at - 1, 0)):
                    if len(at):
                        windows = np.ascontiguousarray(codes[last[:, None] + np.arange(1 - size, 1)])
                        texts = windows.view(f"<U{size}").ravel().tolist()
                        columns = [pa.array(ident[word[at]]), pa.array(texts, pa.string()), *(pa.array(np.full(len(at), x, np.int64)) for x in (is_gram, 1 - is_gram))]
                        yield pa.RecordBatch.from_arrays(columns, ["__token", "gram", "grams", "contexts"])


def _rare_counts(batches: Iterator[pa.RecordBatch], hot: np.ndarray, whole: int) -> Iterator[pa.RecordBatch]:
    """(__digest, text) -> (__digest, token, times): each text's tokens that are not ``hot`` and have grams of more than ``whole`` characters."""
    for batch in batches:
        for part, _, _ in slices(batch, "text"):
            words, index, offs = tokens(part.column("text"))
            if not len(words):
                continue
            _, depth, word = runs(words)
            asked = np.zeros(len(words), bool)
            asked[word[depth >= whole]] = True
            asked[_hot(words, hot)[0]] = False
            text = np.repeat(np.arange(part.num_rows), np.diff(offs))[asked[index]]
            pairs, times = np.unique(text * len(words) + index[asked[index]], return_counts=True)
            columns = [part.column("__digest").take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["__digest", "token", "times"])


def calibrate(model: Model, held: DataFrame, lang_col: str = "lang", text_col: str = "text", quantile: float = 0.999, margin: float = 2.5, letters: int = 40) -> Model:
    """Sets the rejection limits: per language ``margin`` times the ``quantile`` of the cross-entropies of ``held`` texts known to be of it, which the model has not seen.

    Short texts vary more; as long as texts of ``letters`` letters set the limit, ``margin`` covers them, and texts in two languages.
    """
    rows = held.where(F.col(lang_col).isNotNull() & (F.length(text_col) >= letters)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = predict(rows, model).where("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("cross_entropy", quantile, 10_000)).collect()
    limits = {r[0]: r[1] for r in found}
    most = max((v for v in limits.values() if v), default=np.inf)  # for a language that none of the texts is of
    model.reject = np.array([margin * (limits.get(x) or most) for x in model.langs])
    return model
