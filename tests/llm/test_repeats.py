"""Repeated rows, shared and null ids: reruns agree, no task holds a row's copies, samples and models keep their bounds."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.llm import language_id, quality_boost
from prismara.llm.common import numbered_copies, row_hash
from prismara.llm.mixing import lay_out, mix_sources
from prismara.llm.secret_scan import text_sample
from prismara.llm.sharding import ring_shards


@pytest.mark.parametrize("parts", [1, 7])
def test_copies_are_numbered_from_zero(spark, parts):
    rows = [("a", 1)] * 50 + [("b", None)] * 3 + [("c", 2), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y int").repartition(parts)
    for most in (0, 100):
        out = numbered_copies(df.withColumn("same", row_hash(df)), "same", "copy", most)
        got = defaultdict(list)
        for r in out.collect():
            got[r["x"], r["y"]].append(r["copy"])
        assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in Counter(rows).items()}


def taken(df):
    return Counter((r["text"], r["size"], r["taken"]) for r in mix_sources(df).collect())


@pytest.mark.parametrize("ident", ["1", "CAST(NULL AS BIGINT)"])
def test_mixes_of_one_id_agree_whatever_the_partitions(spark, ident):
    df = spark.range(3000).select(F.expr(ident).alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 2900, F.repeat(F.lit(" x"), (F.col("id") % 9).cast("int"))).alias("text"), F.lit("s").alias("source"))
    assert taken(df.repartition(3)) == taken(df.repartition(11, "text"))


def test_repeated_rows_are_spread_in_mixes(spark):
    many = spark.range(200_000).select(F.lit(None).cast("long").alias("__id"), F.lit("s").alias("__source"), F.lit(3).cast("long").alias("size"))
    targets = spark.createDataFrame([("s", 100, 600_000, 600_000.0)], "source string, length long, source_size long, target double")
    placed = lay_out(many, targets, 200_000, 0)
    assert placed.agg(F.count("*"), F.countDistinct("__from"), F.min("__from"), F.max("__from")).first()[:] == (200_000, 200_000, 0, 599_997)
    mixed = mix_sources(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")))
    assert mixed.agg(F.sum("taken"), F.max("taken")).first()[:] == (90_000, 6)


def test_repeated_rows_are_spread_over_shards(spark):
    df = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    found = []
    for rows in (df.repartition(3), df.repartition(9)):
        per = ring_shards(rows, n_shards=8).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
        assert sum(r["n"] for r in per) == 200_000 and all(r["n"] == r["slots"] == r["last"] + 1 for r in per)
        assert max(r["n"] for r in per) <= 1.01 * 25_000 + 1 and len(per) == 8
        found.append(sorted(map(tuple, per)))
    assert found[0] == found[1]


def test_the_sample_of_labelled_rows_is_bounded(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).unionByName(spark.range(20).select((F.col("id") + 100).alias("doc_id"), F.lit("other words here").alias("text")))
    labels = spark.createDataFrame([(7, 1)] + [(100 + k, k % 2) for k in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_boost, "boost", lambda x, y, **_: seen.append(len(x)))
    quality_boost.train(docs, labels, bound=1000)
    assert seen == [21]


def test_copies_do_not_shrink_the_sample_of_texts(spark):
    docs = spark.range(200_000).select(F.concat(F.lit("text "), F.col("id") % 2000).alias("text"))
    assert text_sample(docs, "text", 20_000).count() == 2000
    assert 600 < text_sample(docs, "text", 1000).count() < 1500
    assert text_sample(docs.limit(0), "text", 10).count() == 0


TEXTS = ["abra cadabra abrac bracad", "cab bac abba dabba", "a bad cab had a drab abacab"]


def follow(model, context, letters):
    """Probabilities of each letter after ``context``."""
    out = []
    for c in letters:
        codes = np.array([ord(x) for x in context + c], dtype=np.uint32)
        out.append(float(np.exp(model.score(codes, np.arange(len(codes)))[-1, 0])))
    return np.array(out)


@pytest.mark.parametrize("room", [language_id.MODEL_BYTES, 2160, 1500, 960, 1])
def test_pruned_models_stay_distributions(spark, room):
    """What a cut takes from a context goes to its shorter ones: letters add up to 1, but for what unseen ones are left."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("lang", F.lit("x"))
    model = language_id.train(df, model_bytes=room)
    normal = [f"\x20{t}\x20" for t in TEXTS]
    letters = sorted(set("".join(normal)))
    single = follow(model, "#", letters).sum()
    for context in ("a", " a", "ab", "abr", " abr", "cab", "zzz"):
        assert single - 1e-5 <= follow(model, context, letters).sum() <= 1 + 1e-5, context


def test_ties_between_languages_go_to_the_first(spark):
    df = spark.createDataFrame([("one two three", lang) for lang in ("b", "a")], "text string, lang string")
    model = language_id.train(df)
    row = language_id.predict(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), model).first()
    assert row["lang_pred"] == "a" and row["score"] == pytest.approx(0.5)


ROWS = [(1, "the mit license applies here and permission is hereby granted", "en"), (2, None, "en"), (None, "password = abcdefghijklmnop", "en"), (4, "", None), (5, "one two three four five six seven eight nine ten eleven", "fr")]


@pytest.fixture(scope="module")
def doubled(spark):
    return spark.createDataFrame(ROWS * 2, "doc_id long, text string, lang string").repartition(5)


@pytest.fixture(scope="module")
def operators(spark, tiny):
    """Operators that judge each row by itself, by name."""
    from prismara.llm import secret_scan
    from prismara.llm.decontaminate import contamination
    from prismara.llm.fill_middle import fill_middle
    from prismara.llm.license_scan import scan_licenses
    from prismara.llm.quality_rules import judge_quality

    benchmark = spark.createDataFrame([("i", "one two three four five six seven eight nine ten"), ("i", "one two three four five six seven eight nine ten"), (None, "x"), ("j", None)], "item_id string, text string")
    return {
        "licenses": scan_licenses,
        "secrets": secret_scan.scan_secrets,
        "boost": lambda df: quality_boost.score_quality(df, quality_boost.train(df, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int"))),
        "rules": lambda df: judge_quality(df, keep=("doc_id", "text")),
        "contamination": lambda df: contamination(df, benchmark),
        "language": lambda df: language_id.predict(df, language_id.train(df)),
        "middle": fill_middle,
        "mix": lambda df: mix_sources(df.withColumn("source", F.lit("s"))).drop("taken"),
        "shards": lambda df: ring_shards(df, n_shards=2).drop("shard", "slot"),
    }


@pytest.mark.parametrize("name", ["licenses", "secrets", "boost", "rules", "contamination", "language", "middle", "mix", "shards"])
def test_repeated_rows_and_null_ids_fare_alike(doubled, operators, name):
    """Both copies of a row are there with equal results, and so is the row without an id."""
    found = Counter(repr(r.asDict(recursive=True)) for r in operators[name](doubled).collect())
    assert len(found) == len(ROWS) and set(found.values()) == {2}


def test_long_urls_are_judged_and_not_learned_from(spark, monkeypatch):
    from prismara.llm import url_filter

    rows = [(f"http://h{k}.example.com/{'x' * 5}", False, k % 2) for k in range(40)] + [(f"http://casino{k}.example.com/win", True, k % 2) for k in range(40)] + [("http://long.example.com/" + "y" * 100_000, False, 0)]
    seen = []
    real = url_filter._best_cut
    monkeypatch.setattr(url_filter, "_best_cut", lambda margin, rejected, times: (seen.append(len(margin)), real(margin, rejected, times))[1])
    url_filter.train(spark.createDataFrame(rows, "url string, rejected boolean, fold int"))
    assert seen == [80]


def test_url_models_learn_from_every_url(spark, monkeypatch):
    """A small ``bound`` changes neither the models nor, but for a cell's width, the threshold; rare contexts go first where grams do not fit."""
    import numpy as np

    from prismara.llm import url_filter

    rows = [(f"\x02{w}{k % 7}.example.com/{'ab' * (k % 5)}\x03", bad, k % 3) for bad, words in ((False, ["history", "garden", "music"]), (True, ["casino", "pills", "bets"])) for w in words for k in range(60)]
    df = spark.createDataFrame(rows, "url string, rejected boolean, fold int")
    whole, few = url_filter.train(df), url_filter.train(df, bound=5)
    for a, b in zip(whole.accepted + whole.rejected, few.accepted + few.rejected, strict=True):
        assert np.array_equal(a.key, b.key) and np.allclose(a.logp, b.logp) and np.array_equal(a.context, b.context)
    assert abs(whole.threshold - few.threshold) <= 1 / url_filter.CELLS
    small = url_filter.train(df, most_grams=700)
    for a, b in zip(whole.accepted + whole.rejected, small.accepted + small.rejected, strict=True):
        assert 0 < len(b.context) < len(a.context) and np.allclose(b.back, a.back[np.isin(a.context, b.context)])


def test_secret_formats_are_learned_from_every_text(spark):
    """All values count in the automata and all candidates in the thresholds; shared states lose no path of a frequent prefix."""
    import random

    from prismara.llm import secret_scan

    rng = random.Random(3)
    values = [f"key{rng.choice('ab')}-" + "".join(rng.choice("0123456789") for _ in range(14)) for _ in range(3000)]
    df = spark.createDataFrame([("assign", v) for v in sorted(set(values))] + [("hex", "0" * 300)], "kind string, value string")
    long, learned = sorted(secret_scan.learned_automata(df, 40, 256), key=lambda a: a.kind != "hex")
    assert sum(learned.stop) == len(set(values)) and all(learned.accepts(v) for v in values) and not any(learned.accepts(v[:-1]) for v in values[:50])
    assert sum(long.stop) == 0 and len(long.step) == 257
    tree = secret_scan.learned_automata(df.where("kind = 'assign'").limit(200), 400, 256)[0]
    assert tree.step == secret_scan.infer("assign", [r["value"] for r in df.where("kind = 'assign'").limit(200).collect()]).step
    seen = []
    real = secret_scan.threshold
    secret_scan.threshold = lambda good, bad: (seen.append((good.total(), bad.total())), real(good, bad))[1]
    try:
        texts = [(f"password = {v}",) for v in values] + [(f"a word like international{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]} here",) for k in range(6000)]
        secret_scan.learn(spark.createDataFrame(texts, "text string"))
    finally:
        secret_scan.threshold = real
    assert all(bad == 6000 for _, bad in seen) and max(good for good, _ in seen) > 500


def test_quality_counts_of_odd_white_space(spark):
    """Words, lines and symbols of texts that begin, end or consist of every kind of white space, no-break spaces being part of words."""
    import re

    from prismara.llm.quality_rules import count_statistics

    texts = ["", " ", "\n\n", "\t a\r\n a\x0b\n\x0c\n", "x" * 3 + "\n \n\n \n" + "x" * 3, "a b\n \n \n#*$%&|<> \\ ^ -", "  lead trail  \r", "  z"]
    rows = count_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x")), ("doc_id",)).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))


@pytest.mark.parametrize("most", [0, 700])
def test_rare_contexts_count_in_margins_however_many(spark, most):
    """What a broadcast model has no room for is added up in Spark: margins, threshold and verdicts are those of the whole models."""
    from prismara.llm import url_filter

    words = [(False, ["history", "garden", "music", "été\u0000x"]), (True, ["casino", "pills", "bets"])]
    rows = [(f"http://{w}{k % 7}{'abc'[k % 3] * (k % 4)}.example.com/{'ab' * (k % 5)}{w[::-1]}", bad) for bad, ws in words for w in ws for k in range(60)]
    labels = spark.createDataFrame(rows, "url string, rejected boolean")
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[::3])] + [(k, None) for k in range(30)] + [(900, "http://new.org/" + "xyz" * 20_000)], "page_id long, url string")
    whole, part = ({(r["page_id"], r["url"]): r for r in url_filter.filter_urls(pages, [], labels=labels, most_grams=n).collect()} for n in (1 << 18, most))
    assert whole.keys() == part.keys() and pages.columns == ["page_id", "url"]
    for key, row in whole.items():
        assert part[key]["margin"] == pytest.approx(row["margin"], abs=1e-8) and part[key]["verdict"] == row["verdict"]
    assert len({round(r["margin"], 6) for r in whole.values()}) > 50


@pytest.mark.parametrize(("room", "hot"), [(960, language_id.MODEL_BYTES), (2160, 240), (1, 0)])
def test_long_orders_count_in_languages_however_many(spark, monkeypatch, room, hot):
    """Orders that a broadcast model has no room for are added up in Spark, whether a token is frequent or rare."""
    known = [(t, "x") for t in TEXTS] + [("cadabra bad cab drab ab daba cabra " * 3, "y"), ("hadab abacab\tbrac, abba abra-cad", "y"), ("émile émilie " * 2, "z")]
    df = spark.createDataFrame(known, "text string, lang string")
    texts = [*TEXTS, "abra cad", "hadab bracad hadab", "émilie abba", "drab-cab'abba", "a" * 3000 + " cadabra", "abacabra" * 20, "ab", "1 2", "", None, "中文 abra"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string").repartition(3)
    whole = language_id.train(df)
    part = language_id.train(df, model_bytes=room)
    assert whole.rest is None and part.whole < language_id.ORDER
    expected, bare = ({r["doc_id"]: r for r in language_id.predict(rows, m).collect()} for m in (whole, language_id.replace(part, rest=None)))
    monkeypatch.setattr(language_id, "MODEL_BYTES", hot)
    found = language_id.predict(rows, part).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        want = expected[r["doc_id"]]
        assert r["lang_pred"] == want["lang_pred"] and r["cross_entropy"] == pytest.approx(want["cross_entropy"], abs=1e-5) and r["score"] == pytest.approx(want["score"], abs=1e-4)
    assert any(abs(bare[k]["cross_entropy"] - expected[k]["cross_entropy"]) > 0.01 for k in bare)
