"""The corpus pipeline: each stage on its own input against a plain version, then the whole run."""

from collections import Counter

import pytest

import corpus_pipeline as P
from prismara.llm.common import materialise, table
from prismara.llm.decontaminate import contamination
from prismara.llm.jaccard_join import jaccard_components
from prismara.llm.mixing import mix_sources
from test_operators import groups_truth, leaks_truth


@pytest.fixture(scope="module")
def steps(spark, tiny):
    docs = table(spark, tiny, "documents")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], tiny)))
    return out


def test_stages_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_language_stage_keeps_clean_documents(steps):
    assert steps[1].count() >= 0.95 * steps[0].count()


def test_near_copies_leave_one_a_group(steps):
    want = {r["component_id"] for r in jaccard_components(steps[1]).collect()}
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted(want)


def test_leaks_go(spark, tiny, steps):
    found = contamination(steps[2], table(spark, tiny, "benchmark"))
    assert {r["doc_id"] for r in steps[3].collect()} == {r["doc_id"] for r in found.where("NOT contaminated").collect()}


def test_mix_repeats_documents(steps):
    want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mix_sources(steps[3]).collect() if r["size"]}
    got = Counter(r["doc_id"] for r in steps[4].collect())
    assert got == {d: n for d, n in want.items() if n}


def test_run_places_every_row(spark, tiny, steps):
    rows = P.run(spark, tiny).collect()
    assert len(rows) == steps[4].count() == steps[5].count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- every stage, on a table of its own, against plain Python -------------------------------------

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, shard string, score int, hit_words int, accepted string"


def made_rows(base):
    """Documents of two languages with copies, near copies, leaks, nulls, repeated rows, odd scripts and columns called like the operators' own."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in base if r["lang"] in ("en", "de")][:150]
    some = [r for r in rows if r[1] and len(r[1].split()) > 60][:20]
    rows += [(5000 + i, r[1], r[2], r[3]) for i, r in enumerate(some[:8])]  # copies
    rows += [(5100 + i, r[1] + " und", r[2], None) for i, r in enumerate(some[8:14])]  # near copies
    rows += [rows[0], rows[0], (None, some[15][1] + " with some more words at its very end now", "en", "s1"), (None, None, "en", "s1"), (6001, "", None, "s2"), (6002, "1234 5678", "en", None)]
    rows += [(6010 + i, "Быстрая коричневая лиса прыгает через ленивую собаку номер " + "да " * i, None, "s1") for i in range(3)]
    return [(d, t, lang, src, len(t or ""), "big", "aim", "old", 7, 9, "yes") for d, t, lang, src in rows]


@pytest.fixture(scope="module")
def own(spark, tiny, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("own"))
    base = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").orderBy("item_id")
    rows = made_rows(base)
    item = next(r["text"] for r in bench.collect() if len((r["text"] or "").split()) >= 12)
    rows.append((7000, "some words first " + item + " and some after", "en", "s3", 0, "big", "aim", "old", 7, 9, "yes"))
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    out = [table(spark, folder, "documents")]
    for _, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], folder)))
    return folder, [[tuple(r) for r in df.collect()] for df in out], [df.columns for df in out]


def test_own_columns_are_kept(own):
    _, rows, columns = own
    assert all(c == columns[0] for c in columns[1:-1])
    assert all(r[5:] == ("big", "aim", "old", 7, 9, "yes") for step in rows[1:-1] for r in step)


def test_own_language_stage(own):
    _, rows, _ = own
    gone = Counter(rows[0]) - Counter(rows[1])
    assert not Counter(rows[1]) - Counter(rows[0])
    wordless = [r for r in rows[0] if not any(c.isalpha() for c in r[1] or "")]
    strange = [r for r in rows[0] if r[0] is not None and 6010 <= r[0] < 6020]
    assert set(wordless + strange) <= set(gone)
    assert sum(gone.values()) <= len(wordless) + len(strange) + 2


def test_own_near_copies(own):
    _, rows, _ = own
    texts = {i: r[1] for i, r in enumerate(sorted(set(rows[1]), key=str))}
    group = {i: c for i, (_, c) in groups_truth(texts).items()}
    order = sorted(set(rows[1]), key=str)
    first = {}
    for i, r in enumerate(order):
        first.setdefault(group[i], []).append(r)
    want = {min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in first.values()}
    assert Counter(rows[2]) == Counter(want)


def test_own_leaks(spark, own):
    folder, rows, _ = own
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = leaks_truth({i: r[1] for i, r in enumerate(rows[2])}, items)
    assert Counter(rows[3]) == Counter(r for i, r in enumerate(rows[2]) if not found[i][4])
    assert not any(r[0] == 7000 for r in rows[3])


def test_own_mix(own):
    """Each source's words come near its target, by whole documents; nothing more than twice."""
    _, rows, _ = own
    size = Counter()
    for r in rows[3]:
        size[r[3]] += len((r[1] or "").split())
    taken, times = Counter(), Counter(rows[4])
    for r in rows[4]:
        taken[r[3]] += len(r[1].split())
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9
    for _ in range(200):  # the level at which the stopped and the open targets add up
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * size[s], level * weight[s]) for s in names) < 1.5 * sum(size.values()) else (low, level)
    longest = max(len(r[1].split()) for r in rows[3] if r[1])
    assert all(abs(taken[s] - min(2 * size[s], level * weight[s])) <= longest for s in names)
    assert all(n <= 2 for r, n in times.items()) and set(rows[4]) <= set(rows[3])


def test_own_shards(own):
    _, rows, _ = own
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in rows[5]) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 16) for r in rows[4])
    slots = {}
    for r in rows[5]:
        slots.setdefault(r[2], []).append(r[3])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_empty_tables_run_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_workers_give_freed_memory_back():
    """What a task freed below memory that is still in use does not stay with the worker for the tasks after it."""
    import numpy as np

    from prismara.llm.common import give_back

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def task():
        many = [np.ones(1000) for _ in range(20_000)]
        pins.append(np.ones(1000))
        most.append(resident())
        del many
        yield 1

    pins, most = [], []
    assert list(give_back(task())) == [1]
    assert resident() < most[0] - 100_000_000


def test_language_stage_judges_by_long_orders_however_many(spark, monkeypatch):
    """Letters of a known language in another order are rejected, also where only single characters have room in a broadcast model."""
    import zlib

    from prismara.llm import language_id

    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    strange = next(k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2)
    words = "the cat sat on that mat and a dog ate the hat near the oak tree".split()
    rows = [(k, " ".join(words[(k + i * i) % len(words)] for i in range(30)), "en") for k in ids]
    rows.append((strange, " ".join(w[::-1] for w in rows[0][1].split()), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda df, **_: train(df, model_bytes=1))
    kept = P.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(ids)
