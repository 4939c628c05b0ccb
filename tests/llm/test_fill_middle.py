"""Fill-in-the-middle: bitvectors against plain counting, cuts against slicing, exact rebuilding, odd rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismara.llm.fill_middle import Bitvector, cuts_of, fill_middle, restored

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no id"), (5, "<<P"), (6, "é🙂<S"), (7, "x<S>y"), (8, "🙂" * 300_000), (9, "ab\x00c"), (10, "\n\n"), (11, "<P"), (12, ">" * 700)]


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_rank_and_select(size):
    flags = np.random.default_rng(size).random(size) < 0.4
    bits, ones = Bitvector(flags), np.flatnonzero(flags)
    assert bits.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(flags).tolist()]
    assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=20))
def test_cuts_are_those_of_slicing(rows):
    raw = [t.encode() for t, _, _ in rows]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    n, first, second, one, two = cuts_of(np.frombuffer(b"".join(raw), np.uint8), offs, *(np.array([r[k] for r in rows], np.int64) for k in (1, 2)))
    for i, (text, x, y) in enumerate(rows):
        a, b = sorted((x % (len(text) + 1), y % (len(text) + 1)))
        assert (n[i], first[i], second[i]) == (len(text), a, b)
        assert raw[i][: one[i]].decode() == text[:a] and raw[i][one[i] : two[i]].decode() == text[a:b]


def test_outputs_match_slicing(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    out = fill_middle(docs)
    rows = out.select("*", restored(out["output"], out["form"]).alias("back")).collect()
    want = sorted(repr((i, *plain(i, t), t or "")) for i, t in docs.collect())
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"])) for r in rows) == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_other_shares_and_clashing_columns(spark):
    rows = spark.createDataFrame([(k, f"text number {k}", "kept", k) for k in range(200)], "doc_id long, text string, form string, other long")
    out = fill_middle(rows, rewritten=100, suffix_first=100, seed=2)
    assert out.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["form"] for r in out.collect()} == {"spm"}
    assert out.where(restored(out["output"], out["form"]) != out["text"]).count() == 0
    renamed = fill_middle(rows.withColumnRenamed("text", "output"), text_col="output", rewritten=0)
    assert {(r["form"], r["n"]) for r in renamed.where("doc_id < 10").collect()} == {("plain", 13)}


def test_middle_of_nothing(spark):
    assert fill_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
