"""Conversation repair: audits against a best-first search, chunks and tasks that split conversations, odd rows."""

import hashlib
import heapq
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prismara.llm.turn_repair import best, chunk_matrix, damaged, product, repair_turns, tree_product, turn, turn_digests

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """Least (cost, audit, repaired lines) of (initial, must go, extra, role, text) rows, by best-first search over edits."""
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        for name in ("user", "assistant"):
            if (state, name[0]) in NEXT:
                heapq.heappush(queue, (cost + 5, audit + "I", i, NEXT[state, name[0]], (*lines, f"{name}:")))
        if i < len(rows):
            initial, gone, extra, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
            if not gone:
                if (state, initial) in NEXT:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, NEXT[state, initial], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if (state, name[0]) in NEXT:
                        heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, NEXT[state, name[0]], (*lines, f"{name}:{text}")))


def expected(rows):
    """The contract's columns of one conversation's (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, judged, count = set(), [], defaultdict(int)
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        judged.append((role[:1], fault in ("blank", "duplicate"), 5 if fault == "truncated" else 0, role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
    cost, audit, lines = cheapest(judged)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def found(repair):
    digest = {r[0]: r[1] for r in turn_digests(repair.turns).collect()}
    return {r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], digest.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in repair.summary.collect()}


def grouped(rows):
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(rest)
    return {k: expected(v) for k, v in by.items()}


def test_every_short_sequence():
    faults = [("", False, 0), ("blank", True, 0), ("duplicate", True, 0), ("truncated", False, 5)]
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in faults]
    for n in range(4):
        for row in itertools.product(kinds, repeat=n):
            want = cheapest([(i, gone, extra, "", "") for i, (_, gone, extra) in row])
            got = best(chunk_matrix([(i, f, 1) for i, (f, _, _) in row])) if row else (0, "")
            assert got == want[:2], row


def test_products_are_associative():
    draw = random.Random(3)
    for _ in range(200):
        kinds = [(draw.choice("sua"), draw.choice(["", "", "truncated", "blank", "duplicate"]), draw.choice([1, 1, 3])) for _ in range(draw.randint(3, 40))]
        cut = draw.randint(1, len(kinds) - 1)
        assert product(tree_product(turn(*k) for k in kinds[:cut]), tree_product(turn(*k) for k in kinds[cut:])) == tree_product(turn(*k) for k in kinds)


def test_copies_of_a_turn_are_single_duplicates():
    for kind in itertools.product("sua", ["", "truncated", "blank", "duplicate"]):
        rest = "blank" if kind[1] == "blank" else "duplicate"
        for end in ([], [("a", "", 1)], [("u", "", 1), ("a", "", 1)]):
            assert best(chunk_matrix([(*kind, 4), *end])) == best(chunk_matrix([(*kind, 1), *[(kind[0], rest, 1)] * 3, *end]))


def random_rows(seed, conversations, longest):
    draw, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "cut", "", " \n", "Why? ", "é.", None, "end ", "ok.", "more.", "some?"]
    for conv in range(conversations):
        for t in range(draw.randint(1, longest)):
            text = draw.choice(texts) if draw.random() < 0.5 else f"turn {t}."
            rows.append((conv if conv else None, draw.choice([t, t, t, t + 1, None]), draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), text))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_conversations_match_search(spark, chunk):
    rows = random_rows(7, 60, 12)
    assert found(repair_turns(spark.createDataFrame(rows, SCHEMA), chunk=chunk)) == grouped(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}." if t % 7 else "cut") for t in range(2500)] + random_rows(5, 20, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(repair_turns(spark.createDataFrame(rows, SCHEMA).repartition(7), chunk=20)) == grouped([r for r in rows if r[0] != 1] + [r for r in rows if r[0] == 1])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_are_counted(spark):
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    repair = repair_turns(many.unionByName(spark.createDataFrame([(1, 1, "assistant", "So it is.")], SCHEMA)))
    row = repair.summary.first()
    assert (row["duplicate"], row["cost"], row["illegal"], row["gaps"]) == (99_999, 199_998, 99_999, 0)
    assert row["audit"] == "K" + "D" * 99_999 + "K"
    assert [tuple(r) for r in repair.turns.orderBy("position").collect()] == [(1, 0, "K", "user", "Same."), (1, 1, "K", "assistant", "So it is.")]


def test_turns_with_extra_columns_and_text_ids(spark):
    rows = spark.createDataFrame([("x", 0, "user", "Hi.", 1, "z"), ("x", 1, "user", "Yes.", 2, "z"), (None, 5, "assistant", "Long " * 300_000 + ".", 3, "z")], "conv_id string, turn long, role string, text string, cost int, conv string")
    repair = repair_turns(rows)
    got = {r["conv_id"]: (r["audit"], r["cost"]) for r in repair.summary.collect()}
    assert got == {"x": ("KR", 1), None: ("D", 2)}
    assert sorted(tuple(r) for r in repair.turns.collect()) == [("x", 0, "K", "user", "Hi."), ("x", 1, "R", "assistant", "Yes.")]


def test_turns_of_nothing(spark):
    repair = repair_turns(spark.createDataFrame([], SCHEMA))
    assert repair.summary.count() == repair.turns.count() == turn_digests(repair.turns).count() == 0


def test_damage(spark, tiny):
    from zlib import crc32

    rows = [(1, t, "assistant", "One. Two! Three?") for t in range(200)] + [(None, None, None, None), (2, None, "user", "Hm?")]
    want = []
    for c, t, r, x in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if kind == 4 else " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else x.translate(str.maketrans("", "", ".!?")) if kind == 2 else x
        want += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect())
