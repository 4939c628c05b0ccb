"""Repair of the turn structure of conversations by min-plus products of 4x4 matrices.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. The automaton of that has four states
(start, after system, after user, after assistant), and each turn is a 4x4 matrix: the cheapest (cost, audit) that
leads from one state to another over that turn, turns inserted before it included. Costs add up, audits are
joined, and of equal costs the ASCII-least audit counts. Such products are associative, so a conversation's turns
are multiplied in chunks wherever they lie, and the chunks' products in a tree.

Of two audits of the same turns and cost none begins with the other, as what one has beyond the other could only be inserts,
which cost; so the least of two stays the least whatever follows, and a product loses no optimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: The white space of the contract, and the ends of a whole text.
SPACES, ENDS = " \t\n\x0b\f\r", (".", "!", "?")
#: Where a turn of each initial leads: (from, to) of the states start, after system, after user, after assistant.
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
FAN = 8

PACKED = T.StructType([
    T.StructField("conv", T.StringType()), T.StructField("pid", T.IntegerType()), T.StructField("no", T.IntegerType()),
    T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("copies", T.ArrayType(T.LongType())),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())),
    T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()), T.StructField("truncated", T.LongType()), T.StructField("illegal", T.LongType()),
])
PRODUCT = "conv string, at long, costs array<long>, audits array<string>"
DECIDED = "conv string, position long, edit string, new_role string, role string, digest binary"
ROWS = "roles array<string>, digests array<binary>, copies array<bigint>"
SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def product(a: Matrix, b: Matrix) -> Matrix:
    rows = []
    for row in a:
        new: list[Element] = []
        for j in range(4):
            best = None
            for left, right in zip(row, b, strict=True):
                if left is not None and right[j] is not None:
                    x = (left[0] + right[j][0], left[1] + right[j][1])
                    best = x if best is None or x < best else best
            new.append(best)
        rows.append(tuple(new))
    return tuple(rows)


def _matrix(entries: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(entries.get((i, j)) for j in range(4)) for i in range(4))


#: Inserts: any number of user and assistant turns between two states, as few as lead there.
CLOSURE = _matrix({(i, i): (0, "") for i in range(4)} | {(0, 2): (INSERT, "I"), (0, 3): (2 * INSERT, "II"), (1, 2): (INSERT, "I"), (1, 3): (2 * INSERT, "II"), (2, 3): (INSERT, "I"), (3, 2): (INSERT, "I")})


@lru_cache(maxsize=4096)
def turn(initial: str, fault: str, copies: int = 1) -> Matrix:
    """Inserts, then a turn's edits: kept, given another role or deleted. Further copies of a turn are duplicates and are deleted."""
    gone = copies - (0 if fault in ("blank", "duplicate") else 1)
    entries: dict[tuple[int, int], Element] = {(i, i): (DELETE * copies, "D" * copies) for i in range(4)}
    if gone < copies:
        extra = CUT_SHORT if fault == "truncated" else 0
        for name in "ua":
            entries |= {step: (REROLE + extra + DELETE * gone, "R" + "D" * gone) for step in STEPS[name]}
        entries |= {step: (KEEP + extra + DELETE * gone, "K" + "D" * gone) for step in STEPS.get(initial, ())}
    return product(CLOSURE, _matrix(entries))


def tree_product(matrices: Iterable[Matrix]) -> Matrix:
    level = list(matrices)
    while len(level) > 1:
        level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=65536)
def _short(kinds: tuple[tuple[str, str, int], ...]) -> Matrix:
    return tree_product(turn(*k) for k in kinds)


def chunk_matrix(kinds: list[tuple[str, str, int]]) -> Matrix:
    return _short(tuple(kinds)) if len(kinds) <= 8 else tree_product(turn(*k) for k in kinds)


def best(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from the start to where it may end."""
    m = product(m, CLOSURE)
    return min(x for x in (m[0][0], m[0][3]) if x is not None)


def _flat(m: Matrix) -> tuple[list[int | None], list[str | None]]:
    cells = [x for row in m for x in row]
    return [x and x[0] for x in cells], [x and x[1] for x in cells]


def _square(costs: list[int | None], audits: list[str | None]) -> Matrix:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(cells[i : i + 4]) for i in range(0, 16, 4))


def _packed(key: str, pid: int, no: int, rows: list[tuple]) -> tuple:
    kinds, counts, illegal, before = [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
    for _, _, role, _, copies, fault in rows:
        initial = role[:1]
        kinds.append((initial if initial in STEPS else "", fault or "", copies))
        if fault:
            counts[fault] += copies if fault in ("blank", "duplicate") else 1
        if fault not in ("blank", "duplicate"):
            counts["duplicate"] += copies - 1
        illegal += copies - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
        before = initial
    turns = [r[1] for r in rows if r[1] is not None]
    ends = (min(turns), max(turns), len(set(turns))) if turns else (None, None, 0)
    return (key, pid, no, [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], *_flat(chunk_matrix(kinds)), *ends, rows[0][2][:1], before, *counts.values(), illegal)


def _pack(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Runs of a conversation's rows, in their order, as one row each, of ``chunk`` turns at most."""
    pid, no, run = TaskContext.get().partitionId(), 0, []
    names = [f.name for f in PACKED.fields]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int32(), *(pa.list_(x) for x in (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string())), *[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for rows in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if run and (row[0] != run[0][0] or len(run) >= chunk):
                done.append(_packed(run[0][0], pid, no, run))
                run, no = [], no + 1
            run.append(row)
        if done:
            yield batch(done)
    if run:
        yield batch([_packed(run[0][0], pid, no, run)])


def _multiply(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["at"])
    costs, audits = _flat(tree_product(_square(r["costs"], r["audits"]) for r in rows))
    return pa.table({"conv": [rows[0]["conv"]], "at": [rows[0]["at"] // FAN], "costs": pa.array([costs], pa.list_(pa.int64())), "audits": pa.array([audits], pa.list_(pa.string()))})


def _reduced(parts: DataFrame, length: int) -> DataFrame:
    """Products of each conversation's chunks (conv, at, costs, audits), ``FAN`` neighbours at a time."""
    while length > 1:
        parts = parts.groupBy("conv", F.floor(F.col("at") / FAN).alias("over")).applyInArrow(_multiply, PRODUCT)
        length = -(-length // FAN)
    return parts


def _slices(audit: str, turns: list[int]) -> list[str]:
    """Parts of an audit, each over so many turns; inserts stand before the turn that follows, and last ones after all."""
    own = np.flatnonzero(np.frombuffer(audit.encode(), np.uint8) != ord("I"))
    ends = [0, *(int(own[n - 1]) + 1 for n in np.cumsum(turns))]
    ends[-1] = len(audit)
    return [audit[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _summed(parts: list[dict]) -> tuple[int, ...]:
    """gaps, blank, duplicate, truncated and illegal over a conversation's chunks in their order."""
    known = [p for p in parts if p["first_turn"] is not None]
    twice = sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - sum(p["turns"] for p in known) + twice if known else 0
    between = sum(a["end"] + b["start"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
    return gaps, *(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), sum(p["illegal"] for p in parts) + between


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMMARY of conversations, each with its chunks' counts and the product of their matrices; of those in one chunk the rows go on with it."""
    names, rest = [x.split()[0] for x in SUMMARY.split(", ")], [x.split()[0] for x in ROWS.split(", ")]
    for rows in batches:
        out = []
        for r in rows.select(["conv", "parts", "costs", "audits"]).to_pylist():
            cost, audit = best(_square(r["costs"], r["audits"]))
            out.append((r["conv"], *_summed(r["parts"]), cost, audit))
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.string() if i in (0, 7) else pa.int64()) for i in range(8)), *(rows.column(rows.schema.get_field_index(c)) for c in rest)], [*names, *rest])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's part of its conversation's audit, the turns kept before it, and whether the first one is a system's."""
    for rows in batches:
        out = []
        for r in rows.to_pylist():
            kept, opened = 0, (len(r["audit"]) - r["audit"].count("D")) % 2 == 1
            for p, edits in zip(r["places"], _slices(r["audit"], [p["n"] for p in r["places"]]), strict=True):
                out.append((p["pid"], p["no"], edits, kept, opened))
                kept += len(edits) - edits.count("D")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_()))], ["pid", "no", "edits", "kept", "opened"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DECIDED rows of the turns that stay and of the inserted ones."""
    names = [x.split()[0] for x in DECIDED.split(", ")]
    for rows in batches:
        out: list[tuple] = []
        for r in rows.to_pylist():
            at, i, copy = r["kept"], 0, 0
            for edit in r["edits"]:
                role = "assistant" if (at - r["opened"]) % 2 else "user"
                if edit == "I":
                    out.append((r["conv"], at, edit, role, None, None))
                elif edit != "D":
                    out.append((r["conv"], at, edit, role if edit == "R" else r["roles"][i], r["roles"][i], r["digests"][i]))
                at += edit != "D"
                if edit != "I":
                    copy += 1
                    if copy == r["copies"][i]:
                        i, copy = i + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary()))], names)


@dataclass
class Repair:
    """``summary``: a row a conversation with ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``.
    ``turns``: the repaired conversations, a row a turn with its ``position`` from 0, ``edit``, role and text."""

    summary: DataFrame
    turns: DataFrame


def repair_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = 1024) -> Repair:
    """Finds the cheapest edits that make conversations right, and makes them.

    Turns are taken by number, nulls first, ties by role, then by the text's SHA-256. Null roles and texts count as one space, and null
    conversations as one. A turn's first fault counts: blank, duplicate (role and text stand earlier) or truncated (its last
    character but white space is none of ``.!?``). Blank and duplicate turns must be deleted (2); others are kept (0), deleted or
    become the user's or the assistant's (1), and empty ones may be inserted (5). A truncated turn that stays adds 5. Equal costs: the ASCII-least audit.
    Rows that are the same in all four columns are counted, not listed, so any number of them is one row of work. An empty table gives empty results.
    Other columns are not read, and the results have none of them.

    Turns go by range of (conversation, turn) to tasks, which multiply runs of up to ``chunk``; a conversation over many tasks or chunks is joined
    by a tree of products. What grows in one task with a conversation is its audit, a character a turn. Tables that several steps read are written to the shared folder.
    """
    conv = F.coalesce(F.concat(F.lit("v"), F.col(conv_col).cast("string")), F.lit("n"))
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    named = rows.select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"), F.col(conv_col).alias("__id"))
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated").alias("fault")
    counted = materialise(named.select("conv", "turn", "role", "digest", fault).groupBy("conv", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("copies")))
    order = [F.col("turn").isNotNull(), F.col("turn")]
    place = F.struct(order[0].alias("known"), order[1].alias("turn"))
    seen = counted.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    judged = counted.join(seen, ["conv", "role", "digest"], "left")  # one row of ``seen`` a key; a hot key's turns are what AQE splits
    again = (F.col("fault").isNull() | (F.col("fault") != "blank")) & (place > F.col("first"))
    judged = judged.select("conv", "turn", "role", "digest", "copies", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))
    judged = materialise(judged)  # the ranges' bounds are drawn from it first
    keys = [F.col("conv"), *order, F.col("role"), F.col("digest")]
    packed = materialise(judged.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _pack(b, chunk), PACKED))
    discard(counted)
    discard(judged)
    return _assembled(packed, named)


def _assembled(packed: DataFrame, named: DataFrame) -> Repair:
    tasks = packed.groupBy("conv", "pid").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("low"))
    # a conversation has as many of these rows as tasks had turns of it
    by_task = tasks.groupBy("conv").agg(F.sum("n").alias("chunks"), F.sort_array(F.collect_list(F.struct("pid", "low", "n"))).alias("tasks")).where("chunks > 1")
    longest = by_task.agg(F.max("chunks")).first()[0] or 1
    before = F.aggregate(F.filter("tasks", lambda t: t["pid"] < F.col("pid")), F.lit(0).cast("long"), lambda s, t: s + t["n"])
    first = F.filter("tasks", lambda t: t["pid"] == F.col("pid"))[0]["low"]
    counts = F.struct("first_turn", "last_turn", "turns", "start", "end", "blank", "duplicate", "truncated", "illegal")
    rows = ["roles", "digests", "copies"]
    opened = (F.pmod(F.length(F.translate("audit", "D", "")), F.lit(2)) == 1).alias("opened")
    alone = packed if longest == 1 else packed.join(by_task.select("conv"), "conv", "left_anti")
    whole = alone.select("conv", F.array(counts).alias("parts"), "costs", "audits", *rows)
    if longest > 1:
        numbered = packed.join(by_task, "conv").select("conv", (before + F.col("no") - first).alias("at"), "pid", "no", "costs", "audits", "copies", counts.alias("part"))
        products = _reduced(numbered.select("conv", "at", "costs", "audits"), longest)
        listed = numbered.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p")).select("conv", F.transform("p", lambda x: x["part"]).alias("parts"))
        none = [F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in rows]
        whole = whole.unionByName(listed.join(products, "conv").select("conv", "parts", "costs", "audits", *none))
    summary = materialise(whole.mapInArrow(_whole, f"{SUMMARY}, {ROWS}"))
    cut = summary.where("roles IS NOT NULL").select("conv", *rows, F.col("audit").alias("edits"), F.lit(0).cast("long").alias("kept"), opened)
    if longest > 1:
        n = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c)
        places = numbered.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "pid", "no", n.alias("n")))).alias("places"))
        parts = places.join(summary.select("conv", "audit"), "conv").select("places", "audit").mapInArrow(_cut, "pid int, no int, edits string, kept long, opened boolean")
        cut = cut.unionByName(packed.join(parts, ["pid", "no"]).select("conv", *rows, "edits", "kept", "opened"))
    decided = materialise(cut.mapInArrow(_decide, DECIDED))
    texts = named.groupBy("conv", "role", "digest").agg(F.first("text").alias("text"))
    kept = decided.where("edit <> 'I'").join(texts, ["conv", "role", "digest"])
    turns = kept.unionByName(decided.where("edit = 'I'").withColumn("text", F.lit(""))).select("conv", "position", "edit", F.col("new_role").alias("role"), "text")
    strip = F.when(F.col("conv") != "n", F.expr("substring(conv, 2)")).cast(named.schema["__id"].dataType).alias("conv_id")
    return Repair(summary.select(strip, *[x.split()[0] for x in SUMMARY.split(", ")][1:]), turns.select(strip, "position", "edit", "role", "text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, key, started = None, None, False
    for rows in batches:
        done = []
        for conv, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if not started or conv != key:
                if started:
                    done.append((key, state.hexdigest()))
                state, key, started = hashlib.sha256(f"{role}:{text}".encode()), conv, True
            else:
                state.update(f"\n{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], rows.column(0).type if i == 0 else pa.string()) for i in range(2)], ["conv_id", "repaired_sha256"])
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([key], rows.column(0).type), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])


def turn_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines. A digest is a chain, so one task reads a conversation's turns in their order; it holds one batch of them."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """The contract's damage: by ``crc32(conv_id:turn) % 20`` a row is dropped (0), emptied (1), loses its ``.!?`` (2), stands twice (3) or becomes the user's (4). Nulls are one space, but for the turn's number."""
    blank = F.lit(" ")
    spot = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(spot.cast("binary")), F.lit(20))
    text = F.coalesce("text", blank)
    hurt = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("__kind"))
    return hurt.where("__kind <> 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("__kind") == 3, 2).otherwise(1)))).drop("__kind", "__copy")
