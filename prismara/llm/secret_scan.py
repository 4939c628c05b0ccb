"""Secret scan: fixed patterns, and formats inferred from labelled credentials.

For each kind of labelled credential a prefix tree is built from examples, and states of one depth are
merged where their continuations are statistically compatible (Hoeffding bound on every symbol and the
end, down both subtrees), which gives a probabilistic automaton that knows a format's letters, length and
end. States of different depths are never merged: with random letters their continuations look alike,
and the length would be lost. Every candidate of a text is scored by every automaton: log-likelihood
against a model of ordinary text, a character; each automaton has a threshold set on credentials kept
back and on ordinary candidates.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytekernel import slices
from .common import discard, materialise, modest_batches

#: The base patterns of the contract, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: What may be a credential: a run of these characters, or its parts between slashes.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST = 16

#: The automata's symbols; other characters are never in a candidate or an assigned value.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=.-"
PLACE = {c: i for i, c in enumerate(SYMBOLS)}
EDGE = len(SYMBOLS)
_PLACES = np.full(256, EDGE)
_PLACES[list(SYMBOLS.encode())] = np.arange(EDGE)
#: Classes of symbols: letters that hexadecimal digits use are told from others; every sign is its own.
CLASS_OF = [*[0] * 10, *[1] * 6, *[2] * 20, *[3] * 6, *[4] * 20, *range(5, 11)]
CLASS_SIZE = [CLASS_OF.count(k) for k in range(11)]
#: Nats that each character beyond a format, or missing to its end, costs.
OFF = 16.0
#: Kinds with fewer examples have no automaton. Cells a unit of score, in which the thresholds' counts are taken.
LEAST_EXAMPLES, CELLS = 10, 1024


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    # a run of hexadecimal digits is matched whole, so asking for its length beforehand changes nothing
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


@dataclass
class Automaton:
    """Edges (to, count) by state and symbol, and how many examples end in a state; state 0 is the start."""

    kind: str
    step: list[dict[str, tuple[int, int]]]
    stop: list[int]
    threshold: float = math.inf
    #: by state and symbol: log-probability and next state, -1 beyond the format; the end's log-probability
    logp: list[list[float]] = field(default_factory=list)
    to: list[list[int]] = field(default_factory=list)
    end: list[float] = field(default_factory=list)
    missing: list[int] = field(default_factory=list)  # symbols from each state to the nearest end

    def smoothed(self, weight: float = 5.0) -> Automaton:
        """Symbols that a state has not seen share their class's probability and go where most of the class, or of all, goes."""
        for out, stop in zip(self.step, self.stop, strict=True):
            total = stop + sum(n for _, n in out.values())
            by_class: list[Counter[int]] = [Counter() for _ in CLASS_SIZE]
            for c, (to, n) in out.items():
                by_class[CLASS_OF[PLACE[c]]][to] += n
            seen = [sum(x.values()) for x in by_class]
            most = lambda x: min(x, key=lambda t: (-x[t], t)) if x else -1
            anywhere = most(sum(by_class, Counter()))
            main = [most(x) if x else anywhere for x in by_class]
            logp, to = [], []
            for c, k in zip(SYMBOLS, CLASS_OF, strict=True):
                spread = (seen[k] + 0.1) / (total + 0.1 * len(CLASS_SIZE)) / CLASS_SIZE[k]
                target, n = out.get(c, (main[k], 0))
                logp.append(math.log((n + weight * spread) / (total + weight)))
                to.append(target)
            self.logp.append(logp)
            self.to.append(to)
            self.end.append(math.log((stop + 0.01) / (total + 1)))
            self.missing.append(0)
        for state in range(len(self.step) - 1, -1, -1):  # states are numbered by depth
            if not self.stop[state]:
                self.missing[state] = 1 + min((self.missing[to] for to, _ in self.step[state].values()), default=0)
        return self

    def gain(self, symbols: list[int], plain: list[float]) -> float:
        """Log-likelihood over ``plain`` (of each symbol and the end), a character; each symbol beyond the format, or missing, loses OFF."""
        state, total = 0, 0.0
        for i, c in enumerate(symbols):
            after = self.to[state][c]
            total += self.logp[state][c] - plain[i] if after >= 0 else -OFF * (len(symbols) + 1 - i)
            if after < 0:
                return total / (len(symbols) + 1)
            state = after
        return (total + self.end[state] - plain[-1] - OFF * self.missing[state]) / (len(symbols) + 1)

    def accepts(self, s: str) -> bool:
        """Whether the examples' own edges spell the string and end there."""
        state = 0
        for c in s:
            if c not in self.step[state]:
                return False
            state = self.step[state][c][0]
        return self.stop[state] > 0


def infer(kind: str, examples: list[str], alpha: float = 0.05) -> Automaton:
    """Automaton of the examples: their prefix tree, its states merged depth by depth where compatible."""
    step: list[dict[str, tuple[int, int]]] = [{}]
    stop, total = [0], [0]
    for s, times in sorted(Counter(examples).items()):
        state = 0
        total[0] += times
        for c in s:
            to, n = step[state].get(c, (len(step), 0))
            if to == len(step):
                step.append({})
                stop.append(0)
                total.append(0)
            step[state][c] = (to, n + times)
            state = to
            total[state] += times
        stop[state] += times
    return merged(kind, step, stop, total, alpha)


def merged(kind: str, step: list[dict[str, tuple[int, int]]], stop: list[int], total: list[int], alpha: float = 0.05) -> Automaton:
    """Automaton of states that each have one depth, the start first; states of a depth are merged where compatible."""
    width = math.sqrt(0.5 * math.log(2 / alpha))
    into = list(range(len(step)))

    def now(state: int) -> int:
        while into[state] != state:
            into[state] = state = into[into[state]]
        return state

    def compatible(a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            bound = width * (1 / math.sqrt(total[a]) + 1 / math.sqrt(total[b]))
            if bound >= 1:
                continue  # nor can anything below tell them apart: there are fewer examples still
            if abs(stop[a] / total[a] - stop[b] / total[b]) > bound:
                return False
            for c in step[a].keys() | step[b].keys():
                (ta, na), (tb, nb) = step[a].get(c, (-1, 0)), step[b].get(c, (-1, 0))
                if abs(na / total[a] - nb / total[b]) > bound:
                    return False
                if na and nb:
                    todo.append((now(ta), now(tb)))
        return True

    def fold(a: int, b: int) -> None:
        """State b and what lies below it go into a."""
        todo = [(a, b)]
        while todo:
            a, b = map(now, todo.pop())
            if a == b:
                continue
            into[b] = a
            stop[a] += stop[b]
            total[a] += total[b]
            for c, (tb, nb) in step[b].items():
                if c in step[a]:
                    ta, na = step[a][c]
                    step[a][c] = (ta, na + nb)
                    todo.append((ta, tb))
                else:
                    step[a][c] = (tb, nb)

    kept, states = [0], [0]
    while kept:
        edges = sorted(((total[now(to)], parent, c, to) for parent in kept for c, (to, _) in step[parent].items()), key=lambda e: (-e[0], e[1], e[2]))
        kept = []
        for *_, child in edges:
            child = now(child)
            if child in kept:
                continue
            same = next((r for r in kept if compatible(r, child)), None)
            if same is None:
                kept.append(child)
            else:
                fold(same, child)
        states += kept
    place = {s: i for i, s in enumerate(states)}
    return Automaton(kind, [{c: (place[now(t)], n) for c, (t, n) in step[s].items()} for s in states], [stop[s] for s in states]).smoothed()


def seeds() -> dict[str, list[str]]:
    """Labelled credentials made by rule from published formats: a prefix and random characters of an alphabet."""
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    #: Kind, prefix, alphabet, length of the random part.
    formats = [
        ("access-key", "AKIA", up + digits, 16),
        ("hex-40", "", "0123456789abcdef", 40),
        ("hex-32", "", "0123456789abcdef", 32),
        ("forge-token", "ghp_", low + up + digits, 36),
        ("live-key", "sk_live_", low + up + digits, 24),
        ("chat-token", "xoxb-", digits, 24),
        ("maps-key", "AIza", low + up + digits + "_-", 35),
        ("base64-40", "", low + up + digits + "+/", 40),
    ]
    rng = random.Random(7)
    return {kind: [prefix + "".join(rng.choice(alphabet) for _ in range(n)) for _ in range(200)] for kind, prefix, alphabet, n in formats}


@dataclass
class Formats:
    """The automata and the model of ordinary text: log-probabilities of a symbol after another, a run's start and end last."""

    automata: list[Automaton]
    plain: np.ndarray
    known: dict[str, str | None] = field(default_factory=dict)

    def gains(self, s: str) -> list[float]:
        """Of a candidate, by each automaton."""
        symbols = [PLACE[c] for c in s]
        plain = self.plain[[EDGE, *symbols], [*symbols, EDGE]].tolist()
        return [a.gain(symbols, plain) for a in self.automata]

    def kind_of(self, s: str) -> str | None:
        """Kind of the automaton that takes a candidate for a credential by the largest excess over its threshold."""
        if s not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            over = [(g - a.threshold, a.kind) for g, a in zip(self.gains(s), self.automata, strict=True)]
            best = max(over, default=(-1.0, ""))
            self.known[s] = best[1] if best[0] > 0 else None
        return self.known[s]


def count_pairs(texts: list[str]) -> np.ndarray:
    """Counts of neighbouring symbols, of [EDGE + 1, EDGE + 1]; everything else is an edge, and edges in a row are none."""
    at = np.concatenate(([EDGE], _PLACES[np.frombuffer("\n".join(texts).encode(), np.uint8)], [EDGE]))
    out = np.bincount(at[:-1] * (EDGE + 1) + at[1:], minlength=(EDGE + 1) ** 2).reshape(EDGE + 1, EDGE + 1)
    out[EDGE, EDGE] = 0
    return out


def plain_model(counts: np.ndarray) -> np.ndarray:
    """Bigram model of counted pairs; a tenth is spread evenly, as ordinary text may hold any name or number."""
    overall = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * len(counts))
    return np.log(0.9 * (counts + 100 * overall) / (counts.sum(axis=1, keepdims=True) + 100) + 0.1 / len(counts))


def fit(examples: dict[str, list[str]], pairs: np.ndarray, ordinary: list[str]) -> Formats:
    """Automata of the labelled credentials and their thresholds (``threshold``). Of each kind every fifth example is kept back."""
    formats = Formats([], plain_model(pairs))
    bad = sorted(set(ordinary))
    for kind, values in sorted(examples.items()):
        learned, held = parted(values)
        if len(learned) + len(held) < LEAST_EXAMPLES:
            continue
        automaton = infer(kind, learned)
        alone = Formats([automaton], formats.plain)
        automaton.threshold = threshold(Counter(alone.gains(v)[0] for v in held), Counter(alone.gains(v)[0] for v in bad))
        formats.automata.append(automaton)
    return formats


def parted(values: list[str]) -> tuple[list[str], list[str]]:
    """The different values to learn from, and every fifth one, kept back."""
    values = sorted({v for v in values if v and all(c in PLACE for c in v)}, key=lambda v: (hash_of(v), v))
    return [v for i, v in enumerate(values) if i % 5], values[::5]


def threshold(good: Counter[float], bad: Counter[float]) -> float:
    """The cut between two classes' scores, given as (score: how many).

    It lies midway between the lowest ``good`` score, that of credentials kept back, but a twentieth and the highest ``bad``
    one, of ordinary candidates, but a hundredth, or three, which may be credentials that nobody has labelled; where these overlap, at the latter.
    It is 0 at least: a credential must be likelier by its format than as text.
    """

    def ranked(scores: Counter[float], place: int, down: bool) -> float:
        for score in sorted(scores, reverse=down):
            place -= scores[score]
            if place < 0:
                return score
        raise IndexError(place)

    n_good, n_bad = good.total(), bad.total()
    low = ranked(good, n_good // 20, False)
    aside = max(3, n_bad // 100)
    high = max(0.0, ranked(bad, aside, True)) if n_bad > aside else 0.0
    return max(high, (low + high) / 2)


def hash_of(s: str) -> int:
    """A fixed order that does not follow the alphabet."""
    return int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big")


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of the runs that may be credentials, each before its parts between slashes."""
    for m in CANDIDATE.finditer(text):
        yield m.start(), m.end()
        if "/" in m[0]:
            at = m.start()
            for part in m[0].split("/"):
                if len(part) >= LEAST:
                    yield at, at + len(part)
                at += len(part) + 1


def outside(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Candidates that overlap no base span."""
    taken = sorted((s, e) for _, s, e in base)
    i, reach = 0, 0
    for s, e in candidates(text):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        # spans that begin before this candidate's end: none of them may reach beyond its start
        if reach <= s:
            yield s, e


def all_spans(text: str, formats: Formats) -> list[tuple[str, int, int]]:
    """Base spans, and candidates outside them that an automaton takes for a credential."""
    base = base_spans(text)
    more: list[tuple[str, int, int]] = []
    for s, e in outside(text, base):
        if not (more and s < more[-1][2]) and formats.kind_of(text[s:e]):
            more.append(("format", s, e))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches: Iterator[pa.RecordBatch], formats: Formats) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        at = whole.schema.get_field_index("__text")
        for batch, _, _ in slices(whole, "__text"):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t or "", formats)] for t in batch.column(at).to_pylist()]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, span)], [*(n for n in batch.schema.names if n != "__text"), "secrets"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (kind, value, n): values of base matches, ordinary candidates, and pairs of neighbouring symbols outside base spans."""
    for whole in batches:
        for batch, _, _ in slices(whole, "text"):
            found: Counter[tuple[str, str]] = Counter()
            plain = []
            for t in batch.column("text").to_pylist():
                t = t or ""
                base = base_spans(t)
                for kind, s, e in base:
                    found[kind, ASSIGN.match(t, s)[2] if kind == "assign" else t[s:e]] += 1
                for s, e in outside(t, base):
                    found["ordinary", t[s:e]] += 1
                if not base:
                    plain.append(t)
            pairs = count_pairs(plain)
            for a, b in zip(*(x.tolist() for x in np.nonzero(pairs)), strict=True):
                found["pair", f"{a},{b}"] = int(pairs[a, b])
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["kind", "value", "n"])


def text_sample(docs: DataFrame, text_col: str, bound: int) -> DataFrame:
    """About ``bound`` different texts (all, where there are fewer), drawn by hash: a text's copies count once."""
    n = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col)).distinct().count()
    share = min(1 << 30, (bound << 30) // max(1, n))
    return docs.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < share).select(F.col(text_col).alias("text")).distinct()


def _path(value: str, frequent: frozenset[str], longest: int) -> list[str]:
    """The states a value goes through: its prefixes while they are frequent, then depth and symbol."""
    out, known = [""], True
    for d in range(1, min(len(value), longest) + 1):
        known = known and value[:d] in frequent
        out.append(value[:d] if known else f"{d}:{value[d - 1]}")  # no value holds a colon
    return out


def _edges(batches: Iterator[pa.RecordBatch], frequent: dict[str, frozenset[str]], longest: int) -> Iterator[pa.RecordBatch]:
    """(kind, value) -> (kind, depth, state, symbol, to, n): how many values take each edge, or end, where ``to`` is null."""
    for batch in batches:
        found: Counter[tuple[str, int, str, str, str | None]] = Counter()
        for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True):
            path = _path(value, frequent[kind], longest)
            found.update((kind, d, path[d], value[d], path[d + 1]) for d in range(len(path) - 1))
            found[kind, len(path) - 1, path[-1], "" if len(value) <= longest else "on", None] += 1
        rows = [{"kind": k, "depth": d, "state": a, "symbol": c, "to": b, "n": n} for (k, d, a, c, b), n in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("depth", pa.int32()), ("state", pa.string()), ("symbol", pa.string()), ("to", pa.string()), ("n", pa.int64())]))


def _gains(batches: Iterator[pa.RecordBatch], formats: Formats) -> Iterator[pa.RecordBatch]:
    """(kind, value) -> (kind, ordinary, cell, n): of credentials the score by their own automaton, of ordinary candidates by each one, in cells."""
    for batch in batches:
        found: Counter[tuple[str, bool, int]] = Counter()
        for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True):
            for a, gain in zip(formats.automata, formats.gains(value), strict=True):
                if kind in ("ordinary", a.kind):
                    found[a.kind, kind == "ordinary", round(gain * CELLS)] += 1
        rows = [{"kind": k, "ordinary": o, "cell": c, "n": n} for (k, o, c), n in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("ordinary", pa.bool_()), ("cell", pa.int64()), ("n", pa.int64())]))


def learned_automata(values: DataFrame, own: int, longest: int) -> list[Automaton]:
    """An automaton of each kind of (kind, value), whose rows differ, from counts over all of them.

    A prefix that one in ``own`` of its kind's values begin with is a state of its own; those below share a state
    with others of their depth and last symbol, so that a depth has at most ``own`` states and one a symbol. With up to ``own`` values
    this is their prefix tree. Of a value of more than ``longest`` characters the beginning counts, and no end.
    """
    totals = {r[0]: r[1] for r in values.groupBy("kind").agg(F.count(F.lit(1))).collect()}  # a row a kind
    each = values.select("kind", F.expr(f"explode(transform(sequence(1, least({longest}, length(value))), d -> left(value, d)))").alias("prefix"))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n / own)) for k, n in totals.items()], F.lit(math.inf))
    common = each.groupBy("kind", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("kind", "prefix")
    by_kind: dict[str, set[str]] = {k: set() for k in totals}
    for kind, prefix in common.collect():  # at most ``own`` a kind and depth
        by_kind[kind].add(prefix)
    frequent = {k: frozenset(v) for k, v in by_kind.items()}
    edges = values.select("kind", "value").mapInArrow(lambda b: _edges(b, frequent, longest), "kind string, depth int, state string, symbol string, to string, n long")
    rows = edges.groupBy("kind", "depth", "state", "symbol", "to").agg(F.sum("n").alias("n")).collect()  # at most as many as states and symbols
    out = []
    for kind in sorted(totals):
        place, step, stop, total = {(0, ""): 0}, [{}], [0], [0]
        for _, depth, state, symbol, to, n in sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1], r[2], r[3])):
            at = place[depth, state]
            total[at] += n
            if to is None:
                stop[at] += n if symbol == "" else 0
                continue
            if (depth + 1, to) not in place:
                place[depth + 1, to] = len(step)
                step.append({})
                stop.append(0)
                total.append(0)
            step[at][symbol] = (place[depth + 1, to], n)
        out.append(merged(kind, step, stop, total))
    return out


def learn(docs: DataFrame, text_col: str = "text", bound: int | None = None, examples: int = 400, longest: int = 256) -> Formats:
    """Fit on seeds by rule and on all of ``docs``, whose texts are read whole; on about ``bound`` different texts where that is asked for.

    The different values of the base matches are labelled credentials, every fifth by hash kept back from the automata (``learned_automata``,
    with ``examples`` as the states' share); all candidates outside base spans are ordinary ones. Thresholds come from the
    scores of all of them, counted in cells ``1 / CELLS`` wide.
    """
    modest_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")) if bound is None else text_sample(docs, text_col, bound)
    found = materialise(texts.mapInArrow(_sample, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")))
    pairs = np.zeros((EDGE + 1, EDGE + 1))
    for value, times in found.where(F.col("kind") == "pair").select("value", "n").collect():  # pairs of symbols
        a, b = map(int, value.split(","))
        pairs[a, b] = times
    values = found.where(F.col("kind").isin("assign", "access", "hex"))
    enough = [r[0] for r in values.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_EXAMPLES).collect()]
    values = values.where(F.col("kind").isin(enough)).select("kind", "value")
    held = F.pmod(F.xxhash64("value", F.lit("held")), F.lit(5)) == 0
    seeded = {kind: parted(v) for kind, v in seeds().items()}
    automata = [infer(kind, learned) for kind, (learned, _) in seeded.items()] + learned_automata(values.where(~held), examples, longest)
    formats = Formats(sorted(automata, key=lambda a: a.kind), plain_model(pairs))
    good, bad = ({a.kind: Counter() for a in automata} for _ in range(2))
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    asked = values.where(held).unionByName(found.where(F.col("kind") == "ordinary").select("kind", "value"))
    for kind, ordinary, cell, n in asked.mapInArrow(lambda b: _gains(b, shared.value), "kind string, ordinary boolean, cell long, n long").groupBy("kind", "ordinary", "cell").agg(F.sum("n")).collect():
        (bad if ordinary else good)[kind][cell / CELLS] += n
    for a in formats.automata:
        for v in seeded[a.kind][1] if a.kind in seeded else ():
            good[a.kind][Formats([a], formats.plain).gains(v)[0]] += 1
    formats.automata = [a for a in formats.automata if good[a.kind]]
    for a in formats.automata:
        a.threshold = threshold(good[a.kind], bad[a.kind])
    discard(found)
    return formats


def scan_secrets(docs: DataFrame, formats: Formats | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: (kind, start, end) spans in code points, end exclusive, by start and kind.

    ``assign``, ``access`` and ``hex`` are the base patterns' matches; ``format`` spans are the candidates
    outside those that an inferred automaton scores above its threshold; every candidate is scored. Null and empty texts have none; texts of any length are scanned whole.
    Repeated rows get equal results; an input column called ``secrets`` is replaced.
    """
    docs = docs.drop("secrets")
    formats = learn(docs, text_col) if formats is None else formats
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by the examples
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("secrets", span)])
    return docs.withColumn("__text", F.col(text_col)).mapInArrow(lambda b: _scan(b, shared.value), schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with the spans (by start) replaced by their kinds."""
    out, done = [], 0
    for kind, s, e in spans:
        if s >= done:
            out += [text[done:s], f"<{kind}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


