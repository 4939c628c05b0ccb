"""Exact Jaccard self-join over word shingles with token-combination prefixes.

Documents are sets of hashed shingles in one global order: rare tokens first, frequent ones last,
each by hash. For two sets with Jaccard similarity of ``t`` or more:

* their ``n - ceil(t n) + 1`` first tokens share one, so *rare* tokens are indexed singly up to there;
* if the first shared token is frequent, so are all shared ones. At most ``D <= (1-t)/(1+t) (n + m)``
  tokens are in one set only, all rare ones among them; so among the first shared tokens, one more than
  the frequent ones of ``D`` leave gaps for, two neighbours follow each other in both sets. They lie
  within an extended prefix of ``0.4 n + 2 - 2 r`` frequent tokens for t = 0.8 and ``r`` rare ones. So
  *frequent* tokens are indexed as combinations of two that follow each other in the extended prefix, and
  only where ``r <= 0.2 n``: a text that is otherwise its own does not ask for a passage it shares.

Which tokens count as frequent is read from a bit map of fixed size, filled from counts over all
documents; any choice gives the same links, and a good one gives few candidates.

Equal sets are one class. Each index token has a pivot, the class that shares most of its tokens with
others (the original among near copies), and the classes of a token are candidates in their pivot's
bucket. First each class meets only its nearest pivot, and the links found are contracted to
components. Then what is still apart in a bucket is compared, and only that: members whose rare tokens
alone leave no room for a link with anyone there are dropped, and of the rest each is held against those
outside the bucket's largest component, in blocks of bounded size. Two parity sketches decide before any text is
read: two to four bits a token, each flipped by every token that falls on its place; the larger of two
is folded to the other's length. Two sets differ by at least as many tokens as their sketches by bits, so
the bound is exact and nothing else is emitted. What is left is verified on the texts, which each block
gets once; pairs that the block's links join already are skipped. So a large group of near copies costs
about one comparison of texts a member, and emits none of its other pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import SPACED, Words, mix, slices
from .common import SPACE_CLASS, discard, give_back, materialise, modest_batches, spread_join
from .components import connected_components

MAP_BITS = 23
BLOCK = 256
CHUNK_TOKENS = 1 << 20
_U = np.uint64


def shingle_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with each document's sorted distinct shingle hashes; fewer than k words are one shingle."""
    for part, data, offs in slices(batch, column):
        words = Words(data, offs, SPACED)
        hashes = words.shingles(k)
        sets = []
        for a, b in zip(words.offs[:-1], words.offs[1:], strict=True):
            if b - a >= k:
                sets.append(np.unique(hashes[a : b - k + 1]))
            elif b > a:
                whole = words.hash[a:b] * np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(b - a)], dtype=np.uint64)
                sets.append(mix(whole.sum(keepdims=True) + _U(b - a)))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
        yield part, sets


def set_key(tokens: np.ndarray) -> int:
    return int(mix(mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(keepdims=True) + _U(len(tokens))).view(np.int64)[0]) if len(tokens) else 0


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - MAP_BITS)).astype(np.int64)


def rare_tokens(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """bool: which tokens of a set are not on the map of frequent ones."""
    at = _bits(tokens)
    return (frequent[at >> 3] >> (at & 7)) & 1 == 0


def index_tokens(tokens: np.ndarray, frequent: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The index tokens of a set: single rare ones of the prefix, and pairs of frequent ones of the extended prefix.

    Pairs are needed only where a link may share no rare token; then all ``r`` rare ones are in this set
    alone, as are ``e >= r`` in all, with ``e <= n - ceil(t n)``. Of the ``(n - e) (1-t)/t`` tokens or fewer that are in
    one set only, the rare ones come first and block no gap between shared ones.
    """
    n = len(tokens)
    alone = rare_tokens(tokens, frequent)
    rare, often = tokens[alone], tokens[~alone]
    most = n - -(-n * t.numerator // t.denominator)
    singles = rare[: most + 1]
    r, slope = len(rare), (1 - t) / t
    pairs = often[: int(max((n - e) * slope - r + e - r for e in (r, most))) + 2] if r <= most else often[:0]
    return mix(singles + _U(1)), mix(pairs[:-1] * _U(0x9E3779B97F4A7C15) + mix(pairs[1:]))


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Parities of how many tokens fall on each place, by their hashes' last bits; 2n to 4n places, a power of two."""
    bits = max(256, 1 << int(2 * len(tokens) - 1).bit_length())
    counts = np.bincount((mix(tokens) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of more 64-bit words brought to a smaller power of two: parities of places add up by halves."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Token counts over a partition's distinct sets, of tokens that at least two of about CHUNK_TOKENS / n sets share."""
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def counted() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    for batch in batches:
        for _, sets in shingle_sets(batch, k):
            for s in sets:
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size > CHUNK_TOKENS:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _keys(batches: Iterator[pa.RecordBatch], k: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, n, key, rare) of every row, with the sketch of sets that the partition has not had before."""
    seen: set[int] = set()
    for batch in batches:
        for part, sets in shingle_sets(batch, k):
            keys = [set_key(s) for s in sets]
            sketches: list[bytes | None] = []
            for s, key in zip(sets, keys, strict=True):
                sketches.append(parity_sketch(s) if len(s) and key not in seen else None)
                seen.add(key)
            rare = pa.array([int(rare_tokens(s, frequent).sum()) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), rare, pa.array(sketches, pa.binary())], ["id", "n", "key", "rare", "sketch"])


SALTS = 64


def _index(batches: Iterator[pa.RecordBatch], k: int, t: Fraction, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, n, key, salt) of each different set of a partition that another one may link with; pairs of frequent tokens are salted."""
    seen: set[int] = set()
    for batch in batches:
        for _, sets in shingle_sets(batch, k):
            tokens, sizes, keys, salts = [], [], [], []
            for s in sets:
                # two different sets of at most n tokens reach (n - 1) / n at best
                if (len(s) - 1) * t.denominator >= t.numerator * len(s) or len(s) * (t.denominator - t.numerator) >= t.numerator:
                    key = set_key(s)
                    if key in seen:
                        continue
                    seen.add(key)
                    singles, pairs = index_tokens(s, frequent, t)
                    tokens += [singles, pairs]
                    sizes.append(len(s))
                    keys.append(key)
                    salts.append((len(singles), len(pairs), 1 + key % SALTS))
            if keys:
                each = [a + b for a, b, _ in salts]
                salt = np.concatenate([x for a, b, y in salts for x in (np.zeros(a, np.int32), np.full(b, y, np.int32))])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sizes), each)), pa.array(np.repeat(np.array(keys, dtype=np.int64), each)), pa.array(salt)], ["token", "n", "key", "salt"])


def _buckets(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, salt, n, key), those that another class of the same token could match in size, each once.

    Rows stream by; a token's rows are never held together. A salted token's rows are in several
    tasks, so all of them are given out.
    """
    names = ["token", "salt", "n", "key"]
    before: list | None = None  # the row before the batch
    given = False  # it has been given out
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        if before is not None:
            columns = [np.append(x, y) for x, y in zip(before, columns, strict=True)]
        if not len(columns[0]):
            continue
        fresh = np.zeros(len(columns[0]), dtype=bool)
        fresh[0] = True
        for x in columns:
            fresh[1:] |= x[1:] != x[:-1]
        token, salt, n, key = (x[fresh] for x in columns)
        close = np.zeros(len(token), dtype=bool)  # to the row before, in size
        close[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (n[1:] * t.numerator <= n[:-1] * t.denominator)
        give = close | (salt > 0)
        give[:-1] |= close[1:]
        if before is not None and given:
            give[0] = False
        end = len(token) - 1
        given = bool(give[end]) or (end == 0 and before is not None and given)
        before = [x[end : end + 1] for x in (token, salt, n, key)]
        if give.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in (token, salt, n, key)], names)


def _near(n: np.ndarray, m: np.ndarray, bits: np.ndarray, t: Fraction) -> np.ndarray:
    """Sizes and sketches allow the similarity."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (small * t.denominator >= large * t.numerator) & (bits * (t.denominator + t.numerator) <= (n + m) * (t.denominator - t.numerator))


def _block_pairs(table: pa.Table, t: Fraction) -> pa.Table:
    """One block of a bucket's members (left) and one of those outside its largest component (right) -> (g, a_id, b_id, bits) of pairs that may match.

    Besides sizes and sketches, ``spare`` decides: two sets that share no rare token have all of them apart.
    """
    names = ("id", "n", "component", "spare", "by_rare", "by_often", "main")
    is_left = table.column("left").to_numpy(zero_copy_only=False)
    rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in names}
    raw = table.column("sketch").to_pylist()
    left = np.flatnonzero(is_left)
    left = left[np.argsort(rows["n"][left], kind="stable")]
    ids, n, component, spare, by_rare, by_often, main = (rows[c][left] for c in names)
    sketches = [np.frombuffer(raw[i], np.uint64) for i in left]
    widths = np.array([len(s) for s in sketches])
    place = np.zeros(len(left), dtype=np.int64)  # of a left row among those of its width
    for w in np.unique(widths).tolist():
        place[widths == w] = np.arange((widths == w).sum())
    stacks: dict[tuple[int, int], np.ndarray] = {}

    def stack(w: int, v: int) -> np.ndarray:
        if (w, v) not in stacks:
            stacks[w, v] = np.stack([folded(s, v) for s in sketches if len(s) == w])
        return stacks[w, v]

    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    for i in np.flatnonzero(~is_left).tolist():
        own = np.frombuffer(raw[i], np.uint64)
        low, high = -(-int(rows["n"][i]) * t.numerator // t.denominator), int(rows["n"][i]) * t.denominator // t.numerator
        rest = np.arange(np.searchsorted(n, low), np.searchsorted(n, high, "right"))
        meet = (by_rare[rest] & rows["by_rare"][i]) | (by_often[rest] & rows["by_often"][i] & (spare[rest] + rows["spare"][i] <= 0))
        # two of the right side meet twice, once each way
        rest = rest[meet & (component[rest] != rows["component"][i]) & (main[rest] | (ids[rest] < rows["id"][i]))]
        for w in np.unique(widths[rest]).tolist():
            some = rest[widths[rest] == w]
            v = min(w, len(own))
            bits = np.bitwise_count(stack(w, v)[place[some]] ^ folded(own, v)).sum(axis=1, dtype=np.int64)
            keep = bits * (t.denominator + t.numerator) <= (n[some] + rows["n"][i]) * (t.denominator - t.numerator)
            out.append((ids[some[keep]], int(rows["id"][i]), bits[keep]))
    a = np.concatenate([x for x, _, _ in out]) if out else np.zeros(0, np.int64)
    b = np.concatenate([np.full(len(x), y) for x, y, _ in out]) if out else np.zeros(0, np.int64)
    bits = np.concatenate([z for _, _, z in out]) if out else np.zeros(0, np.int64)
    g = np.full(len(a), table.column("g")[0].as_py())
    return pa.table({"g": g, "a_id": np.minimum(a, b), "b_id": np.maximum(a, b), "bits": bits})


def _links(pairs: pa.Table, texts: pa.Table, k: int, t: Fraction) -> pa.Table:
    """(a, b) links among a block's pairs, nearest first, without pairs that earlier links join; both texts are in the block."""
    ids, sets = [], []
    for batch in texts.to_batches():
        for part, found in shingle_sets(batch, k):
            ids += part.column(part.schema.get_field_index("id")).to_pylist()
            sets += found
    own = dict(zip(ids, sets, strict=True))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out_a, out_b = [], []
    for a, b, _ in sorted(zip(*(pairs.column(c).to_pylist() for c in ("a_id", "b_id", "bits")), strict=True), key=lambda p: (p[2], p[0], p[1])):
        ra, rb = find(a), find(b)
        if ra == rb or a not in own or b not in own:
            continue
        common = len(np.intersect1d(own[a], own[b], assume_unique=True))
        if common * t.denominator >= t.numerator * (len(own[a]) + len(own[b]) - common):
            root[max(ra, rb)] = min(ra, rb)
            out_a.append(a)
            out_b.append(b)
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


class JaccardJoin:
    """One run of the join; ``components`` is what callers want."""

    def __init__(self, docs: DataFrame, k: int = 5, threshold: str = "0.8", frequent: int = 32, broadcast_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.k, self.t, self.frequent, self.broadcast_ids = docs.sparkSession, k, Fraction(threshold), frequent, broadcast_ids
        modest_batches(self.spark)
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def frequent_map(self) -> np.ndarray:
        """Bit map of MAP_BITS: the hash places of frequent tokens. Its size does not depend on the input."""
        k = self.k
        counts = self.docs.select("text").mapInArrow(lambda b: give_back(_count(b, k)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > self.frequent)
        place = F.shiftrightunsigned("token", 64 - MAP_BITS)
        one = F.expr("shiftleft(1L, cast(place & 63 AS int))")
        words = counts.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
        out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
        for word, bits in words:
            out[word] = bits
        return out.view(np.uint8)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of (g, a_id, b_id, bits) pairs, g their block, links (a, b) that join the same documents as all pairs which reach the similarity."""
        k, t = self.k, self.t
        each = pairs.select(F.col("g").alias("h"), F.col("a_id").alias("id")).union(pairs.select("g", "b_id")).distinct()
        need = each.select("id").distinct()
        texts = self.docs.join(F.broadcast(need) if need.count() <= self.broadcast_ids else need, "id", "left_semi")
        block_texts = texts.join(each, "id").select("h", "id", "text")
        return pairs.groupBy("g").cogroup(block_texts.groupBy("h")).applyInArrow(lambda p, x: _links(p, x, k, t), "a long, b long")

    def components(self) -> DataFrame:
        """(id, n_shingles, component_id) of every row."""
        k, t = self.k, self.t
        frequent = self.spark.sparkContext.broadcast(self.frequent_map())
        rows = materialise(self.docs.mapInArrow(lambda b: give_back(_keys(b, k, frequent.value)), "id long, n long, key long, rare long, sketch binary"))
        classes = materialise(rows.where("n > 0").groupBy("key", "n").agg(F.min("id").alias("id"), F.max("rare").alias("rare"), F.max("sketch").alias("sketch")))
        tokens = self.docs.select("text").mapInArrow(lambda b: give_back(_index(b, k, t, frequent.value)), "token long, n long, key long, salt int")
        tokens = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key")
        shared = materialise(tokens.mapInArrow(lambda b: give_back(_buckets(b, t)), "token long, salt int, n long, key long"))

        # each class in the buckets of its tokens' pivots, with what brought it there
        central = shared.groupBy("key", "n").agg(F.count(F.lit(1)).alias("w"))
        rank = F.shiftleft("w", 40).bitwiseOR(F.shiftrightunsigned("key", 24))
        ranked = shared.join(central, ["key", "n"]).select("token", "key", "n", rank.alias("rank"))
        pivots = ranked.groupBy("token").agg(F.max_by("key", "rank").alias("pivot"), F.max_by("n", "rank").alias("pivot_n"))
        met = spread_join(shared, pivots, ["token"], "key").groupBy("key", "n", "pivot", "pivot_n").agg(F.bool_or(F.col("salt") == 0).alias("by_rare"), F.bool_or(F.col("salt") > 0).alias("by_often"))
        met = materialise(met)
        discard(shared)

        # first each class with its nearest pivot
        spare = (F.col("rare") * (t.denominator + t.numerator) - F.col("n") * (t.denominator - t.numerator)).alias("spare")
        mine = classes.select("key", "n", F.col("id").alias("a_id"), F.col("sketch").alias("a_sketch"), spare)
        theirs = classes.withColumn("spare", spare).select(F.col("key").alias("pivot"), F.col("n").alias("pivot_n"), F.col("id").alias("b_id"), F.col("sketch").alias("b_sketch"), F.col("spare").alias("b_spare"))
        star = spread_join(met.where("key <> pivot OR n <> pivot_n"), theirs, ["pivot", "pivot_n"], "key").join(mine, ["key", "n"]).where("by_rare OR spare + b_spare <= 0")
        near = materialise(self.near(star).groupBy("a_id").agg(F.min(F.struct("bits", "b_id")).alias("p")).select("a_id", "p.b_id", "p.bits"))
        parts = near.groupBy("b_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        tried = materialise(spread_join(near, parts, ["b_id"], "a_id").select(F.xxhash64("b_id", F.pmod(F.xxhash64("a_id"), "parts")).alias("g"), "a_id", "b_id", "bits"))
        links = materialise(self.verified(tried))
        found = connected_components(links)

        # then what is still apart in a bucket: by a rare token, or by frequent ones with so few rare that some other may be near enough
        place = classes.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "n", "id", "sketch", spare, F.coalesce("component", "id").alias("component"))
        bucket = ["pivot", "pivot_n"]
        inside = materialise(met.join(place.drop("sketch"), ["key", "n"]))
        least = inside.where("by_often").groupBy(*bucket).agg(F.min("spare").alias("least"))
        apart = spread_join(inside, least, bucket, "key", how="left").withColumn("by_often", F.col("by_often") & (F.col("spare") + F.col("least") <= 0)).where("by_rare OR by_often")
        apart = materialise(apart.drop("least"))
        sides = [f(F.when(F.col(by), F.col("component"))).alias(f"{f.__name__}_{by}") for by in ("by_rare", "by_often") for f in (F.min, F.max)]
        parts_of = apart.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("c"))
        largest = parts_of.groupBy(*bucket).agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("top"))
        held = apart.groupBy(*bucket).agg(*sides).join(largest, bucket)
        torn = held.where("min_by_rare <> max_by_rare OR min_by_often <> max_by_often")
        torn = torn.select(*bucket, F.col("top.component").alias("largest"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("others"))
        # every member is compared with those outside the bucket's largest component, in blocks of both
        apart = spread_join(apart, torn, bucket, "key").withColumn("main", F.col("component") == F.col("largest"))
        apart = apart.join(place.select("key", "n", "sketch"), ["key", "n"]).withColumns({"i": F.pmod("key", "blocks"), "j": F.pmod("key", F.greatest("others", F.lit(1)))})
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(c), F.lit(1)).cast("long") - 1))
        sent = ["id", "n", "component", "sketch", "spare", "by_rare", "by_often", "main"]
        left = apart.withColumn("j", every("others")).select(*bucket, "i", "j", F.lit(True).alias("left"), *sent)
        right = apart.where("NOT main").withColumn("i", every("blocks")).select(*bucket, "i", "j", F.lit(False).alias("left"), *sent)
        both = left.unionByName(right).select(F.xxhash64(*bucket, "i", "j").alias("g"), "left", *sent)
        pairs = both.groupBy("g").applyInArrow(lambda x: _block_pairs(x, t), "g long, a_id long, b_id long, bits long")
        before = tried.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
        again = materialise(pairs.groupBy("a_id", "b_id").agg(F.min("g").alias("g"), F.min("bits").alias("bits")).join(before, ["a_id", "b_id"], "left_anti"))
        more = materialise(self.verified(again))
        self.stats = {"met": met, "tried": tried, "links": links, "held": held, "again": again, "more": more}
        found = connected_components(links.unionByName(more))

        home = classes.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "n", F.coalesce("component", "id").alias("component"))
        full = spread_join(rows.select("id", "n", "key"), home, ["key", "n"], "id", how="left")
        return full.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches allow the similarity, with ``bits``, how many places differ."""
        t = self.t

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.zeros(batch.num_rows, dtype=np.int64)
                for i, (x, y) in enumerate(zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist(), strict=True)):
                    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    words = min(len(a), len(b))
                    bits[i] = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()
                keep = pa.array(_near(batch.column("n").to_numpy(), batch.column("pivot_n").to_numpy(), bits, t))
                yield pa.RecordBatch.from_arrays([batch.column("a_id").filter(keep), batch.column("b_id").filter(keep), pa.array(bits).filter(keep)], ["a_id", "b_id", "bits"])

        return pairs.select("a_id", "b_id", "n", "pivot_n", "a_sketch", "b_sketch").mapInArrow(lambda b: give_back(far(b)), "a_id long, b_id long, bits long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_shingles, component_id): the rows of ``docs`` grouped by chains of links.

    Words are parted by ASCII white space, A-Z lower-cased. A text's set is its distinct k-word
    shingles; with fewer words, all of them are one; null, empty and blank texts have an empty set,
    link with nothing and are their own component. ``component_id`` is the smallest id reachable.
    Repeated rows are one class; rows that share an id are one document, and those without an id another.
    An empty table gives an empty table. Other columns are not looked at.
    """
    out = JaccardJoin(docs, id_col=id_col, text_col=text_col, **options).components()
    return out.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, of equal ids and texts any one.

    Rows are told apart by id and text, so different texts may share an id. Texts without words are linked with nothing:
    all their rows stay.
    """
    columns = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), text))
    words = text.rlike(rf"[^{SPACE_CLASS}]")
    full = rows.where(words)
    groups = jaccard_components(full.select("__row", text_col), id_col="__row", text_col=text_col, **options).select("__row", "component_id").distinct()
    thin = full.select("__row", F.col(id_col).alias("__id")).distinct()
    first = F.min_by("__row", F.struct(F.col("__id").isNull(), "__id", "__row"))
    keep = thin.join(groups, "__row").groupBy("component_id").agg(first.alias("__row")).select("__row")
    kept = full.join(keep, "__row", "left_semi").dropDuplicates(["__row"])
    return kept.select(*columns).unionByName(rows.where(~words).select(*columns))
