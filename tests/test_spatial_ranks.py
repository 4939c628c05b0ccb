"""Joins of boxes by tiles and ranks over ranges, against plain Python; crowded groups and hot segments."""

import random

import pytest
from pyspark.sql import functions as F

from prismara.functions.rounding import scaled_round
from prismara.operators import aggregates, joins, panels, ranks, spatial
from prismara.plans import flows

BOX = "media string, o long, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda t: max(0, t[2] - t[0]) * max(0, t[3] - t[1])
    return w * h / (area(a) + area(b) - w * h)


def boxes(seed, n, plane, largest, start=0):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        x, y = draw.uniform(-plane, plane), draw.uniform(-plane, plane)
        w, h = (2 ** draw.uniform(-3, largest) for _ in range(2))
        out.append(("m" if k % 3 else "n", start + k, x, y, x + w, y + h))
    copies = out[: n // 20]
    return out + [(m, o + 10 * n, *b) for m, o, *b in copies] + [("m", start + 20 * n, 1.0, 1.0, 1.0, 5.0), ("n", start + 20 * n + 1, 3.0, 1.0, 2.0, 5.0)]


@pytest.fixture
def tiles_only(monkeypatch):
    monkeypatch.setattr(spatial, "crowded", lambda *a, **k: True)


@pytest.mark.parametrize("least", [0.0, 0.1, 0.3, 0.5])
def test_candidates_are_all_overlapping_pairs_once(spark, least):
    left, right = boxes(1, 150, 60, 6), boxes(2, 150, 60, 6)
    pairs = spatial.candidates(spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX), ["media"], least)
    got = [(r["o"], r["r_o"]) for r in pairs.collect()]
    want = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and iou(a[2:], b[2:]) > max(least, 0.0)}
    assert len(got) == len(set(got)) and want <= set(got)
    overlapping = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and iou(a[2:], b[2:]) > 0}
    assert set(got) <= overlapping and (least or set(got) == overlapping)


@pytest.mark.parametrize("whole", [True, False])
def test_best_unseen_and_first_by_tiles_as_by_key(spark, monkeypatch, whole):
    left, right = boxes(3, 200, 40, 5), boxes(4, 200, 40, 5, start=100_000)
    a, b = spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX)
    monkeypatch.setattr(spatial, "crowded", lambda *a, **k: whole)
    best = joins.iou_best(a, b, ["media"], ["o"], "o", lambda v: v > 0.3, least=0.3)
    got = {r["o"]: (r["r_o"], r["iou"] and round(r["iou"], 9)) for r in best.collect()}
    want = {}
    for m, o, *box in left:
        top = max(((iou(box, r[2:]), -r[1]) for r in right if r[0] == m), default=(0, 0))
        want[o] = (-top[1], round(top[0], 9)) if top[0] > 0.3 else (None, None)
    assert got == want and best.count() == len(left)
    unseen = joins.iou_unseen(a, b, ["media"])
    assert unseen.columns == a.columns
    assert sorted(r["o"] for r in unseen.collect()) == sorted(o for m, o, *box in left if all(iou(box, r[2:]) < 0.3 for r in right if r[0] == m))
    counted = spatial.overlapping_pairs(a, ["media"], "o").select("o", "r_o").collect()
    assert sorted(map(tuple, counted)) == sorted((x[1], y[1]) for x in left for y in left if x[0] == y[0] and x[1] < y[1] and iou(x[2:], y[2:]) > 0)


def test_first_apart_is_the_fold(spark, tiles_only):
    rows = [(m, o, *(int(v * 4) for v in b)) for m, o, *b in boxes(6, 400, 30, 5)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "media string, o long, x1 long, y1 long, x2 long, y2 long")
    got = sorted(tuple(r) for r in joins.greedy_unseen(df, ["media"], "o").collect())
    want = []
    for key in ("m", "n"):
        kept = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if all(iou(k[2:], r[2:]) < 0.3 for k in kept):
                kept.append(r)
        want += kept
    assert got == sorted(want)


def test_twenty_thousand_boxes_of_one_media(spark):
    """Candidates grow with the boxes, not with their square."""
    draw = random.Random(9)
    counts = []
    for n in (5_000, 20_000):
        side = 10 * n**0.5
        rows = [("one", k, x, y, x + draw.uniform(4, 20), y + draw.uniform(4, 20)) for k in range(n) for x, y in [(draw.uniform(0, side), draw.uniform(0, side))]]
        df = spark.createDataFrame(rows, BOX)
        assert spatial.crowded(df, ["media"])
        counts.append(spatial.candidates(df, df, ["media"], 0.3).count() / n)
        assert joins.iou_unseen(df, df.limit(0), ["media"]).count() == n
    assert counts[1] < 1.2 * counts[0] < 12
    best = joins.iou_best(df, df.where("o % 2 = 0"), ["media"], ["o"], "o", lambda v: v > 0.3, least=0.3)
    assert best.where("o % 2 = 0 AND r_o = o").count() == n // 2


def test_copies_of_a_box_make_no_pairs(spark, tiles_only):
    many = spark.range(20_000).select(F.lit("m").alias("media"), F.col("id").alias("o"), *[F.lit(v).cast("double").alias(c) for v, c in ((0, "x1"), (0, "y1"), (9, "x2"), (9, "y2"))])
    best = joins.iou_best(many, many, ["media"], ["o"], "o", lambda v: v > 0.3, least=0.3)
    assert best.where("r_o = 0 AND iou = 1").count() == 20_000
    assert joins.iou_unseen(many, many, ["media"]).count() == 0


def test_methods_by_tiles_and_by_key(spark, monkeypatch):
    draw, rows = random.Random(8), []
    for k in range(40):
        kind, n = draw.choice(list(panels.COVERAGE)), draw.randint(1, 6)
        rows += [(k, kind, j, x, y, x + draw.randint(10, 60), y + draw.randint(10, 60)) for j in range(n) for x, y in [(draw.randint(0, 60), draw.randint(0, 60))]]
    df = spark.createDataFrame(rows, "k long, kind string, j long, x1 long, y1 long, x2 long, y2 long")
    by_key = sorted(map(tuple, panels.method(df, "k", "kind", "j", 10_000).collect()))
    monkeypatch.setattr(spatial, "crowded", lambda *a, **k: True)
    assert sorted(map(tuple, panels.method(df, "k", "kind", "j", 10_000).collect())) == by_key
    empty = df.limit(0)
    assert spatial.candidates(empty, empty, ["k", "kind"]).count() == 0


def ranked(values):
    key = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(map(key, values))
    return {v: (sum(x < key(v) for x in order), sum(x == key(v) for x in order)) for v in set(values)}


@pytest.fixture(scope="module")
def scores(spark):
    draw = random.Random(11)
    rows = [(k, "hot" if k % 4 else draw.choice(["a", "b", None]), draw.choice([None, 7, 7, 7, draw.randint(0, 30)])) for k in range(3000)] + [(5000, "single", 1)]
    return rows, spark.createDataFrame(rows, "id long, seg string, v long").repartition(13)


def by_segment(rows):
    out = {}
    for k, s, v in rows:
        out.setdefault(s, []).append((k, v))
    return out


def test_ties_percent_and_average_ranks(scores):
    rows, df = scores
    share = {r["id"]: r["p"] for r in ranks.percent_rank(df, ["seg"], "v", "p").collect()}
    mean = {r["id"]: r["a"] for r in ranks.average_rank(df, ["seg"], "v", "a").collect()}
    assert len(share) == len(mean) == len(rows)
    for members in by_segment(rows).values():
        places = ranked([v for _, v in members])
        for k, v in members:
            low, same = places[v]
            assert share[k] == pytest.approx(low / (len(members) - 1) if len(members) > 1 else 0.0)
            assert mean[k] == low + (same + 1) / 2


@pytest.mark.parametrize("parts", [1, 3, 10, 5000])
def test_positions_and_tiles(scores, parts):
    rows, df = scores
    at = {r["id"]: r["at"] for r in ranks.before(df, ["seg"], ["v", "id"], "at").collect()}
    tile = {r["id"]: r["t"] for r in ranks.ntile(df, ["seg"], ["v", "id"], parts, "t").collect()}
    for members in by_segment(rows).values():
        order = sorted(members, key=lambda m: (m[1] is not None, m[1] or 0, m[0]))
        assert [at[k] for k, _ in order] == list(range(len(order)))
        size, larger = divmod(len(order), parts)
        want = [p + 1 for p in range(min(parts, len(order))) for _ in range(size + (p < larger))]
        assert [tile[k] for k, _ in order] == want


def test_a_segment_lies_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("one").alias("seg"), (F.col("id") * 7919 % 200_000).alias("v"))
    got = ranks.before(df, ["seg"], ["v"], "at")
    assert got.where("at <> v").count() == 0
    weighed = ranks.before(df.withColumn("w", F.lit(2)), ["seg"], ["v"], "sum", "w")
    assert weighed.where("sum <> 2 * v").count() == 0
    assert ranks.before(df.limit(0), ["seg"], ["v"], "at").count() == 0


def test_medians(scores):
    from statistics import median

    rows, df = scores
    got = {r["seg"]: r["m"] for r in ranks.medians(df, ["seg"], "v", "m").collect()}
    assert got == {s: median(v for _, v in members if v is not None) for s, members in by_segment(rows).items() if any(v is not None for _, v in members)}


def test_rounding_as_sql_engines_round_doubles(spark):
    got = spark.createDataFrame([(1.005, 2), (2.675, 2), (0.285, 2), (2.5, 0), (-2.5, 0), (None, 2)], "x double, d int")
    rows = got.select("d", scaled_round("x", 2).alias("two"), scaled_round("x", 0).alias("none")).collect()
    assert [r["two"] for r in rows] == [1.0, 2.68, 0.28, 2.5, -2.5, None] and [r["none"] for r in rows] == [1.0, 3.0, 0.0, 3.0, -3.0, None]


def test_face_means_round_as_sql(spark):
    faces = spark.createDataFrame([(1, str(1 + (i < 1))) for i in range(200)] + [(2, "none")], "u long, s string")
    got = {r["u"]: r["mean_score"] for r in aggregates.face_means(faces, ["u"], "s").collect()}
    assert got == {1: "1.0", 2: "NA"}  # 1.005, which is below a half in binary


def test_means_add_up_in_the_order_given(spark):
    rows = [(k, at, s) for k, values in ((1, ["7.3", "15", "7.3", "15"]), (2, ["15", "15", "7.3", "7.3"])) for at, s in enumerate(values)] + [(3, 0, "N/A"), (2, 9, "8/10")]
    got = aggregates.means_in_order(spark.createDataFrame(rows, "k long, at long, s string").repartition(5), ["k"], "s", ["at"], 1)
    assert {tuple(r) for r in got.collect()} == {(1, 4, 4, 11.2), (2, 5, 4, 11.1), (3, 1, 0, None)}


def test_media_in_order_with_durations_on_a_half(spark, tmp_path):
    orders = spark.createDataFrame([(10, 320007.5), (20, 320005.0), (30, 1.0)], "o_orderkey long, o_totalprice double")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: r["place"] for r in flows.long_last_order(spark, str(tmp_path)).collect()}
    assert got == {30: 1, 10: 2, 20: 3}  # both long ones last 64.001 s, as 64.0015 * 1000 is below a half
