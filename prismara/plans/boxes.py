"""Catalogue: boxes, keypoints, frames, cuts and best candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rounding as R
from ..functions import textparse as T
from ..operators import aggregates as A
from ..operators import dedup, joins, select, spatial, vectors
from ..sources.tables import parts_of
from . import virtual as VR

DET = VR.DET
DKEY = ["media", "frame", "l_partkey", "l_suppkey"]
DKEYS = ", ".join(DKEY)
WIDTH, HEIGHT = 640, 480


def _w() -> tuple:
    return F.lit(WIDTH), F.lit(HEIGHT)


def o_iou(a: str, b: str) -> str:
    common = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
    return f"({common}) / (({area(a)}) + ({area(b)}) - ({common}))"


def bbox_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf)
    return d.select(*DKEY, G.area(G.box()).alias("area"), G.occupancy(G.box(), *_w()).alias("occupancy"))


def media_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    occ = G.occupancy(G.box(), *_w())
    return VR.detections(spark, sf).groupBy("media").agg(R.scaled_round(F.avg(occ), 6).alias("mean_occupancy"), F.max(occ).alias("max_occupancy"))


def iou_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of odd parts against pose boxes of even ones, by media; matches overlap by more than 0.3."""
    d = VR.detections(spark, sf).select("media", "frame", "l_partkey", "l_suppkey", "x1", "y1", "x2", "y2")
    order = F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    left = d.where("l_partkey % 2 = 1")
    right = d.where("l_partkey % 2 = 0").withColumn("o", order).select("media", "o", "x1", "y1", "x2", "y2")
    best = joins.iou_best(left, right, ["media"], [*DKEY, "x2"], "o", lambda v: v > G.IOU_KEYPOINTS, least=G.IOU_KEYPOINTS)
    return best.select(*DKEY, F.col("r_o").alias("match"), R.scaled_round("iou", 6).alias("iou"))


O_BEST = f"""
WITH d AS ({DET}), l AS (SELECT * FROM d WHERE l_partkey % 2 = 1), r AS (SELECT *, frame * 1000000000 + l_partkey * 10000 + l_suppkey AS o FROM d WHERE l_partkey % 2 = 0),
p AS (SELECT l.media, l.frame, l.l_partkey, l.l_suppkey, l.x2, r.o, {o_iou('l', 'r')} AS v FROM l JOIN r USING (media)),
b AS (SELECT *, row_number() OVER (PARTITION BY {DKEYS}, x2 ORDER BY v DESC, o) AS n FROM p)
SELECT l.media, l.frame, l.l_partkey, l.l_suppkey, CASE WHEN v > 0.3 THEN o END AS match, CASE WHEN v > 0.3 THEN round(v, 6) END AS iou FROM l LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (media, frame, l_partkey, l_suppkey, x2)
"""


def face_person_link(spark: SparkSession, sf: str) -> DataFrame:
    """The track of the person that a face overlaps most, from an overlap of a half on; faces are boxes of odd parts, persons of even ones that make a demand or not."""
    d = VR.detections(spark, sf)
    order = F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    persons = d.where("l_partkey % 2 = 0").withColumn("o", order).select("media", "o", "track", "x1", "y1", "x2", "y2")
    faces = d.where("l_partkey % 2 = 1").select("media", "frame", "l_partkey", "l_suppkey", "x1", "y1", "x2", "y2")
    linked = joins.iou_best(faces, persons, ["media"], [*DKEY, "x2"], "o", lambda v: v >= G.IOU_FACE, least=G.IOU_FACE)
    return linked.select(*DKEY, F.col("r_track").alias("track"), R.scaled_round("iou", 6).alias("iou"))


O_LINK = f"""
WITH d AS ({DET}), p AS (SELECT *, frame * 1000000000 + l_partkey * 10000 + l_suppkey AS o FROM d WHERE l_partkey % 2 = 0), f AS (SELECT * FROM d WHERE l_partkey % 2 = 1),
b AS (SELECT f.media, f.frame, f.l_partkey, f.l_suppkey, f.x2, p.track, {o_iou('f', 'p')} AS v, row_number() OVER (PARTITION BY f.media, f.frame, f.l_partkey, f.l_suppkey, f.x2 ORDER BY {o_iou('f', 'p')} DESC, p.o) AS n FROM f JOIN p USING (media))
SELECT f.media, f.frame, f.l_partkey, f.l_suppkey, CASE WHEN v >= 0.5 THEN b.track END AS track, CASE WHEN v >= 0.5 THEN round(v, 6) END AS iou FROM f LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (media, frame, l_partkey, l_suppkey, x2)
"""


def iou_anti(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf)
    return joins.iou_unseen(d.where("l_partkey % 2 = 0"), d.where("l_partkey % 2 = 1"), ["media"]).select(*DKEY)


O_ANTI = f"WITH d AS ({DET}) SELECT {DKEYS} FROM d c WHERE l_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM d s WHERE s.l_partkey % 2 = 1 AND s.media = c.media AND {o_iou('c', 's')} >= 0.3)"


def iou_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted boxes of a media taken as one frame, in order."""
    d = VR.detections(spark, sf).withColumn("o", F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    return joins.greedy_unseen(d, ["media"], "o")


O_GREEDY = f"""
WITH RECURSIVE d AS (SELECT media, {{'o': frame * 1000000000 + l_partkey * 10000 + l_suppkey, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b, row_number() OVER (PARTITION BY media ORDER BY frame * 1000000000 + l_partkey * 10000 + l_suppkey, x1, y1, x2, y2) AS n FROM ({DET})),
s AS (SELECT media, n, [b] AS kept FROM d WHERE n = 1
  UNION ALL SELECT d.media, d.n, CASE WHEN len(list_filter(s.kept, lambda k: {o_iou('k', 'd.b')} >= {G.IOU_SEEN})) = 0 THEN list_append(s.kept, d.b) ELSE s.kept END FROM s JOIN d ON d.media = s.media AND d.n = s.n + 1)
SELECT media, k.o AS o, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM (SELECT media, unnest(kept) AS k FROM (SELECT media, arg_max(kept, n) AS kept FROM s GROUP BY media))
"""


def min_ratio_two_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf)
    big = (G.side(F.col("x1"), F.col("x2")) >= 4) & (G.side(F.col("y1"), F.col("y2")) >= 4)
    return d.groupBy("media", "frame").agg(F.count_if(big).alias("raw_persons"), F.count_if(big & (G.area(G.box()) / (WIDTH * HEIGHT) >= 0.01)).alias("persons"))


KP = VR.keypoints


def _o_conf(i: int) -> str:
    return f"CASE WHEN l_partkey % 13 <> 0 THEN ((l_partkey + l_suppkey + {i} * 7) % 41) / 40.0 END"


def _o_x(i: int) -> str:
    return f"((l_partkey + {i} * 37) % 101)"


def _o_y(i: int) -> str:
    return f"((l_suppkey + {i} * 5) % 97)"


def proxemic_keypoints(spark: SparkSession, sf: str) -> DataFrame:
    d = KP(VR.detections(spark, sf))
    n = d.groupBy("media", "frame").agg(F.count(F.lit(1)).alias("persons"))
    d = d.join(n, ["media", "frame"])
    return d.select(*DKEY, G.proxemic_class(F.col("kps"), G.box(), *_w(), F.col("persons")).alias("social_distance"))


def _any(*ids: int) -> str:
    return "greatest(" + ", ".join(_o_conf(i) for i in ids) + ") >= 0.5"


O_PROX = f"""
SELECT {DKEYS}, CASE WHEN count(*) OVER (PARTITION BY media, frame) >= 4 THEN 'public distance' WHEN l_partkey % 13 = 0 THEN NULL WHEN NOT ({_any(5, 6)}) THEN 'intimate distance'
  WHEN {_any(13, 14, 15, 16)} THEN CASE WHEN (x2 - x1) * (y2 - y1) / {WIDTH * HEIGHT}.0 >= 0.375 THEN 'close social distance' ELSE 'far social distance' END
  WHEN {_any(11, 12)} THEN 'far personal distance' ELSE 'close personal distance' END AS social_distance FROM ({DET})
"""


def frontal_waist(spark: SparkSession, sf: str) -> DataFrame:
    d = KP(VR.detections(spark, sf))
    k = F.col("kps")
    centre = G.face_centre(k)
    return d.select(
        *DKEY, G.shoulders_visible(k).alias("shoulders"), G.hips_visible(k).alias("hips"), G.waist_visible(k).alias("waist"), G.frontal_with_waist(k).alias("frontal"), G.visible_points(k).alias("points"), G.face_count(k).alias("face"),
        R.scaled_round(centre["x"], 6).alias("cx"), G.face_px(k).alias("face_px"),
    )


def _level(i: int, j: int) -> str:
    return f"(abs({_o_x(i)} - {_o_x(j)}) = 0 OR abs({_o_y(i)} - {_o_y(j)}) <= 0.2 * abs({_o_x(i)} - {_o_x(j)}))"


_WAIST = " AND ".join(f"{_o_conf(i)} > 0.5" for i in (5, 6, 11, 12))
_FACE = lambda limit, v, none: "[" + ", ".join(f"CASE WHEN {_o_conf(i)} > {limit} THEN {v(i)} END" for i in range(5)) + "]"
_XS, _YS = _FACE(0.5, _o_x, None), _FACE(0.5, _o_y, None)
_SPAN = lambda a: f"(list_max({a}) - list_min({a})) * 1.6"
_NF = "(" + " + ".join(f"CASE WHEN {_o_conf(i)} > 0.5 THEN 1 ELSE 0 END" for i in range(5)) + ")"
O_FRONT = f"""
SELECT {DKEYS}, coalesce({_o_conf(5)} >= 0.65 AND {_o_conf(6)} >= 0.65, false) AS shoulders, coalesce({_o_conf(11)} >= 0.5 OR {_o_conf(12)} >= 0.5, false) AS hips, coalesce({_WAIST}, false) AS waist,
  coalesce({_WAIST} AND {_level(5, 6)} AND {_level(11, 12)}, false) AS frontal, CAST({' + '.join(f'CASE WHEN {_o_conf(i)} > 0.5 THEN 1 ELSE 0 END' for i in range(17))} AS INTEGER) AS points, CAST({_NF} AS INTEGER) AS face,
  round(list_avg({_FACE(0.3, _o_x, None)}), 6) AS cx,
  CASE WHEN {_NF} >= 3 AND {_SPAN(_XS)} > 0 AND {_SPAN(_YS)} > 0 THEN CAST(floor(least({_SPAN(_XS)}, {_SPAN(_YS)})) AS INTEGER) END AS face_px FROM ({DET})
"""


def head_box(spark: SparkSession, sf: str) -> DataFrame:
    """Head boxes from three face points on; keypoints lie in the person's box."""
    d = KP(VR.detections(spark, sf))
    head = G.head_box(F.col("kps"), G.box(), *_w(), least_points=3)
    return d.select(*DKEY, head.alias("h")).select(*DKEY, "h.x1", "h.y1", "h.x2", "h.y2", F.coalesce(G.head_large_enough(F.col("h")), F.lit(False)).alias("large"))


_EYES = f"CASE WHEN {_o_conf(1)} > 0.5 AND {_o_conf(2)} > 0.5 THEN 2.2 * sqrt(pow({_o_x(1)} - {_o_x(2)}, 2) + pow({_o_y(1)} - {_o_y(2)}, 2)) ELSE 0.0 END"
O_HEAD = f"""
WITH k AS (SELECT *, {_NF} AS nf, list_min({_XS}) AS ax, list_max({_XS}) AS bx, list_min({_YS}) AS ay, list_max({_YS}) AS by_, greatest(CAST(list_max({_XS}) - list_min({_XS}) AS DOUBLE), {_EYES}) AS w FROM ({DET})),
b AS (SELECT *, greatest(0, CAST(trunc(greatest(ax - 0.25 * w, x1 - 0.10 * (x2 - x1))) AS INTEGER)) AS h1, greatest(0, CAST(trunc(greatest(ay - 0.8 * w, y1 - 0.10 * (y2 - y1))) AS INTEGER)) AS h2,
  least({WIDTH}, CAST(trunc(least(bx + 0.25 * w, x2 + 0.10 * (x2 - x1))) AS INTEGER)) AS h3, least({HEIGHT}, CAST(trunc(least(by_ + 1.0 * w, y2 + 0.10 * (y2 - y1))) AS INTEGER)) AS h4 FROM k),
c AS (SELECT *, coalesce(l_partkey % 13 <> 0 AND nf >= 3 AND w > 0 AND h3 > h1 AND h4 > h2, false) AS ok FROM b)
SELECT {DKEYS}, CASE WHEN ok THEN h1 END AS x1, CASE WHEN ok THEN h2 END AS y1, CASE WHEN ok THEN h3 END AS x2, CASE WHEN ok THEN h4 END AS y2, ok AND coalesce(least(h3 - h1, h4 - h2) >= 256, false) AS large FROM c
"""


def crop_boxes(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf)
    m = G.margin_box(G.box(), *_w())
    return d.select(*DKEY, *[c.cast("long").alias(n) for c, n in zip(m, ("cx1", "cy1", "cx2", "cy2"), strict=True)], R.scaled_round(G.fade_alpha(F.col("frame"), F.lit(30.0)), 6).alias("alpha"), R.scaled_round(G.drawing_scale(F.col("y2")), 6).alias("scale"))


_M = "greatest(1, CAST(floor(({b} - {a}) * 0.3) AS BIGINT))"
_MX, _MY = _M.format(a="x1", b="x2"), _M.format(a="y1", b="y2")
O_CROP = f"""
SELECT {DKEYS}, CAST(greatest(0, x1 - {_MX}) AS BIGINT) AS cx1, CAST(greatest(0, y1 - {_MY}) AS BIGINT) AS cy1, CAST(least({WIDTH}, x2 + {_MX}) AS BIGINT) AS cx2, CAST(least({HEIGHT}, y2 + {_MY}) AS BIGINT) AS cy2,
  round(least(1.0, (frame + 1) / 9.0), 6) AS alpha, round(greatest(1.0, least(4.0, y2 / 720.0)), 6) AS scale FROM ({DET})
"""


def track_colours(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf).select("media", (F.col("l_suppkey") * 31 + F.col("track")).alias("track_id")).distinct()
    return d.select("media", "track_id", G.colour_index(F.col("track_id")).alias("colour"))


def best_candidate_general(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf).withColumn("at", F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    best = select.best_rows(d, ["media", "track"], R.scaled_round(F.col("conf") * G.area(G.box()), 6), "at")
    return best.select("media", "track", "frame", "l_partkey", "l_suppkey", "score")


_AT = "frame * 1000000000 + l_partkey * 10000 + l_suppkey"
_GENERAL = "round(conf * ((x2 - x1) * (y2 - y1)), 6)"
O_GENERAL = f"SELECT media, track, frame, l_partkey, l_suppkey, score FROM (SELECT *, {_GENERAL} AS score, row_number() OVER (PARTITION BY media, track ORDER BY {_GENERAL} DESC, {_AT}) AS n FROM ({DET})) WHERE n = 1"


def best_candidate_body(spark: SparkSession, sf: str) -> DataFrame:
    d = KP(VR.detections(spark, sf)).withColumn("at", F.col("media") * 10_000_000_000 + F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    d = d.where(G.frontal_with_waist(F.col("kps"))).withColumn("points", G.visible_points(F.col("kps"))).drop("kps")
    best = select.best_rows(d, ["track", "x1"], R.scaled_round(F.col("points") / G.area(G.box()), 12), "at")
    return best.select("track", "x1", "media", "frame", "l_partkey", "l_suppkey", R.scaled_round("score", 9).alias("score"))


_FRONTAL = f"{_WAIST} AND {_level(5, 6)} AND {_level(11, 12)}"
_BODY = f"round(({' + '.join(f'CASE WHEN {_o_conf(i)} > 0.5 THEN 1 ELSE 0 END' for i in range(17))}) / CAST((x2 - x1) * (y2 - y1) AS DOUBLE), 12)"
O_BODY = f"SELECT track, x1, media, frame, l_partkey, l_suppkey, round(s, 9) AS score FROM (SELECT *, {_BODY} AS s, row_number() OVER (PARTITION BY track, x1 ORDER BY {_BODY} DESC, media * 10000000000 + {_AT}) AS n FROM ({DET}) WHERE {_FRONTAL}) WHERE n = 1"


def best_candidate_face(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf).where("n_face >= 4 AND value >= 0")
    best = select.best_rows(o, ["user_id"], R.scaled_round(G.face_score(F.col("n_face"), F.col("value")), 9), "frame")
    return best.select("user_id", "frame", "event_id", R.scaled_round("score", 6).alias("score"))


_FS = "round(n_face + value / (value + 150.0), 9)"
O_FACE = f"SELECT user_id, frame, event_id, round({_FS}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_FS} DESC, frame) AS n FROM ({VR.OBS}) WHERE n_face >= 4 AND value >= 0) WHERE n = 1"


def partial_final_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Best of blocks, then best of those, with all frames of a track."""
    d = VR.detections(spark, sf).withColumn("at", F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).withColumn("block", F.col("l_partkey") % 4)
    score = R.scaled_round(F.col("conf") * G.area(G.box()), 6)
    part = d.groupBy("media", "track", "block").agg(F.max_by(F.struct(score.alias("s"), "at"), F.struct(score, -F.col("at"))).alias("b"), F.collect_set("frame").alias("f"))
    whole = part.groupBy("media", "track").agg(F.max_by("b", F.struct("b.s", -F.col("b.at"))).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("f"))
    return whole.select("media", "track", F.col("b.s").alias("score"), F.col("b.at").alias("pos_at"), F.array_join("f", ",").alias("frames"))


O_PARTIAL = f"SELECT b.media, b.track, b.score, b.pos_at, f.frames FROM (SELECT media, track, score, pos_at FROM (SELECT *, {_GENERAL} AS score, {_AT} AS pos_at, row_number() OVER (PARTITION BY media, track ORDER BY {_GENERAL} DESC, {_AT}) AS n FROM ({DET})) WHERE n = 1) b JOIN (SELECT media, track, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS frames FROM (SELECT DISTINCT media, track, frame FROM ({DET})) GROUP BY 1, 2) f ON b.media = f.media AND b.track = f.track"


def face_turn_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return select.face_turns(VR.observations(spark, sf), "user_id", "frame", "n_face").select("user_id", "frame", "event_id")


_TURN = "SELECT * FROM (SELECT *, lag(n_face) OVER (PARTITION BY user_id ORDER BY frame) AS p FROM ({obs})) WHERE (p >= 4 AND n_face <= 2) OR (p <= 2 AND n_face >= 4)"


def displacement_cuts(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf).withColumn("at", F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    d = d.withColumn("frame_id", F.row_number().over(select.W.partitionBy("media", "track").orderBy("at")))
    return select.displacements(d, ["media", "track"], "frame_id").select(*DKEY)


O_DISP = f"""
WITH d AS (SELECT *, row_number() OVER w AS r, lag((x1 + x2) / 2.0) OVER w AS px, lag((y1 + y2) / 2.0) OVER w AS py, lag(x2 - x1) OVER w AS pw FROM ({DET}) WINDOW w AS (PARTITION BY media, track ORDER BY {_AT}))
SELECT {DKEYS} FROM d WHERE sqrt(pow((x1 + x2) / 2.0 - px, 2) + pow((y1 + y2) / 2.0 - py, 2)) / ((x2 - x1 + pw) / 2.0) > 0.20
"""


def cut_thinning(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf)
    total = o.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    cuts = select.face_turns(o, "user_id", "frame", "n_face").groupBy("user_id").agg(F.collect_list(F.col("frame").cast("long")).alias("cuts"))
    kept = total.join(cuts, "user_id").withColumn("kept", select.thin_cuts(F.col("cuts"), F.col("total")))
    return kept.select("user_id", F.explode("kept").alias("cut"))


O_THIN = f"""
WITH RECURSIVE o AS ({VR.OBS}), t AS (SELECT user_id, count(*) AS total FROM o GROUP BY 1), c AS (SELECT user_id, frame AS cut, total FROM ({_TURN.format(obs='SELECT * FROM o')}) JOIN t USING (user_id)),
k AS (SELECT user_id, min(cut) AS cut, total FROM c WHERE cut >= 10 AND total - cut >= 10 GROUP BY user_id, total
  UNION ALL SELECT user_id, cut, total FROM (SELECT k.user_id, c.cut, c.total, row_number() OVER (PARTITION BY k.user_id, k.cut ORDER BY c.cut) AS n FROM k JOIN c ON k.user_id = c.user_id WHERE c.cut - k.cut >= 10 AND c.total - c.cut >= 10) WHERE n = 1)
SELECT user_id, CAST(cut AS BIGINT) AS cut FROM k
"""


def scene_intervals(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf)
    total = o.groupBy("user_id").agg((F.count(F.lit(1)) + 1).alias("total"))
    starts = select.face_turns(o, "user_id", "frame", "n_face").select("user_id", "frame").union(total.select("user_id", F.lit(1))).distinct()
    iv = select.intervals(starts.join(total, "user_id"), "user_id", "frame", "total")
    iv = iv.withColumn("scene", F.floor(F.col("start") / 10).cast("int"))
    return select.sub_labels(iv, ["user_id", "scene"], "start").select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label")


O_INTERVALS = f"""
WITH o AS ({VR.OBS}), t AS (SELECT user_id, count(*) + 1 AS total FROM o GROUP BY 1), s AS (SELECT DISTINCT user_id, frame FROM (SELECT user_id, frame FROM ({_TURN.format(obs='SELECT * FROM o')}) UNION ALL SELECT user_id, 1 FROM t)),
i AS (SELECT user_id, frame AS start, lead(frame, 1, total) OVER (PARTITION BY user_id ORDER BY frame) AS end_, CAST(floor(frame / 10) AS BIGINT) AS scene FROM s JOIN t USING (user_id))
SELECT user_id, CAST(start AS BIGINT) AS start, CAST(end_ AS BIGINT) AS "end", CASE WHEN count(*) OVER (PARTITION BY user_id, scene) = 1 THEN CAST(scene AS VARCHAR) ELSE scene || '.' || row_number() OVER (PARTITION BY user_id, scene ORDER BY start) END AS label FROM i
"""


def scene_asof(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf)
    cuts = o.where("event_type = 'purchase'").select("user_id", "frame")
    return joins.scene_at(o.select("user_id", "frame", "event_id"), cuts, "user_id", "frame")


O_ASOF = f"WITH o AS ({VR.OBS}) SELECT user_id, frame, event_id, CAST(greatest(1, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY frame)) AS INTEGER) AS scene FROM o"


def scene_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf)
    iv = o.where("event_type = 'error'").select("user_id", F.col("frame").alias("s"), (F.col("frame") + 4).alias("e"), F.col("event_id").alias("scene_id"))
    return joins.interval_first(o.select("user_id", "frame", "event_id"), iv, "user_id", "frame", "s", "e", "scene_id", "s", ["event_id"])


O_RANGE = f"WITH o AS ({VR.OBS}), i AS (SELECT user_id, frame AS s, frame + 4 AS e, event_id AS scene_id FROM o WHERE event_type = 'error') SELECT o.event_id, arg_min(i.scene_id, i.s) AS scene_id FROM o LEFT JOIN i ON o.user_id = i.user_id AND o.frame >= i.s AND o.frame < i.e GROUP BY o.event_id"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """The different places of each media's boxes, shuffled once, by media, into tasks of bounded size."""
    parts = parts_of(spark.read.parquet(f"{sf}/lineitem.parquet"))
    return VR.detections(spark, sf).select("media", F.col("x1").alias("at")).repartition(parts, "media").distinct()


def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    d = _places(spark, sf)
    return select.cluster_means(d, "media", "at", 18)


O_GAP = f"WITH d AS (SELECT DISTINCT media, x1 AS px FROM ({DET})), f AS (SELECT *, CASE WHEN px - lag(px) OVER (PARTITION BY media ORDER BY px) > 18 THEN 1 ELSE 0 END AS new FROM d), c AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY px) + 1 AS cluster FROM f) SELECT media, CAST(cluster AS BIGINT) AS cluster, CAST(floor(avg(px)) AS BIGINT) AS centre, count(*) AS n FROM c GROUP BY 1, 2"


def gap_splits(spark: SparkSession, sf: str) -> DataFrame:
    d = _places(spark, sf)
    return select.gap_splits(d, "media", "at", F.lit(0.15 * WIDTH))


O_SPLITS = f"SELECT media, (px + n) / 2.0 AS split FROM (SELECT *, lead(px) OVER (PARTITION BY media ORDER BY px) AS n FROM (SELECT DISTINCT media, x1 AS px FROM ({DET}))) WHERE n - px > 96.0"


def panel_grid_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs and covered area of each media's boxes, and whether they may be panels."""
    d = VR.detections(spark, sf).withColumn("at", F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    over = spatial.overlapping_pairs(d.select("media", "at", "x1", "y1", "x2", "y2"), ["media"], "at").groupBy("media").agg(F.count(F.lit(1)).alias("overlaps"))
    per = d.groupBy("media").agg(F.count(F.lit(1)).alias("n"), F.sum(G.area(G.box())).alias("covered"))
    cover = F.col("covered") / (WIDTH * HEIGHT)
    out = per.join(over, "media", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)).cast("long"))
    return out.select("media", "n", "overlaps", "covered", ((F.col("overlaps") < F.floor(F.col("n") / 2)) & (cover > 0.5) & (cover < 1.5)).alias("panels"))


O_PANEL = f"""
WITH d AS (SELECT *, {_AT} AS pos_at FROM ({DET})), o AS (SELECT a.media, count(*) AS k FROM d a JOIN d b ON a.media = b.media AND a.pos_at < b.pos_at AND {o_iou('a', 'b')} > 0 GROUP BY 1),
p AS (SELECT media, count(*) AS n, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS covered, sum((x2 - x1) * (y2 - y1)) / {WIDTH * HEIGHT} AS cover FROM d GROUP BY 1)
SELECT p.media, n, coalesce(k, 0) AS "overlaps", covered, coalesce(k, 0) < floor(n / 2) AND cover > 0.5 AND cover < 1.5 AS panels FROM p LEFT JOIN o ON p.media = o.media
"""


def dedup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose rounded product is on the threshold or over it; the join takes all that may be rounded up to it."""
    found = vectors.exact_pairs(VR.table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.30 - 1e-6)
    return found.select("label", "a", "b", R.scaled_round("similarity", 6).alias("similarity")).where("similarity >= 0.30D")


_PRODUCT = "list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))"
O_PAIRS = f"SELECT * FROM (SELECT x.label, x.vec_id AS a, y.vec_id AS b, round({_PRODUCT}, 6) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE similarity >= 0.30"


def dedup_pairs_projected(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector beside one that is nearly the same and, for every fourth, an exact copy: pairs of different vectors from 0.93 on by random projections, and who is a copy of whom."""
    e = VR.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    near = e.select((F.col("vec_id") + 10_000_000).alias("vec_id"), "label", F.expr("transform(embedding, (x, i) -> CAST(CAST(x AS DOUBLE) + CAST((vec_id + i * 7) % 11 - 5 AS DOUBLE) / 250 AS FLOAT))").alias("embedding"))
    copies = e.where("vec_id % 4 = 0").withColumn("vec_id", F.col("vec_id") + 20_000_000)
    found = vectors.projected_pairs(e.unionByName(near).unionByName(copies), "label", "vec_id", "embedding", dedup.THRESHOLD - 1e-6)
    return found.select("label", "a", "b", R.scaled_round("similarity", 6).alias("similarity"), "kind").where("kind = 'copy' OR similarity >= 0.93D")


O_PROJECTED = f"""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 10000000, label, list_transform(embedding, lambda v, i: CAST(CAST(v AS DOUBLE) + CAST((vec_id + (i - 1) * 7) % 11 - 5 AS DOUBLE) / 250 AS FLOAT)) FROM embeddings
  UNION ALL SELECT vec_id + 20000000, label, embedding FROM embeddings WHERE vec_id % 4 = 0),
m AS (SELECT *, min(vec_id) OVER (PARTITION BY label, embedding) AS first_id FROM e), c AS (SELECT * FROM m WHERE vec_id = first_id)
SELECT label, first_id AS a, vec_id AS b, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity, 'copy' AS kind FROM m WHERE vec_id <> first_id
UNION ALL SELECT *, 'near' AS kind FROM (SELECT x.label, x.vec_id AS a, y.vec_id AS b, round({_PRODUCT}, 6) AS similarity FROM c x JOIN c y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE similarity >= 0.93
"""


def dedup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of a few tens of persons, whatever the table's size; body and face candidates are there for some."""
    e = VR.table(spark, sf, "embeddings")
    scene = F.floor(F.col("vec_id") / 40)
    e = e.withColumn("score", (F.col("vec_id") * 7919 % 1000) / 1000.0).withColumn("frames", F.array(F.col("vec_id") % 97, F.col("vec_id") % 89 + 97))
    slot = lambda by, mod: F.when(F.col("vec_id") % mod != 0, F.struct(((F.col("vec_id") * by % 101) / 100.0).alias("score"), F.col("vec_id").alias("of")))
    rows = e.withColumn("scene", scene).withColumn("body", slot(31, 3)).withColumn("face", slot(47, 4))
    out = dedup.cluster_persons(rows, "scene", "vec_id", "score", "embedding", "frames", 0.15)
    merged = dedup.merge_clusters(out.join(rows.select("vec_id", "score", "frames", "body", "face"), "vec_id"), "scene", "vec_id", "frames", "score", ["body", "face"])
    return merged.select("scene", "leader", "members", "score", F.col("body.of").alias("body_of"), F.col("face.of").alias("face_of"), F.array_join("frames", ",").alias("frames"))


#: Persons in order of score join the first cluster whose leader is alike and whose frames are all others', or open one: a fold over a scene with its clusters as a list.
O_CLUSTERS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(floor(vec_id / 40) AS BIGINT) AS scene, (vec_id * 7919 % 1000) / 1000.0 AS score, CAST(embedding AS DOUBLE[]) AS v, [vec_id % 97, vec_id % 89 + 97] AS f,
    row_number() OVER (PARTITION BY floor(vec_id / 40) ORDER BY vec_id * 7919 % 1000 DESC, vec_id) AS n FROM embeddings),
a AS (SELECT y.scene, y.n, list(x.n) FILTER (WHERE list_dot_product(x.v, y.v) >= 0.15) AS alike FROM e y LEFT JOIN e x ON x.scene = y.scene AND x.n < y.n GROUP BY 1, 2),
i AS (SELECT e.scene, e.n, e.f, coalesce(a.alike, []) AS alike FROM e JOIN a USING (scene, n)),
s AS (SELECT scene, n, [{'lead': n, 'f': f}] AS c, n AS hit FROM i WHERE n = 1
  UNION ALL SELECT scene, n, CASE WHEN hit IS NULL THEN list_append(c, {'lead': n, 'f': f}) ELSE list_transform(c, lambda k: CASE WHEN k.lead = hit THEN {'lead': k.lead, 'f': list_concat(k.f, f)} ELSE k END) END AS c, coalesce(hit, n) AS hit
  FROM (SELECT i.scene, i.n, i.f, s.c, list_filter(s.c, lambda k: list_contains(i.alike, k.lead) AND NOT list_has_any(k.f, i.f))[1].lead AS hit FROM s JOIN i ON i.scene = s.scene AND i.n = s.n + 1)),
m AS (SELECT s.scene, l.vec_id AS leader, l.score AS score, e.vec_id, e.f, e.score AS own, CASE WHEN e.vec_id % 3 <> 0 THEN (e.vec_id * 31 % 101) / 100.0 END AS b, CASE WHEN e.vec_id % 4 <> 0 THEN (e.vec_id * 47 % 101) / 100.0 END AS t
  FROM s JOIN e ON e.scene = s.scene AND e.n = s.n JOIN e l ON l.scene = s.scene AND l.n = s.hit)
SELECT scene, leader, count(*) AS members, max(score) AS score, arg_max(vec_id, (b, own, -vec_id)) FILTER (WHERE b IS NOT NULL) AS body_of, arg_max(vec_id, (t, own, -vec_id)) FILTER (WHERE t IS NOT NULL) AS face_of,
  array_to_string(list_sort(list_distinct(flatten(list(f)))), ',') AS frames FROM m GROUP BY scene, leader
"""


def video_statistics(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf)
    frames = d.groupBy("media", "frame").agg(F.count(F.lit(1)).alias("n")).groupBy("media").agg(R.scaled_round(F.avg("n"), 6).alias("mean_persons"), F.max("n").alias("max_persons"))
    tracks = d.groupBy("media").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("track").alias("tracks"))
    per_track = d.groupBy("media", "track").agg(F.count(F.lit(1)).alias("n")).groupBy("media").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("track").cast("string"), "n"))))).alias("track_frames"))
    return frames.join(tracks, "media").join(per_track, "media")


O_VIDEO = f"""
WITH d AS ({DET}) SELECT f.media, f.mean_persons, f.max_persons, t.total, t.tracks, j.track_frames FROM
(SELECT media, round(avg(n), 6) AS mean_persons, max(n) AS max_persons FROM (SELECT media, frame, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1) f JOIN (SELECT media, count(*) AS total, count(DISTINCT track) AS tracks FROM d GROUP BY 1) t ON f.media = t.media
JOIN (SELECT media, '{{' || string_agg('"' || track || '":' || n, ',' ORDER BY CAST(track AS VARCHAR)) || '}}' AS track_frames FROM (SELECT media, track, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1) j ON f.media = j.media
"""


def collage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Panels (frames) of a media rolled up to it: persons, panels and the distribution of tracks over all panels."""
    d = VR.detections(spark, sf).withColumn("t", F.col("track").cast("string"))
    per = d.groupBy("media").agg(F.count(F.lit(1)).alias("persons"), F.countDistinct("frame").alias("panels"))
    return per.join(A.distribution(d, ["media"], "t"), "media")


O_COLLAGE = f"SELECT media, persons, panels, distribution FROM (SELECT media, count(*) AS persons, count(DISTINCT frame) AS panels FROM ({DET}) GROUP BY 1) JOIN (SELECT media, '{{' || string_agg('\"' || track || '\":' || n, ',' ORDER BY CAST(track AS VARCHAR)) || '}}' AS distribution FROM (SELECT media, track, count(*) AS n FROM ({DET}) GROUP BY 1, 2) GROUP BY 1) USING (media)"


def track_order(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks by first frame, then by the number in their name."""
    d = VR.detections(spark, sf).select("media", "frame", F.concat_ws("_", F.lit("det"), F.lit("0"), F.when(F.col("track") == 3, "x").otherwise(F.col("track").cast("string"))).alias("track_id"))
    per = d.groupBy("media", "track_id").agg(F.min("frame").alias("first_frame"))
    w = select.W.partitionBy("media").orderBy("first_frame", F.coalesce(T.track_index(F.col("track_id")), F.lit(999_999)), "track_id")
    return per.withColumn("place", F.row_number().over(w))


O_TRACK = f"SELECT *, CAST(row_number() OVER (PARTITION BY media ORDER BY first_frame, coalesce(TRY_CAST(split_part(track_id, '_', 3) AS INTEGER), 999999), track_id) AS INTEGER) AS place FROM (SELECT media, 'det_0_' || CASE WHEN track = 3 THEN 'x' ELSE CAST(track AS VARCHAR) END AS track_id, min(frame) AS first_frame FROM ({DET}) GROUP BY 1, 2)"


def panel_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf)
    w = select.W.partitionBy("media").orderBy(F.floor(F.col("y1") / (HEIGHT // 3)), "x1", "y1", "frame", "l_partkey", "l_suppkey")
    return d.select(*DKEY, F.row_number().over(w).alias("panel"))


O_READING = f"SELECT {DKEYS}, CAST(row_number() OVER (PARTITION BY media ORDER BY floor(y1 / 160), x1, y1, frame, l_partkey, l_suppkey) AS INTEGER) AS panel FROM ({DET})"


def queries() -> dict:
    made = (
        bbox_occupancy, media_occupancy, iou_best_match, face_person_link, iou_anti, iou_greedy, min_ratio_two_counts, proxemic_keypoints, frontal_waist, head_box, crop_boxes, track_colours, best_candidate_general, best_candidate_body, best_candidate_face,
        partial_final_merge, face_turn_cuts, displacement_cuts, cut_thinning, scene_intervals, scene_asof, scene_interval_join, gap_clusters, gap_splits, panel_grid_overlap, dedup_pairs, dedup_pairs_projected, dedup_clusters, video_statistics, collage_rollup, track_order, panel_reading_order,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    occ = f"round(CAST(100.0 AS DOUBLE) * ((x2 - x1) * (y2 - y1)) / {WIDTH * HEIGHT}, 2)"
    return {
        "bbox_occupancy": f"SELECT {DKEYS}, (x2 - x1) * (y2 - y1) AS area, {occ} AS occupancy FROM ({DET})",
        "media_occupancy": f"SELECT media, round(avg({occ}), 6) AS mean_occupancy, max({occ}) AS max_occupancy FROM ({DET}) GROUP BY media",
        "iou_best_match": O_BEST,
        "face_person_link": O_LINK,
        "iou_anti": O_ANTI,
        "min_ratio_two_counts": f"SELECT media, frame, count(*) FILTER (WHERE x2 - x1 >= 4 AND y2 - y1 >= 4) AS raw_persons, count(*) FILTER (WHERE x2 - x1 >= 4 AND y2 - y1 >= 4 AND (x2 - x1) * (y2 - y1) / {WIDTH * HEIGHT} >= 0.01) AS persons FROM ({DET}) GROUP BY 1, 2",
        "proxemic_keypoints": O_PROX,
        "frontal_waist": O_FRONT,
        "head_box": O_HEAD,
        "crop_boxes": O_CROP,
        "track_colours": f"SELECT DISTINCT media, l_suppkey * 31 + track AS track_id, CAST((l_suppkey * 31 + track) % 18 AS INTEGER) AS colour FROM ({DET})",
        "best_candidate_general": O_GENERAL,
        "best_candidate_body": O_BODY,
        "best_candidate_face": O_FACE,
        "partial_final_merge": O_PARTIAL,
        "face_turn_cuts": f"SELECT user_id, frame, event_id FROM ({_TURN.format(obs=VR.OBS)})",
        "displacement_cuts": O_DISP,
        "cut_thinning": O_THIN,
        "scene_intervals": O_INTERVALS,
        "scene_asof": O_ASOF,
        "scene_interval_join": O_RANGE,
        "gap_clusters": O_GAP,
        "gap_splits": O_SPLITS,
        "panel_grid_overlap": O_PANEL,
        "dedup_pairs": O_PAIRS,
        "dedup_pairs_projected": O_PROJECTED,
        "dedup_clusters": O_CLUSTERS,
        "iou_greedy": O_GREEDY,
        "video_statistics": O_VIDEO,
        "collage_rollup": O_COLLAGE,
        "track_order": O_TRACK,
        "panel_reading_order": O_READING,
    }
