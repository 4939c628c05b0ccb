"""Boxes and keypoints as column expressions.

A box is four columns (x1, y1, x2, y2); keypoints are an array of (x, y, conf) in COCO order: 0-4 face,
5-6 shoulders, 11-12 hips, 13-16 knees and ankles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import scaled_round

#: Thresholds, with the comparison that keeps.
IOU_KEYPOINTS = 0.3  # >
IOU_SEEN = 0.3  # dropped from (>=)
IOU_FACE = 0.5  # >=
SHOULDER_CONF, PART_CONF, POINT_CONF, CENTROID_CONF = 0.65, 0.5, 0.5, 0.3  # >=, >=, >, >
FILL_RATIO = 0.375  # >=
PUBLIC_PERSONS = 4  # >=
TILT = 0.2  # fails when >
HEAD_PX = 256  # >=
SHARPNESS_HALF = 150.0

Box = Sequence[Column]


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]


def side(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), b - a)


def area(b: Box) -> Column:
    return side(b[0], b[2]) * side(b[1], b[3])


def iou(a: Box, b: Box) -> Column:
    common = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def occupancy(b: Box, width: Column, height: Column) -> Column:
    """Percent of the frame, two decimals."""
    return scaled_round(F.lit(100.0) * area(b) / F.greatest(F.lit(1), width * height), 2)


def conf(kps: Column, i: int) -> Column:
    return F.get(kps, F.lit(i))["conf"]


def shoulders_visible(kps: Column) -> Column:
    return F.coalesce((conf(kps, 5) >= SHOULDER_CONF) & (conf(kps, 6) >= SHOULDER_CONF), F.lit(False))


def hips_visible(kps: Column) -> Column:
    return F.coalesce((conf(kps, 11) >= PART_CONF) | (conf(kps, 12) >= PART_CONF), F.lit(False))


def waist_visible(kps: Column) -> Column:
    all_four = (conf(kps, 5) > POINT_CONF) & (conf(kps, 6) > POINT_CONF) & (conf(kps, 11) > POINT_CONF) & (conf(kps, 12) > POINT_CONF)
    return F.coalesce(all_four, F.lit(False))


def level(kps: Column, i: int, j: int) -> Column:
    """Both points lie within a fifth of their distance in height; points above each other pass."""
    a, b = F.get(kps, F.lit(i)), F.get(kps, F.lit(j))
    width = F.abs(a["x"] - b["x"])
    return (width <= 0) | (F.abs(a["y"] - b["y"]) <= TILT * width)


def frontal_with_waist(kps: Column) -> Column:
    return waist_visible(kps) & F.coalesce(level(kps, 5, 6) & level(kps, 11, 12), F.lit(False))


def visible_points(kps: Column) -> Column:
    return F.coalesce(F.size(F.filter(kps, lambda k: k["conf"] > POINT_CONF)), F.lit(0))


def face_points(kps: Column, least: float = POINT_CONF) -> Column:
    return F.filter(F.slice(kps, 1, 5), lambda k: k["conf"] > least)


def face_count(kps: Column) -> Column:
    return F.coalesce(F.size(face_points(kps)), F.lit(0))


def _mean(points: Column, axis: str) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis])
    return F.when(F.size(points) > 0, total / F.size(points))


def face_centre(kps: Column) -> Column:
    points = face_points(kps, CENTROID_CONF)
    return F.struct(_mean(points, "x").alias("x"), _mean(points, "y").alias("y"))


def face_px(kps: Column) -> Column:
    """Smaller side of the face points' box with 30 % on each side; null with fewer than three points or without extent."""
    points = face_points(kps)
    extent = lambda axis: F.array_max(F.transform(points, lambda p: p[axis])) - F.array_min(F.transform(points, lambda p: p[axis]))
    w, h = extent("x") * 1.6, extent("y") * 1.6
    return F.when((F.size(points) >= 3) & (w > 0) & (h > 0), F.floor(F.least(w, h)).cast("int"))


def head_box(kps: Column, person: Box, width: Column, height: Column, least_points: int = 5) -> Column:
    """Head box from face points: a quarter of the face's width to the sides, 0.8 up and 1.0 down, within the person's box plus a tenth and the frame; null where nothing is left."""
    points = face_points(kps)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    left, right = F.get(kps, F.lit(1)), F.get(kps, F.lit(2))
    eyes = F.when((left["conf"] > POINT_CONF) & (right["conf"] > POINT_CONF), 2.2 * F.hypot(left["x"] - right["x"], left["y"] - right["y"])).otherwise(0.0)
    w = F.greatest(F.array_max(xs) - F.array_min(xs), eyes)
    mx, my = 0.10 * (person[2] - person[0]), 0.10 * (person[3] - person[1])
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")
    x1 = F.greatest(F.lit(0), whole(F.greatest(F.array_min(xs) - 0.25 * w, person[0] - mx)))
    y1 = F.greatest(F.lit(0), whole(F.greatest(F.array_min(ys) - 0.8 * w, person[1] - my)))
    x2 = F.least(width, whole(F.least(F.array_max(xs) + 0.25 * w, person[2] + mx)))
    y2 = F.least(height, whole(F.least(F.array_max(ys) + 1.0 * w, person[3] + my)))
    made = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((F.size(points) >= least_points) & (w > 0) & (x2 > x1) & (y2 > y1), made)


def head_large_enough(head: Column) -> Column:
    return F.least(head["x2"] - head["x1"], head["y2"] - head["y1"]) >= HEAD_PX


def face_score(n_face: Column, sharpness: Column) -> Column:
    """Face points first, sharpness as a fraction."""
    return n_face + sharpness / (sharpness + SHARPNESS_HALF)


def proxemic_class(kps: Column, b: Box, width: Column, height: Column, persons: Column) -> Column:
    """From keypoints: four persons or more are public, no keypoints are null, else the lowest visible part and the box's share of the frame."""
    seen = lambda *ids: F.greatest(*[conf(kps, i) for i in ids]) >= PART_CONF
    fills = area(b) / F.greatest(F.lit(1), width * height) >= FILL_RATIO
    by_parts = (
        F.when(~seen(5, 6), "intimate distance")
        .when(seen(13, 14, 15, 16), F.when(fills, "close social distance").otherwise("far social distance"))
        .when(seen(11, 12), "far personal distance")
        .otherwise("close personal distance")
    )
    return F.when(persons >= PUBLIC_PERSONS, "public distance").when(F.size(kps) >= 17, by_parts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def margin_box(b: Box, width: Column, height: Column, share: float = 0.3) -> list[Column]:
    """The box with a margin on all sides, within the frame."""
    mx = F.greatest(F.lit(1), F.floor((b[2] - b[0]) * share).cast("int"))
    my = F.greatest(F.lit(1), F.floor((b[3] - b[1]) * share).cast("int"))
    return [F.greatest(F.lit(0), b[0] - mx), F.greatest(F.lit(0), b[1] - my), F.least(width, b[2] + mx), F.least(height, b[3] + my)]


def fade_alpha(k: Column, fps: Column) -> Column:
    return F.least(F.lit(1.0), (k + 1) / F.greatest(F.lit(1), F.round(fps * 0.3)))


def drawing_scale(height: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(4.0), height / 720.0))


def colour_index(track: Column, colours: int = 18) -> Column:
    """Place of a track's colour: its number by the number of colours, for names by their hash."""
    name = track.cast("string")
    return F.pmod(F.coalesce(name.try_cast("bigint"), F.xxhash64(name)), F.lit(colours)).cast("int")


def duration(frames: Column, fps: Column) -> Column:
    return F.try_divide(frames, F.coalesce(fps, F.lit(30.0)))
