"""Catalogue: containers' headers, scene cuts, sharpness and panel lines from bytes.

The bytes are made of the tables' numbers by expressions that both engines can state, so every number that is read back is known.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as PX
from ..functions import rounding as R
from ..operators import frames, panels
from ..sources import containers
from ..sources.tables import written
from . import virtual as VR

KEYS = ", ".join(VR.KEY)


# ---- containers


def _be(value: str | int, size: int) -> str:
    return f"lpad(hex(CAST({value} AS BIGINT)), {2 * size}, '0')"


def _le(value: str | int, size: int = 4) -> str:
    return "concat(" + ", ".join(f"lpad(hex(CAST(floor(({value}) / {256**k}) AS BIGINT) % 256), 2, '0')" for k in range(size)) + ")"


def _raw(text: bytes) -> str:
    return f"'{text.hex()}'"


def _joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _box(kind: bytes, size: int | str, *parts: str, wide: bool = False) -> str:
    """Hex text of a box; ``size`` is its payload's."""
    head = (_be(1, 4), _raw(kind), _be(f"{size} + 16", 8)) if wide else (_be(f"{size} + 8", 4), _raw(kind))
    return _joined(*head, *parts)


COUNTS = ("(l_orderkey % 1000 + 1)", "(l_partkey % 500)")
STEPS = ("(l_suppkey % 3000 + 1)", "(l_linenumber * 100)")
TICKS = f"({COUNTS[0]} * {STEPS[0]} + {COUNTS[1]} * {STEPS[1]})"
CLOCK = "(l_partkey % 89000 + 1000)"
PAD = "(l_partkey % 40)"


def _mp4(wide: bool) -> str:
    zeros = lambda n: f"repeat('00', {n})"
    stamp = _joined(zeros(20), _be(CLOCK, 4), _be(TICKS, 8)) if wide else _joined(zeros(12), _be(CLOCK, 4), _be(TICKS, 4))
    version = _joined("'01000000'", f"substr({stamp}, 9)") if wide else stamp
    clock = 32 if wide else 20
    tkhd = _box(b"tkhd", 84, zeros(76), _be("(l_suppkey % 1920 + 1) * 65536", 4), _be("(l_partkey % 1080 + 1) * 65536", 4))
    stts = _box(b"stts", 24, zeros(4), _be(2, 4), *(_be(v, 4) for pair in zip(COUNTS, STEPS, strict=True) for v in pair))
    minf = _box(b"minf", 40, _box(b"stbl", 32, stts))
    hdlr = _box(b"hdlr", 24, zeros(8), _raw(b"vide"), zeros(12))
    mdia = _box(b"mdia", 8 + clock + 32 + 48, _box(b"mdhd", clock, version), hdlr, minf)
    sound = _box(b"trak", 40, _box(b"mdia", 32, _box(b"hdlr", 24, zeros(8), _raw(b"soun"), zeros(12))))

    inner = 8 + clock + 48 + 8 + 92 + 8 + 8 + clock + 32 + 48
    moov = _box(b"moov", inner, _box(b"mvhd", clock, version), sound, _box(b"trak", 92 + 8 + 8 + clock + 32 + 48, tkhd, mdia), wide=wide)
    return _joined(_box(b"ftyp", 8, _raw(b"isom"), zeros(4)), _box(b"free", PAD, f"repeat('00', {PAD})"), _box(b"mdat", "l_linenumber", "repeat('ff', l_linenumber)"), moov)


def _avi() -> str:
    avih = _joined(_raw(b"avih"), _le(56), _le(40000), "repeat('00', 12)", _le(COUNTS[0]), "repeat('00', 12)", _le("l_suppkey % 1920 + 1"), _le("l_partkey % 1080 + 1"), "repeat('00', 16)")
    strh = _joined(_raw(b"strh"), _le(28), _raw(b"vids"), "repeat('00', 16)", _le(STEPS[0]), _le(CLOCK))
    strl = _joined(_raw(b"LIST"), _le(40), _raw(b"strl"), strh)
    hdrl = _joined(_raw(b"LIST"), _le(116), _raw(b"hdrl"), avih, strl)
    junk = _joined(_raw(b"JUNK"), _le(PAD), f"repeat('00', {PAD} + {PAD} % 2)")
    return _joined(_raw(b"RIFF"), _le(500), _raw(b"AVI "), junk, hdrl)


#: Lengths in milliseconds that Matroska files say, as doubles.
LENGTHS = [1000.0, 61_234.0, 3_600_000.0, 520.0, 12_345.0]
FRAME_NS = [40_000_000, 20_000_000, 50_000_000]


def _mkv() -> str:
    length = VR.cases("l_suppkey", [struct.pack(">d", x).hex() for x in LENGTHS])
    step = VR.cases("l_partkey", [n.to_bytes(4, "big").hex() for n in FRAME_NS])
    info = _joined("'1549a96692'", "'2ad7b183'", "'0f4240'", "'448988'", length)
    track = _joined("'1654ae6b97'", "'ae95'", "'838101'", "'23e38384'", step, "'e088'", "'b082'", _be("l_suppkey % 1920 + 1", 2), "'ba82'", _be("l_partkey % 1080 + 1", 2))
    return _joined("'1a45dfa3'", "'84'", "'00000000'", "'18538067'", "'01ffffffffffffff'", "'ec'", _be(f"128 + {PAD}", 1), f"repeat('00', {PAD})", info, track, "'1f43b67581'", "'00'")


KIND = "l_orderkey % 6"
CONTENT = f"CASE {KIND} WHEN 0 THEN {_mp4(False)} WHEN 1 THEN {_mp4(True)} WHEN 2 THEN {_avi()} WHEN 3 THEN {_mkv()} WHEN 4 THEN substr({_mp4(False)}, 1, 60) ELSE hex(concat('no media ', l_partkey)) END"


def container_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all kinds, one a line item: boxes of both size forms, chunks, elements, cut files and others."""
    files = VR.table(spark, sf, "lineitem").select(*VR.KEY, F.expr(f"unhex({CONTENT})").alias("content"))
    h = containers.header_of(F.col("content"))
    return files.select(*VR.KEY, h.alias("h")).select(*VR.KEY, "h.container", "h.frames", "h.width", "h.height", R.scaled_round("h.duration_s", 6).alias("duration_s"))


_LENGTH = "CAST(" + VR.cases("l_suppkey", [str(x) for x in LENGTHS]) + " AS DOUBLE)"
_STEP = "CAST(" + VR.cases("l_partkey", [str(x) for x in FRAME_NS]) + " AS DOUBLE)"
_FRAMES = f"CAST(round({_LENGTH} * 1e6 / {_STEP}) AS BIGINT)"
_KNOWN = f"{KIND} IN (0, 1, 2, 3)"
O_HEADERS = f"""
SELECT {KEYS}, CASE {KIND} WHEN 0 THEN 'mp4' WHEN 1 THEN 'mp4' WHEN 2 THEN 'avi' WHEN 3 THEN 'matroska' WHEN 4 THEN 'mp4' END AS container,
  CASE {KIND} WHEN 0 THEN {COUNTS[0]} + {COUNTS[1]} WHEN 1 THEN {COUNTS[0]} + {COUNTS[1]} WHEN 2 THEN {COUNTS[0]} WHEN 3 THEN {_FRAMES} END AS frames,
  CASE WHEN {_KNOWN} THEN CAST(l_suppkey % 1920 + 1 AS INTEGER) END AS width, CASE WHEN {_KNOWN} THEN CAST(l_partkey % 1080 + 1 AS INTEGER) END AS height,
  round(CASE {KIND} WHEN 0 THEN CAST({TICKS} AS DOUBLE) / {CLOCK} WHEN 1 THEN CAST({TICKS} AS DOUBLE) / {CLOCK} WHEN 2 THEN CAST({COUNTS[0]} * {STEPS[0]} AS DOUBLE) / {CLOCK} WHEN 3 THEN {_FRAMES} * {_STEP} / 1e9 END, 6) AS duration_s
FROM lineitem
"""


# ---- scene cuts


LEVEL = "(CASE event_type WHEN 'purchase' THEN 90 WHEN 'error' THEN 40 ELSE 0 END + event_id % 11)"
PIXELS = 16


def content_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Scene cuts of users' events taken as frames; a frame's bytes follow from its event."""
    level = f"unhex(array_join(transform(sequence(0, {3 * PIXELS - 1}), i -> lpad(hex(CAST(({LEVEL} + i * 3) % 256 AS BIGINT)), 2, '0')), ''))"
    seen = VR.observations(spark, sf).select("user_id", "frame", F.expr(level).alias("pixels"))
    return frames.content_cuts(seen, "user_id", "frame", "pixels", "hsv", 27.0, 5, 16)


O_CONTENT = f"""
WITH RECURSIVE o AS (SELECT user_id, frame, {LEVEL} AS v FROM ({VR.OBS})), p AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY frame) AS u FROM o),
c AS (SELECT user_id, frame AS cut FROM p WHERE u IS NOT NULL AND list_sum(list_transform(range(0, {3 * PIXELS}), lambda i: abs((v + i * 3) % 256 - (u + i * 3) % 256))) / {3 * PIXELS}.0 >= 27),
k AS (SELECT user_id, min(cut) AS cut FROM c WHERE cut - 1 >= 5 GROUP BY user_id
  UNION ALL SELECT user_id, cut FROM (SELECT k.user_id, c.cut, row_number() OVER (PARTITION BY k.user_id, k.cut ORDER BY c.cut) AS n FROM k JOIN c ON k.user_id = c.user_id WHERE c.cut - k.cut >= 5) WHERE n = 1)
SELECT user_id, CAST(cut AS BIGINT) AS frame FROM k
"""


# ---- sharpness


CROP_W, CROP_H = 6, 5
GREY = f"(l_partkey * (i % {CROP_W} + 1) + l_suppkey * (i * i % 7) + l_orderkey * (CAST(floor(i / {CROP_W}) AS BIGINT) % 3)) % 256"


def face_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    crop = f"unhex(array_join(transform(sequence(0L, {CROP_W * CROP_H - 1}L), i -> lpad(hex({GREY}), 2, '0')), ''))"
    rows = VR.table(spark, sf, "lineitem").select(*VR.KEY, F.expr(crop).alias("crop"))
    return rows.select(*VR.KEY, R.scaled_round(PX.sharpness(F.col("crop"), F.lit(CROP_W), F.lit(CROP_H)), 6).alias("sharpness"))


def _mirrored(x: str, size: int) -> str:
    return f"(CASE WHEN {x} < 0 THEN -({x}) WHEN {x} >= {size} THEN {2 * size - 2} - ({x}) ELSE {x} END)"


def _grey_at(dx: int, dy: int) -> str:
    return f"g[{_mirrored(f'i // {CROP_W} + {dy}', CROP_H)} * {CROP_W} + {_mirrored(f'i % {CROP_W} + {dx}', CROP_W)} + 1]"


_LAPLACIAN = f"{_grey_at(1, 0)} + {_grey_at(-1, 0)} + {_grey_at(0, 1)} + {_grey_at(0, -1)} - 4 * {_grey_at(0, 0)}"
O_SHARP = f"""
WITH g AS (SELECT {KEYS}, list_transform(range(0, {CROP_W * CROP_H}), lambda i: {GREY.replace('floor(i / ', 'floor(i // ')}) AS g FROM lineitem)
SELECT {KEYS}, round(list_var_pop(list_transform(range(0, {CROP_W * CROP_H}), lambda i: CAST({_LAPLACIAN} AS DOUBLE))), 6) AS sharpness FROM g
"""


# ---- panel lines


PIC_W, PIC_H = 60, 40
DIVIDER, DRIFT, STEP, ROW = "(20 + s_suppkey % 20)", "(s_suppkey % 3 - 1)", "(s_suppkey % 4 * 45)", "(12 + s_suppkey % 15)"
SHADE = f"(40 + CASE WHEN x < {DIVIDER} + CAST(floor(y * {DRIFT} / {PIC_H}.0) AS BIGINT) THEN 0 ELSE {STEP} END + CASE WHEN s_suppkey % 2 = 1 AND y >= {ROW} THEN 70 ELSE 0 END)"
LINES = {"votes": 30, "least": 20, "gap": 5, "margin": 6, "contrast": 30.0}


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    shade = SHADE.replace("x <", f"i % {PIC_W} <").replace("(y *", f"(floor(i / {PIC_W}) *").replace("AND y >=", f"AND floor(i / {PIC_W}) >=")
    picture = f"unhex(array_join(transform(sequence(0L, {PIC_W * PIC_H - 1}L), i -> lpad(hex(CAST({shade} AS BIGINT)), 2, '0')), ''))"
    # a few bytes a row become a picture, so however small the table is, all cores work on it
    rows = VR.table(spark, sf, "supplier").select("s_suppkey").repartition(spark.sparkContext.defaultParallelism)
    return rows.select("s_suppkey", F.expr(picture).alias("picture"))


def _divided(spark: SparkSession, sf: str) -> DataFrame:
    size = (F.lit(PIC_W), F.lit(PIC_H))
    # pictures are worked on once: edges and means are written, as both kinds of lines ask for them twice
    seen = _pictures(spark, sf).select("s_suppkey", PX.edge_points(F.col("picture"), *size, 60).alias("edges"), PX.side_means(F.col("picture"), *size).alias("m"))
    seen = written(seen, "pictures")
    points = seen.select("s_suppkey", F.explode("edges").alias("p")).select("s_suppkey", "p.x", "p.y")
    means = seen.select("s_suppkey", "m.across", "m.down")
    return panels.dividing_lines(points, means, "s_suppkey", PIC_W, PIC_H, **LINES)


def panel_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Dividing lines of pictures with one vertical or leaning divider and, in every second, a horizontal one."""
    cut = _divided(spark, sf)
    return cut.select("s_suppkey", F.array_join(cut["across"].cast("array<string>"), ",").alias("across"), F.array_join(cut["down"].cast("array<string>"), ",").alias("down"))


def panel_line_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The panels between the dividing lines."""
    return panels.grid(_divided(spark, sf), "across", "down", PIC_W, PIC_H)


def _values(numbers: list[int]) -> str:
    return "[" + ", ".join(map(str, numbers)) + "]"


def _clamped(x: str, y: str) -> str:
    return f"pic[least(greatest({y}, 0), {PIC_H - 1}) * {PIC_W} + least(greatest({x}, 0), {PIC_W - 1}) + 1]"


_PLACE = "f + CAST(floor(d * {spot} / size) AS BIGINT)"
_SIDE = lambda values, a: f"list_avg(list_slice({values}, {a}, {a} + {LINES['margin'] - 1}))"
_LINES_SQL = f"""
WITH pic AS (SELECT s_suppkey, list_transform(range(0, {PIC_W * PIC_H}), lambda i: {SHADE.replace('x <', f'i % {PIC_W} <').replace('(y *', f'((i // {PIC_W}) *').replace('AND y >=', f'AND i // {PIC_W} >=')}) AS pic FROM supplier),
m AS (SELECT s_suppkey, list_transform(range(0, {PIC_W}), lambda x: list_avg(list_transform(range(0, {PIC_H}), lambda y: pic[y * {PIC_W} + x + 1]))) AS across, list_transform(range(0, {PIC_H}), lambda y: list_avg(list_transform(range(0, {PIC_W}), lambda x: pic[y * {PIC_W} + x + 1]))) AS down FROM pic),
e AS (SELECT s_suppkey, x, y FROM (SELECT s_suppkey, pic, i % {PIC_W} AS x, i // {PIC_W} AS y FROM pic, range(0, {PIC_W * PIC_H}) r(i)) WHERE abs({_clamped('x + 1', 'y')} - {_clamped('x - 1', 'y')}) + abs({_clamped('x', 'y + 1')} - {_clamped('x', 'y - 1')}) >= 60),
v AS (SELECT s_suppkey, 'v' AS kind, {PIC_H} AS size, d, x - CAST(floor(d * y / {PIC_H}.0) AS BIGINT) AS f, y AS spot FROM (SELECT *, unnest({_values(panels.drifts(PIC_H))}) AS d FROM e)
  UNION ALL SELECT s_suppkey, 'h', {PIC_W}, d, y - CAST(floor(d * x / {PIC_W}.0) AS BIGINT), x FROM (SELECT *, unnest({_values(panels.drifts(PIC_W))}) AS d FROM e)),
s AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey, kind, d, f) AS n, CASE WHEN spot - lag(spot) OVER (PARTITION BY s_suppkey, kind, d, f ORDER BY spot) > {LINES['gap']} THEN 1 ELSE 0 END AS new FROM v),
r AS (SELECT *, sum(new) OVER (PARTITION BY s_suppkey, kind, d, f ORDER BY spot) AS run FROM s WHERE n >= {LINES['votes']}),
p AS (SELECT s_suppkey, kind, size, d, f, min(spot) AS a, max(spot) AS b FROM r GROUP BY s_suppkey, kind, size, d, f, run),
q AS (SELECT DISTINCT s_suppkey, kind, {PIC_W + PIC_H} - size AS other, (({_PLACE.format(spot='a')}) + ({_PLACE.format(spot='b')})) // 2 AS pos FROM p WHERE b - a >= {max(LINES['least'], 0.4 * min(PIC_W, PIC_H))} AND b - a > 0.5 * size),
t AS (SELECT q.*, CASE WHEN kind = 'v' THEN across ELSE down END AS w FROM q JOIN m USING (s_suppkey)),
u AS (SELECT s_suppkey, kind, pos, other FROM t WHERE pos >= {LINES['margin']} AND pos <= other - {LINES['margin']} AND abs({_SIDE('w', f"(pos - {LINES['margin'] - 1})")} - {_SIDE('w', '(pos + 1)')}) > {LINES['contrast']}),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY s_suppkey, kind ORDER BY pos) > other * 0.03 THEN 1 ELSE 0 END AS new FROM u),
c AS (SELECT s_suppkey, kind, CAST(floor(avg(pos)) AS BIGINT) AS cut FROM (SELECT *, sum(new) OVER (PARTITION BY s_suppkey, kind ORDER BY pos) AS k FROM g) GROUP BY s_suppkey, kind, k),
l AS (SELECT s_suppkey, list_sort(coalesce(list(cut) FILTER (kind = 'v'), [])) AS across, list_sort(coalesce(list(cut) FILTER (kind = 'h'), [])) AS down FROM c GROUP BY s_suppkey)
"""
O_LINES = f"{_LINES_SQL} SELECT s_suppkey, array_to_string(across, ',') AS across, array_to_string(down, ',') AS down FROM l"


def _between(cuts: str, side: int) -> str:
    every = f"list_sort(list_distinct(list_concat(list_concat([0], list_filter({cuts}, lambda c: c > {0.1 * side} AND c < {0.9 * side})), [{side}])))"
    return f"list_filter(list_transform(range(1, len({every})), lambda i: {{'spot': ({every})[i], 'size': ({every})[i + 1] - ({every})[i]}}), lambda p: p.size > {0.15 * side})"


O_LINE_GRID = f"""
{_LINES_SQL}, x AS (SELECT s_suppkey, unnest({_between('across', PIC_W)}) AS c, {_between('down', PIC_H)} AS rows FROM l), z AS (SELECT s_suppkey, c, unnest(rows) AS r FROM x)
SELECT s_suppkey, CAST(c.spot AS BIGINT) AS x, CAST(r.spot AS BIGINT) AS y, CAST(c.size AS BIGINT) AS w, CAST(r.size AS BIGINT) AS h FROM z
"""


def queries() -> dict:
    return {f.__name__: f for f in (container_headers, content_cuts, face_sharpness, panel_lines, panel_line_grid)}


def oracle_sql() -> dict[str, str]:
    return {"container_headers": O_HEADERS, "content_cuts": O_CONTENT, "face_sharpness": O_SHARP, "panel_lines": O_LINES, "panel_line_grid": O_LINE_GRID}
