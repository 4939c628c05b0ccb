"""Containers, pixels, scene cuts and panel lines from bytes, against files and arrays built here."""

import colorsys
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.functions import pixels as PX
from prismara.operators import frames, panels
from prismara.sources import media
from prismara.sources.containers import Header, probe_contents, read_header


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def mp4(counts, scale, size=(640, 360), wide=False, movie_ticks=0, video=True):
    ticks = sum(n * d for n, d in counts)
    stamp = bytes([1, 0, 0, 0]) + bytes(16) + struct.pack(">IQ", scale, ticks) if wide else bytes(12) + struct.pack(">II", scale, ticks)
    movie = bytes(12) + struct.pack(">II", 1000, movie_ticks)
    stts = box(b"stts", bytes(4), struct.pack(">I", len(counts)), *(struct.pack(">II", *c) for c in counts))
    track = box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", size[0] << 16, size[1] << 16)), box(b"mdia", box(b"mdhd", stamp), box(b"hdlr", bytes(8), b"vide" if video else b"soun", bytes(12)), box(b"minf", box(b"stbl", stts))))
    sound = box(b"trak", box(b"mdia", box(b"mdhd", bytes(12), struct.pack(">II", 44100, 99)), box(b"hdlr", bytes(8), b"soun")))
    return box(b"ftyp", b"isom", bytes(4)) + box(b"mdat", b"\xff" * 50, wide=wide) + box(b"moov", box(b"mvhd", movie), sound, track)


def avi(frames_, micros, rate=None):
    avih = b"avih" + struct.pack("<I", 56) + struct.pack("<IIIIIIIIII", micros, 0, 0, 0, frames_, 0, 1, 0, 320, 240) + bytes(16)
    strl = b""
    if rate:
        strh = b"strh" + struct.pack("<I", 28) + b"vids" + bytes(16) + struct.pack("<II", *rate)
        strl = b"LIST" + struct.pack("<I", len(strh) + 4) + b"strl" + strh
    hdrl = b"LIST" + struct.pack("<I", len(avih) + len(strl) + 4) + b"hdrl" + avih + strl
    return b"RIFF" + struct.pack("<I", 4000) + b"AVI " + b"JUNK" + struct.pack("<I", 3) + bytes(4) + hdrl


def element(ident, body, unknown=False):
    return ident + (b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else struct.pack(">Q", len(body) | 1 << 56)) + body


def matroska(ticks, step=None, unknown=False):
    info = element(b"\x15\x49\xa9\x66", element(b"\x2a\xd7\xb1", struct.pack(">I", 1_000_000)) + element(b"\x44\x89", struct.pack(">f", ticks)))
    video = element(b"\x83", b"\x01") + (element(b"\x23\xe3\x83", struct.pack(">I", step)) if step else b"") + element(b"\xe0", element(b"\xb0", b"\x02\x80") + element(b"\xba", b"\x01\x68"))
    sound = element(b"\x83", b"\x02") + element(b"\x23\xe3\x83", struct.pack(">I", 7))
    tracks = element(b"\x16\x54\xae\x6b", element(b"\xae", sound) + element(b"\xae", video))
    return element(b"\x1a\x45\xdf\xa3", bytes(4)) + element(b"\x18\x53\x80\x67", element(b"\xec", bytes(9)) + info + tracks + element(b"\x1f\x43\xb6\x75", b"\x00" * 5, unknown), unknown)


def test_headers_of_all_containers():
    assert read_header(mp4([(100, 512), (20, 1024)], 12800)).duration == pytest.approx((100 * 512 + 20 * 1024) / 12800)
    assert read_header(mp4([(100, 512)], 12800, wide=True)) == Header("mp4", 100, 25.0, 640, 360, 4.0)
    assert read_header(mp4([(10, 1)], 10, video=False, movie_ticks=7500)).duration == 7.5
    assert read_header(avi(250, 40_000)).duration == pytest.approx(10.0)
    assert read_header(avi(250, 40_000, (1001, 30_000))).duration == pytest.approx(250 * 1001 / 30_000)
    assert read_header(matroska(2000.0)) == Header("matroska", None, None, 640, 360, 2.0)
    assert read_header(matroska(2000.0, 20_000_000, unknown=True)) == Header("matroska", 100, 50.0, 640, 360, 2.0)
    assert all(read_header(x) is None for x in (None, b"", b"RIFF1234WAVE....", b"not a video at all", b"\x89PNG\r\n\x1a\n0000"))
    assert read_header(avi(0, 40_000)).duration is None and read_header(mp4([], 1000)).duration is None


def test_cut_and_damaged_files_never_fail():
    draw = random.Random(2)
    for whole in (mp4([(100, 512)], 12800), mp4([(3, 5)], 10, wide=True), avi(9, 40_000, (1, 25)), matroska(99.0, 40_000_000, True)):
        for n in range(len(whole)):
            read_header(whole[:n])
        for _ in range(2000):
            hurt = bytearray(whole)
            for _ in range(draw.randint(1, 6)):
                hurt[draw.randrange(len(hurt))] = draw.randrange(256)
            read_header(bytes(hurt))


def test_durations_of_a_folder(spark, tmp_path):
    for name, content in {"a.mp4": mp4([(50, 2)], 50), "b.avi": avi(60, 50_000), "c.mkv": b"broken", "d.mp4": mp4([(1, 9)], 3)}.items():
        (tmp_path / name).write_bytes(content)
    listed = media.list_media(spark, str(tmp_path)).select(F.col("stem").alias("media_id"), "path")
    cache = spark.createDataFrame([("d", 99.0)], "media_id string, duration_s double")
    assert [tuple(r) for r in media.refresh_durations(cache, listed).collect()] == [("a", 2.0), ("b", 3.0), ("d", 99.0)]
    assert media.refresh_durations(cache, listed.where("media_id = 'd'")).count() == 1
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("media_id", media.stem(F.col("path")))
    assert {r[0]: r[1] for r in probe_contents(files).collect()} == {"a": 2.0, "b": 3.0, "c": None, "d": 3.0}


def test_hues_match_the_standard_library():
    draw = np.random.default_rng(5)
    bgr = np.concatenate([draw.integers(0, 256, (500, 3)), np.array([[0, 0, 0], [255, 255, 255], [7, 7, 7], [0, 0, 255], [255, 0, 254]])]).astype(np.uint8)
    for (b, g, r), got in zip(bgr.tolist(), PX.hsv(bgr).tolist(), strict=True):
        h, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        assert min(abs(got[0] - h * 180), abs(got[0] - h * 180 + 180), abs(got[0] - h * 180 - 180)) <= 0.51
        assert abs(got[1] - s * 255) <= 0.51 and got[2] == round(v * 255)


def plain_laplacian(image):
    h, w = len(image), len(image[0])
    mirror = lambda i, n: 0 if n == 1 else -i if i < 0 else 2 * n - 2 - i if i >= n else i
    at = lambda y, x: float(image[mirror(y, h)][mirror(x, w)])
    values = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values)


def test_sharpness(spark):
    draw, rows, want = random.Random(4), [], {}
    for k in range(60):
        w, h = draw.choice([(1, 1), (1, 5), (4, 1), (3, 3), (7, 5)])
        data = bytes(draw.randrange(256) for _ in range(w * h))
        rows.append((k, bytearray(data), w, h))
        want[k] = plain_laplacian([list(data[y * w : y * w + w]) for y in range(h)])
    rows += [(100, None, 3, 3), (101, bytearray(b""), 0, 0), (102, bytearray(b"abc"), 2, 2), (103, bytearray(b"abcd"), None, 2)]
    want |= dict.fromkeys(range(100, 104), 0.0)
    df = spark.createDataFrame(rows, "k int, p binary, w int, h int")
    got = {r[0]: r[1] for r in df.select("k", PX.sharpness(F.col("p"), F.col("w"), F.col("h"))).collect()}
    assert got == pytest.approx(want)
    coloured = spark.createDataFrame([(bytearray(range(27)),)], "p binary").select(PX.sharpness(F.col("p"), F.lit(3), F.lit(3), 3)).first()[0]
    assert coloured == pytest.approx(plain_laplacian(PX.grey(np.arange(27, dtype=np.uint8).reshape(3, 3, 3)).tolist()))


def test_content_values_over_blocks_and_gaps(spark):
    draw = np.random.default_rng(1)
    film = {f: draw.integers(0, 256, 30, dtype=np.uint8) for f in [*range(3, 40), *range(42, 60)]}
    rows = [("m", f, bytearray(x.tobytes())) for f, x in film.items()] + [("n", 0, bytearray(b"abc")), ("n", 1, None), ("n", 2, bytearray(b"abcdef")), ("n", 3, bytearray(b"bcdefg"))]
    got = {(r[0], r[1]): r[2] for r in frames.content_values(spark.createDataFrame(rows, "media string, frame long, p binary"), "media", "frame", "p", block=8).collect()}
    want = {("m", f): float(np.abs(x.astype(int) - film[f - 1].astype(int)).mean()) if f - 1 in film else None for f, x in film.items()}
    assert got == want | {("n", 0): None, ("n", 1): None, ("n", 2): None, ("n", 3): 1.0}


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_spaced_is_the_plain_fold(spark, block):
    draw, rows, firsts, want = random.Random(block), [], [], set()
    for key in range(40):
        first = draw.randint(0, 30)
        cuts = sorted(draw.sample(range(first, first + 400), draw.randint(1, 150)))
        firsts.append((key, first))
        rows += [(key, c) for c in cuts] + [(key, cuts[0])]
        last = first
        for c in cuts:
            if c - last >= 5:
                want.add((key, c))
                last = c
    got = frames.spaced(spark.createDataFrame(rows, "k int, f long"), spark.createDataFrame(firsts, "k int, first long"), "k", "f", "first", 5, block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_scene_cuts_of_coloured_frames(spark):
    shades = [(10, 20, 200)] * 8 + [(200, 30, 20)] * 3 + [(20, 200, 30)] * 9
    rows = [(1, f, bytearray(bytes(s) * 16)) for f, s in enumerate(shades)]
    cuts = frames.content_cuts(spark.createDataFrame(rows, "v int, f int, p binary"), "v", "f", "p", kind="bgr")
    assert [tuple(r) for r in cuts.collect()] == [(1, 8)]  # the next change comes three frames later


def test_dividing_lines_of_a_collage(spark):
    draw = np.random.default_rng(3)
    w, h = 300, 240
    collage = draw.integers(0, 12, (h, w))
    for y in range(h):
        collage[y, 150 + (y * 6) // h :] += 120  # leans by six pixels
    collage[90:, :] += 80
    plain = draw.integers(0, 12, (h, w))
    rows = [(k, bytearray(x.astype(np.uint8).tobytes())) for k, x in (("collage", collage), ("plain", plain))]
    size = (F.lit(w), F.lit(h))
    pics = spark.createDataFrame(rows, "k string, p binary")
    points = pics.select("k", F.explode(PX.edge_points(F.col("p"), *size, 70)).alias("e")).select("k", "e.x", "e.y")
    means = pics.select("k", PX.side_means(F.col("p"), *size).alias("m")).select("k", "m.across", "m.down")
    cuts = panels.dividing_lines(points, means, "k", w, h, votes=100, least=100, gap=20)
    found = cuts.collect()
    assert len(found) == 1 and found[0]["k"] == "collage"
    assert len(found[0]["across"]) == 1 and abs(found[0]["across"][0] - 152) <= 3
    assert len(found[0]["down"]) == 1 and abs(found[0]["down"][0] - 90) <= 2
    assert panels.grid(cuts, "across", "down", w, h).count() == 4
    nothing = panels.dividing_lines(points.limit(0), means, "k", w, h)
    assert nothing.count() == 0


def test_pictures_of_a_small_table_are_dealt_over_the_cores(spark, tiny):
    """A few bytes a row become a picture: one row group must not be one task's work."""
    from prismara.plans.pixels import _pictures

    assert _pictures(spark, tiny).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
