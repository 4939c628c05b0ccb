"""Workbooks written and read again, aborted writes, and frame ranges of uncompressed videos."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismara.operators import frames as scenes
from prismara.sources import workbook
from prismara.sources.frames import read_frames
from prismara.sources.sheets import read_sheet, stream_rows

TEXTS = ["plain", "", None, "a & b < c > \"d\" 'e'", "  spaces ", "line\nbreak", "tab\tcr\r", "\x00\x1f control", "_x0041_ literal", "é🙂 ", "=1+1"]


def test_workbook_reads_back(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    rows = [(k, t, k / 4, k % 2 == 0, 2**60 + k) for k, t in enumerate(TEXTS)] + [(99, "x", None, None, None)]
    df = spark.createDataFrame(rows, "n int, text string, share double, flag boolean, large long").repartition(3).orderBy("n")
    workbook.write_workbook({"all": df, "none & <few>": df.limit(0)}, path)
    back = read_sheet(spark, path, "all").collect()
    assert [r["text"] for r in back] == [r[1] for r in rows]
    assert [r["n"] for r in back] == [str(r[0]) for r in rows] and back[3]["share"] == "0.75" and back[0]["flag"] == "1" and back[1]["large"] == str(2**60 + 1)
    assert back[-1]["share"] is None
    assert read_sheet(spark, path, "none & <few>").count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "[Content_Types].xml" in z.namelist()


def test_sheets_are_added_and_replaced(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    one, two = spark.createDataFrame([("1",)], "a string"), spark.createDataFrame([("2",)], "a string")
    workbook.write_workbook({"x": one, "y": one}, path)
    two.write.format("workbook").option("sheet", "x").mode("append").save(path)
    assert [n for n, _ in workbook.sheet_parts(path)] == ["y", "x"]
    assert read_sheet(spark, path, "x").first()["a"] == "2" and read_sheet(spark, path, "y").first()["a"] == "1"
    workbook.write_workbook({"z/": two}, path)
    assert [n for n, _ in workbook.sheet_parts(path)] == ["z_"]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "kept.xlsx")
    workbook.write_workbook({"s": spark.createDataFrame([("old",)], "a string")}, path)
    before = (tmp_path / "kept.xlsx").read_bytes()
    failing = spark.range(4000).repartition(4).select(F.when(F.col("id") == 3500, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception, match="broken row"):
        workbook.write_workbook({"s": failing}, path)
    assert (tmp_path / "kept.xlsx").read_bytes() == before
    assert [p.name for p in tmp_path.iterdir()] == ["kept.xlsx"]


def test_blocked_targets_and_full_sheets(spark, tmp_path, monkeypatch):
    (tmp_path / "blocked.xlsx").mkdir()
    (tmp_path / "blocked.xlsx" / "in use").write_text("")
    df = spark.range(10).select(F.col("id").cast("string").alias("a"))
    workbook.write_workbook({"s": df}, str(tmp_path / "blocked.xlsx"), str(tmp_path / "copy.xlsx"))
    assert read_sheet(spark, str(tmp_path / "copy.xlsx")).count() == 10
    with pytest.raises(ValueError, match="can be opened"):
        workbook.local_path("hdfs://a/b.xlsx")
    writer = workbook.WorkbookWriter(df.schema, {"path": str(tmp_path / "full.xlsx"), "sheet": "s"}, True)
    monkeypatch.setattr(workbook, "MOST_ROWS", 5)
    (tmp_path / "f").mkdir()
    files = [(str(tmp_path / "f" / f"{k}.xml"), 3) for k in range(3)]
    for name, n in files:
        with open(name, "w") as f:
            f.write(workbook.row(["v"]) * n)
    writer.commit([workbook.Fragments(1, files[1:]), None, workbook.Fragments(0, files[:1])])
    assert [n for n, _ in workbook.sheet_parts(str(tmp_path / "full.xlsx"))] == ["s", "s (2)", "s (3)"]


def video(path, frames, w, h, mode="420jpeg"):
    extra = {"420jpeg": 2 * ((w + 1) // 2) * ((h + 1) // 2), "mono": 0, "444": 2 * w * h}[mode]
    body = b"".join(b"FRAME\n" + f.astype(np.uint8).tobytes() + bytes(extra) for f in frames)
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} F30000:1001 Ip A1:1 C{mode}\n".encode() + body)


def test_frame_ranges(spark, tmp_path):
    draw = np.random.default_rng(1)
    films = {"a": draw.integers(0, 256, (500, 5, 7)), "b": draw.integers(0, 256, (90, 4, 4)), "c": draw.integers(0, 256, (3, 2, 2))}
    for (name, film), mode in zip(films.items(), ("420jpeg", "mono", "444"), strict=True):
        video(tmp_path / f"{name}.y4m", film, film.shape[2], film.shape[1], mode)
    (tmp_path / "d.y4m").write_bytes(b"no video")
    every = read_frames(spark, str(tmp_path), 50)
    assert every.rdd.getNumPartitions() == 10 + 2 + 1
    got = {(r["media"], r["frame"]): (r["width"], r["height"], bytes(r["pixels"])) for r in every.collect()}
    assert got == {(n, k): (f.shape[1], f.shape[0], f.astype(np.uint8).tobytes()) for n, film in films.items() for k, f in enumerate(film)}
    assert every.first()["fps"] == pytest.approx(29.97, abs=0.001)


def test_filters_reach_the_ranges(spark, tmp_path):
    for name in "ab":
        video(tmp_path / f"{name}.y4m", np.zeros((1000, 2, 2)), 2, 2, "mono")
    every = read_frames(spark, str(tmp_path), 100)
    for condition, parts, rows in [("frame >= 250 AND frame < 420 AND media = 'a'", 3, 170), ("frame = 5", 2, 2), ("frame IN (10, 950) AND media IN ('b', 'z')", 10, 2), ("frame > 998", 2, 2), ("frame <= 99", 2, 200), ("media = 'none'", 1, 0), ("frame < 0", 1, 0), ("width = 2", 20, 2000)]:
        some = every.where(condition)
        assert (some.rdd.getNumPartitions(), some.count()) == (parts, rows), condition


def test_scene_cuts_from_a_file(spark, tmp_path):
    """Files, frames and cuts together: a grey film whose brightness jumps twice."""
    film = np.concatenate([np.full((20, 4, 6), 10), np.full((30, 4, 6), 90), np.full((15, 4, 6), 200)])
    video(tmp_path / "film.y4m", film, 6, 4)
    shots = read_frames(spark, str(tmp_path / "film.y4m"), 16)
    cuts = scenes.content_cuts(shots, "media", "frame", "pixels", threshold=27, block=8)
    assert sorted(map(tuple, cuts.collect())) == [("film", 20), ("film", 50)]


def test_a_sheet_goes_on_in_the_next(tmp_path):
    path, main = tmp_path / "long.xlsx", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(["other", "s", "s (2)"])) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(3)) + "</Relationships>")
        for k, values in enumerate((["x", "9"], ["a", "1", "2"], ["a", "3"])):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row><c><v>{v}</v></c></row>" for v in values) + "</sheetData></worksheet>")
    assert list(stream_rows(str(path), "s", continued=True)) == [["a"], ["1"], ["2"], ["3"]]
    assert list(stream_rows(str(path), "s")) == [["a"], ["1"], ["2"]] and list(stream_rows(str(path)))[1:] == [["9"]]
