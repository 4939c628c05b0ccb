"""Sources, sinks, streams and inference on files of their own."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from prismara import inference
from prismara.functions import geometry as G
from prismara.functions import textparse as T
from prismara.operators import joins
from prismara.sources import media, metadata, results, sheets
from prismara.sources.tables import read_table
from prismara.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def workbook(path, cells, name="Data"):
    """A small .xlsx: shared and inline texts, numbers and a gap."""
    shared = sorted({c for row in cells for c in row if isinstance(c, str)})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = ""
    for i, row in enumerate(cells, 1):
        body += f'<row r="{i}">'
        for j, c in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if isinstance(c, str):
                body += f'<c r="{ref}" t="s"><v>{shared.index(c)}</v></c>' if (i + j) % 2 else f'<c r="{ref}" t="inlineStr"><is><t>{c}</t></is></c>'
            elif c is not None:
                body += f'<c r="{ref}"><v>{c}</v></c>'
        body += "</row>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" sheetId="2" r:id="rId2"/><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{c}</t></si>" for c in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Img ID</t></is></c><c r="B1" t="inlineStr"><is><t>path</t></is></c></row><row r="2"><c r="A2"><v>5.0</v></c><c r="B2" t="inlineStr"><is><t>/m/5.jpg</t></is></c></row></sheetData></worksheet>')


@pytest.fixture
def folder(tmp_path):
    for name in ("a.JPG", "b.mp4", "notes.txt", "sub/c.png"):
        (tmp_path / "media" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "media" / name).write_bytes(b"x" * len(name))
    return tmp_path


def test_media_listing_and_inputs(spark, folder):
    listed = media.list_media(spark, str(folder / "media"), recursive=True)
    assert rows(listed, "stem", "ext", "kind") == [("a", "jpg", "image"), ("b", "mp4", "video"), ("c", "png", "image")]
    assert rows(media.list_media(spark, str(folder / "media"), pattern="*.mp4"), "stem") == [("b",)]
    got = media.collect_inputs(spark, str(folder / "media"))
    assert rows(got, "img_id") == [("a",), ("b",), ("c",)]
    assert media.collect_inputs(spark, str(folder / "media"), limit=2).count() == 2
    listing = listed.select("path")
    assert rows(media.existing(spark.createDataFrame([("b.mp4",), ("z.mp4",)], "name string"), "name", listing), "name") == [("b.mp4",)]


def test_inputs_keep_the_first_row_of_an_id(spark, folder):
    (folder / "in.csv").write_text("Img ID,Ruta Img.\n7.0,/m/z.jpg\n7,/m/a.jpg\n8,/m/b.jpg\n")
    assert rows(media.collect_inputs(spark, str(folder / "in.csv")), "img_id", "path") == [("7", "/m/z.jpg"), ("8", "/m/b.jpg")]
    assert rows(media.collect_inputs(spark, str(folder / "in.csv"), limit=1), "img_id") == [("7",)]


def test_sheets(spark, folder):
    path = str(folder / "book.xlsx")
    workbook(path, [["Img ID", "note", None, "n"], ["1", None, None, 2.5], ["2", "x", None, 3]])
    assert rows(sheets.read_sheet(spark, path, "Data"), "Img ID", "note", "n") == [("1", None, "2.5"), ("2", "x", "3")]
    assert rows(media.collect_inputs(spark, path), "img_id", "path") == [("5", "/m/5.jpg")]


def test_subset_by_text(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",)], "id string")
    assert rows(media.subset(df, "id", "2, 3,"), "id") == [("2",)]


def test_durations(spark):
    header = lambda path: {"p1": (60, 30.0), "p2": (10, 0), "p3": None}[path]
    todo = spark.createDataFrame([("1", "p1"), ("2", "p2"), ("3", "p3")], "media_id string, path string")
    cache = spark.createDataFrame([("1", 9.0)], "media_id string, duration_s double")
    assert rows(media.probe_durations(todo, header), "media_id", "duration_s") == [("1", 2.0), ("2", 0.333333), ("3", None)]
    assert rows(media.refresh_durations(cache, todo, header), "media_id", "duration_s") == [("1", 9.0), ("2", 0.333333)]


def test_results_are_completion_marks(spark, tmp_path):
    out = str(tmp_path / "results")
    done = spark.createDataFrame([("r1", "a", 1, False), ("r1", "b", 2, True)], "run_id string, img_id string, persons int, degraded boolean")
    results.write_results(done, out)
    kept = spark.read.json(out)
    work = spark.createDataFrame([("a",), ("b",)], "img_id string")
    assert rows(joins.pending(work, kept, ["img_id"]), "img_id") == [("b",)]
    results.write_results(spark.createDataFrame([("r2", "b", 3)], "run_id string, img_id string, persons int"), out)
    assert joins.pending(work, spark.read.json(out), ["img_id"]).count() == 0


def test_result_files_and_latest_run(spark, tmp_path):
    for run, flat in (("r1", True), ("r2", False)):
        (tmp_path / run).mkdir()
        body = '{"run_id": "%s", "img_id": "a", %s}' % (run, '"persons_detected": 1' if flat else '"result": {"persons_detected": 2, "vlm_status": "ok"}')
        (tmp_path / run / "summary_a.json").write_text(body)
    (tmp_path / "r1" / "summary_bad.json").write_text('{"run_id": ')
    read = results.read_results(spark, str(tmp_path / "*"))
    assert rows(read, "run_id", "persons_detected") == [("r1", 1), ("r2", 2)]
    assert rows(results.latest_run(read), "run_id", "vlm_status") == [("r2", "ok")]


def test_sheet_falls_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    (tmp_path / "blocked").write_text("a file, not a folder")
    assert results.write_sheet(df, str(tmp_path / "ok"), ["a", "z", "b"]) == str(tmp_path / "ok")
    assert spark.read.csv(str(tmp_path / "ok"), header=True).columns == ["a", "z", "b"]
    other = str(tmp_path / "copy")
    assert results.write_sheet(df, str(tmp_path / "blocked" / "sheet"), ["a"], other) == other
    results.write_sheets({"faces": df, "images": df}, str(tmp_path / "book"))
    assert spark.read.csv(str(tmp_path / "book" / "images"), header=True).count() == 1
    assert "|  x|" in results.console_table(df)


def test_upserts_do_not_multiply_rows(spark):
    master = spark.createDataFrame([("1", None), ("2", 6.0)], "img string, score double")
    new = spark.createDataFrame([("1", 3.0), ("1", 4.0)], "img string, score double")
    assert rows(results.upsert(master, new, ["img"], ["score"]), "img", "score") == [("1", 4.0), ("2", 6.0)]
    assert rows(results.backfill(master, new, "img", "score", F.col("score").isNull()), "img", "score") == [("1", 4.0), ("2", 6.0)]


def test_swapped_tables_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        results.swap_in(spark.createDataFrame([(i,)], "i int"), path)
        assert rows(spark.read.parquet(path), "i") == [(i,)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_metadata_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,note\n1,"a ""b"""\n2,\n')
    got = metadata.read_source(spark, str(tmp_path / "m.csv"))
    assert rows(got, "id", "note") == [("1", 'a "b"'), ("2", "")]
    assert metadata.read_source(spark, str(tmp_path / "none.csv")) is None
    joined = metadata.attach(spark.createDataFrame([("1",), ("9",)], "id string"), got, "id")
    assert rows(joined, "id", "`Meta note`") == [("1", 'a "b"'), ("9", None)]


def test_event_time_windows(spark, tmp_path):
    t = lambda m: datetime.datetime(2025, 1, 1, 10, m)
    spark.createDataFrame([("u", t(0), "a"), ("u", t(3), "a"), ("u", t(30), "b"), ("v", t(1), "a")], "k string, at timestamp, kind string").write.parquet(str(tmp_path / "e"))
    stream = jobs.event_stream(spark, str(tmp_path / "e"), "k string, at timestamp, kind string")
    for name, query in (("made_sessions", jobs.sessions(stream, "k", "at", "10 minutes", "1 hour")), ("made_windows", jobs.windows(stream, "at", "10 minutes", "1 hour", "kind"))):
        query.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("made_sessions").collect()) == [1, 1, 2]
    assert rows(spark.table("made_windows"), "kind", "n") == [("a", 3), ("b", 1)]


def test_running_best(spark):
    df = spark.createDataFrame([("a", 2.0, 5), ("a", 2.0, 3), ("b", 1.0, 1)], "k string, s double, o int")
    assert rows(jobs.best_so_far(df, ["k"], F.col("s"), "o"), "k", "score", "at") == [("a", 2.0, 3), ("b", 1.0, 1)]


def test_inference_and_deferred_scores(spark):
    work = spark.createDataFrame([("1", "img1", "p"), ("2", "img2", "p")], "k string, image string, prompt string")
    known = spark.createDataFrame([("1", "old")], "k string, raw string")
    got = dict(rows(inference.infer_missing(work, known, ["k"]), "k", "raw"))
    assert got["1"] == "old" and got["2"].startswith("Gender:")
    scored = spark.createDataFrame([("1", 5.0)], "k string, score double")
    late = dict(rows(inference.deferred_scores(work, scored, ["k"], "image"), "k", "score"))
    assert late["1"] == 5.0 and 1 <= late["2"] <= 10
    persons = spark.createDataFrame([(0, True), (2, True), (2, False), (None, False)], "n int, d boolean")
    prompts = [r[0] for r in persons.select(inference.scene_prompt(F.col("n"), F.col("d"))).collect()]
    assert prompts[0] == prompts[3] == inference.PLACE_ONLY and prompts[1] == prompts[2] + inference.WITH_DISTANCE


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(joins.bucket_at(F.lit(7), F.array(F.lit(0), F.lit(5), F.lit(10)))).first()[0] == 1
    assert one.select(G.duration(F.lit(60), F.lit(30.0))).first()[0] == 2.0


def test_balanced_objects(spark):
    texts = ['x {"a": {"b": 1}} {', "{ cut {inner} more", "none", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.balanced_object(F.col("t"))).collect()]
    assert got == ['{"a": {"b": 1}}', "{inner}", None, None]


def test_single_and_joint_parsers_agree(spark):
    texts = ["Gender: female\nAge: na\nmakeup: 1\nbags: x\nbags: 1", "  gender :\n male\nAttire: informal swimsuit", "Muscle: x", "", "Musculature: not visible\nBodyWeight: obese, light", "Gender:\nAge: youth"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    joint = T.person_attributes(df, "t").orderBy("i").drop("t").collect()
    single = df.orderBy("i").select("i", *[p(F.col("t")) for p in (T.parse_gender, T.parse_age, T.parse_behaviour, T.parse_body_display, T.parse_body_weight, T.parse_muscle, T.parse_attire)], *[T.parse_accessory(F.col("t"), a) for a in T.V.ACCESSORIES]).collect()
    assert [tuple(r) for r in joint] == [tuple(r) for r in single]


def test_small_tables_are_dealt_over_the_cores(spark, tiny):
    assert read_table(spark, tiny, "region").count() == 5


def test_long_parsers_are_compiled(spark, tiny, capsys):
    """A stage with a method beyond HotSpot's 8,000 bytes is not run as one, as the JVM would interpret it for every row."""
    import re

    from prismara.llm import common
    from prismara.plans import catalog
    from prismara.sources import tables

    spark.conf.unset(tables.METHOD_LIMIT)
    df = catalog.queries()["parse_score_cascade"](spark, tiny)
    df.explain("codegen")
    largest = max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))
    assert 8000 < largest, "the plan no longer shows what the limit is for"
    assert int(spark.conf.get(tables.METHOD_LIMIT)) <= 8000
    common.table(spark, tiny, "documents")
    assert spark.conf.get(tables.METHOD_LIMIT, tables.SPARK_METHOD) == tables.SPARK_METHOD
    spark.conf.set(tables.METHOD_LIMIT, "20000")
    catalog.queries()["json_decoded"](spark, tiny)
    assert spark.conf.get(tables.METHOD_LIMIT) == "20000"
    spark.conf.unset(tables.METHOD_LIMIT)
