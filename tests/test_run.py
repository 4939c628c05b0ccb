"""Runs from inputs to results: resumption, empty answers, merged and single questions."""

from pyspark.sql import functions as F

from prismara import run as R
from prismara.inference import StubBackend

INPUTS = "img_id string, path string, persons int, distance boolean"


def test_run_resumes_and_asks_degraded_rows_again(spark, tmp_path):
    class Silent(StubBackend):
        """Says nothing about second persons."""

        def generate_batch(self, images, prompts):
            return ["" if i.endswith("#1") else a for i, a in zip(images, super().generate_batch(images, prompts), strict=True)]

    folder = str(tmp_path / "out")
    inputs = spark.createDataFrame([("a", "a.jpg", 2, True), ("b", "b.jpg", None, None), ("c", "c.jpg", 1, False)], INPUTS)
    first = R.run(inputs.where("img_id <> 'c'"), folder, "r1", backend=Silent)
    assert sorted((r["img_id"], r["person"] if r["person"] is not None else -1) for r in first.collect()) == [("a", -1), ("a", 0), ("b", -1)]
    second = R.run(inputs, folder, "r2")
    got = {(r["img_id"], r["person"]): r for r in second.collect()}
    assert len(got) == second.count() == 6
    assert {k: r["run_id"] for k, r in got.items()} == {("a", None): "r1", ("a", 0): "r1", ("a", 1): "r2", ("b", None): "r1", ("c", None): "r2", ("c", 0): "r2"}
    assert got["a", None]["social_distance"] and got["c", None]["social_distance"] is None and got["a", None]["gender"] is None
    assert got["b", None]["activity"] == "other" and got["a", 0]["gender"] in ("female", "male")
    assert R.run(inputs, folder, "r3").where("run_id = 'r3'").count() == 0


def test_inputs_without_rows_or_persons(spark, tmp_path):
    nothing = spark.createDataFrame([], INPUTS)
    assert R.subjects(nothing).count() == 0
    assert R.run(nothing, str(tmp_path / "none"), "r1").count() == 0


def test_questions_in_json_and_in_lines_parse_alike(spark):
    class Both(StubBackend):
        """One answer a picture, whatever is asked."""

        def generate_batch(self, images, prompts):
            plain = super().generate_batch(images, ["who"] * len(images))
            return [a if "JSON" not in p else "{" + ", ".join(f'"{k.strip().lower()}": "{v.strip()}"' for k, v in (x.split(":") for x in a.split("\n"))) + "}" for a, p in zip(plain, prompts, strict=True)]

    inputs = spark.createDataFrame([(str(k), f"{k}.jpg", 2, False) for k in range(20)], INPUTS)
    asked = R.subjects(inputs).where("person IS NOT NULL")
    columns = ["img_id", "person", *R.PERSON[:3], "attire"]
    lines, js = (sorted(map(tuple, R.classify(asked, p, Both).select(columns).collect())) for p in ("lines", "json"))
    single = sorted(map(tuple, R.classify_single(asked, backend=Both).select(columns).collect()))
    assert lines == js == single and len(lines) == 40
    assert R.classify(asked, "lines", Both).where(F.col("degraded")).count() == 0
