"""Catalogue: decoded answers, look-ups, pending work, panels and what reports are made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounding as R
from ..functions import textparse as T
from ..functions import vocab as V
from ..inference import PLACE_ONLY, PROMPT_SETS, WITH_DISTANCE, scene_prompt
from ..operators import aggregates as A
from ..operators import joins, panels, select
from ..sources import media, results, workbook
from ..sources.sheets import read_sheet
from ..sources.tables import shared_path
from ..streaming import jobs, ledger
from . import virtual as VR

WIDTH, HEIGHT = 640, 480

# --- answers -------------------------------------------------------------------------------------

_AGE = VR.cases("l_suppkey", ["youth", "old age", "adulthood", "childhood"])
#: Whole objects inside other text, with numbers, nulls, nested objects and values beyond the first key; then one that is cut.
_DECODED = (
    f"CASE l_orderkey % 4 WHEN 0 THEN concat('Answer: {{\"gender\": {{\"features\": {{\"a\": [1, 2]}}, \"class\": \"female\"}}, \"age\": \"', {_AGE}, '\", \"makeup\": ', CASE WHEN l_partkey % 2 = 0 THEN '1' ELSE '0' END, '}} and {{more}}') "
    f"WHEN 1 THEN concat('{{\"age\": {{\"class\": \"', {_AGE}, '\"}}, \"gender\": null, \"bags\": 1}}') "
    f"WHEN 2 THEN concat('{{\"gender\": {{\"class\": \"male\", \"features\": [\"x\"]}}, \"age\": {{\"class\": \"', {_AGE}, '\", \"features\": [\"cu') "
    f"ELSE 'no object at all' END"
)


def json_decoded(spark: SparkSession, sf: str) -> DataFrame:
    li = VR.table(spark, sf, "lineitem").select(*VR.KEY, F.expr(_DECODED).alias("answer"))
    flat = T.flatten_json(li, "answer", "flat")
    return T.person_attributes(flat, "flat", ["gender", "age"], ["makeup", "bags"]).select(*VR.KEY, "flat", "gender", "age", "makeup", "bags")


O_DECODED = f"""
SELECT {', '.join(VR.KEY)}, CASE k WHEN 0 THEN concat('Gender: female', chr(10), 'Age: ', age, chr(10), 'makeup: ', makeup) WHEN 1 THEN concat('Age: ', age, chr(10), 'bags: 1') WHEN 2 THEN concat('Gender: male', chr(10), 'Age: ', age) ELSE 'no object at all' END AS flat,
  CASE k WHEN 0 THEN 'female' WHEN 2 THEN 'male' END AS gender, CASE WHEN k < 3 THEN age END AS age, CASE WHEN k = 0 THEN makeup ELSE 0 END AS makeup, CASE WHEN k = 1 THEN 1 ELSE 0 END AS bags
FROM (SELECT *, l_orderkey % 4 AS k, {_AGE} AS age, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS makeup FROM lineitem)
"""


def accessories_of(spark: SparkSession, sf: str) -> DataFrame:
    """Old results list what was seen, by either name; new ones have flags."""
    p = VR.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("k"))
    flags = F.when(F.col("k") == 0, F.create_map(F.lit("makeup"), F.lit(1), F.lit("bags"), (F.col("p_partkey") % 2).cast("int")))
    names = F.when(F.col("k") == 1, F.array(F.lit("Maquillaje"), F.lit("hat"))).when(F.col("k") == 2, F.array(F.lit("glasses"))).when(F.col("k") == 3, F.array().cast("array<string>"))
    return p.select("p_partkey", *[T.accessory_flag(flags, names, a).alias(a) for a in V.ACCESSORIES])


O_ACCESSORIES = "SELECT p_partkey, p_partkey % 5 IN (0, 1) AS makeup, false AS tattoos, p_partkey % 5 = 0 AND p_partkey % 2 = 1 AS bags, false AS belts, false AS jewelry, p_partkey % 5 = 1 AS headwear, p_partkey % 5 = 2 AS eyewear FROM part"


def accessory_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.detections(spark, sf).withColumn("names", F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("bags"), F.lit("eyewear"))).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("bags"))))
    return A.name_counts(d, ["media"], "names", "track")


O_NAMES = f"""
WITH d AS ({VR.DET}), n AS (SELECT media, 'bags' AS name FROM d WHERE l_partkey % 3 < 2 UNION ALL SELECT media, 'eyewear' FROM d WHERE l_partkey % 3 = 0)
SELECT t.media, total, tracks, distribution FROM (SELECT media, count(*) AS total, count(DISTINCT track) AS tracks FROM d GROUP BY 1) t
LEFT JOIN (SELECT media, '{{' || string_agg('"' || name || '":' || c, ',' ORDER BY name) || '}}' AS distribution FROM (SELECT media, name, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY 1) j ON t.media = j.media
"""


def face_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf).withColumn("score", F.when(F.col("user_id") % 9 == 0, "none").otherwise(F.col("n_face").cast("string")))
    return A.face_means(o, ["user_id"], "score")


O_FACES = f"SELECT user_id, count(*) AS n_faces, CASE WHEN user_id % 9 = 0 THEN 'NA' ELSE CAST(round(avg(n_face), 2) AS VARCHAR) END AS mean_score FROM ({VR.OBS}) GROUP BY user_id"


def common_first(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf).withColumn("v", F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("event_type")))
    return A.most_common(o, ["user_id"], "v", "frame").select("user_id", "v", "n", "place")


O_COMMON = f"SELECT user_id, event_type AS v, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS INTEGER) AS place FROM (SELECT user_id, event_type, count(*) AS n, min(frame) AS f FROM ({VR.OBS}) WHERE event_id % 6 <> 0 GROUP BY 1, 2)"


def error_states(spark: SparkSession, sf: str) -> DataFrame:
    """Failed files' states, and run ids of their times."""
    e = VR.table(spark, sf, "events").where("event_type = 'error'")
    return e.select("event_id", T.error_state(F.repeat("props", 20)).alias("state"), T.run_stamp(F.col("ts")).alias("run_stamp"))


O_ERRORS = "SELECT event_id, 'error: ' || substr(repeat(props, 20), 1, 100) AS state, strftime(ts, '%Y%m%d_%H%M%S') AS run_stamp FROM events WHERE event_type = 'error'"

# --- look-ups ------------------------------------------------------------------------------------


def path_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens are paths, names under the base folder, or neither; then those that are downloaded and asked for."""
    c = VR.table(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "/m/").otherwise(""), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("token"), (F.col("c_custkey") % 5 != 0).alias("flag"))
    listing = VR.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("/m/"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("path"))
    rows = media.downloaded(media.fallback_paths(c, "token", "/m", listing), "flag", "found_path")
    wanted = VR.table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("value"))
    return media.subset(rows, "c_custkey", wanted).select("c_custkey", "token", "found_path")


O_FALLBACK = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/m/' ELSE '' END || c_custkey || '.jpg' AS token, '/m/' || c_custkey || '.jpg' AS found_path FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)"


def annotated_lookup(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.table(spark, sf, "orders")
    run = F.concat(F.lit("/x/runs/r"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/annotated/"))
    img = F.col("o_custkey").cast("string")
    idx = (F.col("o_orderkey") % 4).cast("string")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(img, F.lit("_annotated.jpg"))).when(F.col("o_orderkey") % 7 == 0, F.concat(img, F.lit("_person_"), idx, F.lit("_annotated.jpg"))).otherwise(F.concat(img, F.lit("_person_"), idx, F.lit("_track_"), F.col("o_orderkey").cast("string"), F.lit("_annotated.jpg")))
    return media.annotated_assets(o.select(F.concat(run, name).alias("path")))


O_ANNOTATED = """
WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS img_id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS idx, o_orderkey % 3 AS run, o_orderkey % 4 > 0 AND o_orderkey % 7 <> 0 AS tracked,
  '/x/runs/r' || (o_orderkey % 3) || '/annotated/' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '_person_' || (o_orderkey % 4) ELSE '_person_' || (o_orderkey % 4) || '_track_' || o_orderkey END || '_annotated.jpg' AS path FROM orders)
SELECT img_id, idx, path FROM (SELECT *, row_number() OVER (PARTITION BY img_id, idx ORDER BY run DESC, tracked DESC, path) AS n FROM l) WHERE n = 1
"""


def scene_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that came later, put into the persons of their scenes."""
    d = VR.detections(spark, sf).withColumn("t", F.concat_ws("_", F.lit("t"), F.col("ord").cast("string"))).withColumn("scene", F.concat_ws(".", F.col("media").cast("string"), F.col("frame").cast("string")))
    person = F.struct(F.col("ord"), F.col("t").alias("track"), F.when(F.col("ord") > 1, F.lit(0.5)).alias("beauty"))
    packages = d.groupBy("scene").agg(F.array_sort(F.collect_list(person)).alias("persons"))
    scores = d.where("media % 3 = 0 AND ord < 3").select("scene", F.col("t").alias("track"), (F.col("ord") + 1.25).alias("beauty"))
    out = joins.attach_scores(packages, scores, "scene", "persons", "track", "beauty")
    return out.select("scene", F.inline("persons")).select("scene", "track", "beauty")


O_SCENES = f"SELECT media || '.' || frame AS scene, 't_' || ord AS track, CASE WHEN media % 3 = 0 AND ord < 3 THEN ord + 1.25 WHEN ord > 1 THEN 0.5 END AS beauty FROM ({VR.DET})"

# --- filters and options -------------------------------------------------------------------------


def person_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the person class, confident enough, as a detector's thresholds leave them."""
    d = VR.detections(spark, sf).withColumn("cls", F.col("l_partkey") % 3)
    return select.confident_persons(d, "cls", "conf", 0.93).select("media", "frame", "l_partkey", "l_suppkey", R.scaled_round("conf", 6).alias("conf"))


O_PERSONS = f"SELECT media, frame, l_partkey, l_suppkey, round(conf, 6) AS conf FROM ({VR.DET}) WHERE l_partkey % 3 = 0 AND conf >= 0.93"


def demand_faces(spark: SparkSession, sf: str) -> DataFrame:
    lab = T.person_attributes(VR.answers(spark, sf, "raw"), "raw", ["behaviour"], [])
    return select.demanding(lab, "behaviour", demand_only=True).select(*VR.KEY, "behaviour")


def _o_demand() -> str:
    from .answers import _O, o_ans

    return f"SELECT * FROM (SELECT {', '.join(VR.KEY)}, {_O['behaviour']} AS behaviour FROM ({o_ans('raw')})) WHERE behaviour LIKE 'demand%'"


@dataclass(frozen=True)
class Options:
    """Which attributes a run asks for."""

    gender: bool = True
    age: bool = True
    behaviour: bool = False
    attire: bool = True
    accessories: bool = False

    def asked(self) -> list[str]:
        return [a for a in ("gender", "age", "behaviour", "attire") if getattr(self, a)]


def feature_columns(spark: SparkSession, sf: str, options: Options = Options()) -> DataFrame:
    """Only what is asked for is parsed; the other columns are there, and empty."""
    asked = T.person_attributes(VR.answers(spark, sf, "raw"), "raw", options.asked(), V.ACCESSORIES if options.accessories else [])
    return results.in_columns(asked, [*VR.KEY, "gender", "age", "behaviour", "attire", *V.ACCESSORIES])


def _o_features() -> str:
    from .answers import _O, o_ans

    return f"SELECT {', '.join(VR.KEY)}, {_O['gender']} AS gender, {_O['age']} AS age, CAST(NULL AS VARCHAR) AS behaviour, {_O['attire']} AS attire, {', '.join(f'CAST(NULL AS VARCHAR) AS {a}' for a in V.ACCESSORIES)} FROM ({o_ans('raw')})"


def prompt_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes grouped by what they are asked."""
    d = VR.detections(spark, sf).groupBy("media", "frame").agg(F.count_if(F.col("l_partkey") % 2 == 0).alias("persons"))
    return d.groupBy(scene_prompt(F.col("persons"), F.col("media") % 2 == 0).alias("prompt")).agg(F.count(F.lit(1)).alias("scenes"), F.sum("persons").alias("persons"))


_SCENE = PROMPT_SETS["lines"]["scene"].replace("'", "''")
O_PROMPTS = f"""
SELECT CASE WHEN persons = 0 THEN '{PLACE_ONLY.replace("'", "''")}' WHEN media % 2 = 0 THEN '{_SCENE}{WITH_DISTANCE}' ELSE '{_SCENE}' END AS prompt, count(*) AS scenes, CAST(sum(persons) AS BIGINT) AS persons
FROM (SELECT media, frame, count(*) FILTER (WHERE l_partkey % 2 = 0) AS persons FROM ({VR.DET}) GROUP BY 1, 2) GROUP BY 1
"""

# --- panels --------------------------------------------------------------------------------------


def _division(column: str, step: int) -> Column:
    """Three cuts of a line by arithmetic."""
    return F.array(*[(F.col(column) * (i + 3) % 97 * step).cast("long") for i in range(3)])


def panel_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Panels between cuts, of at least 15 % of each side, with a person's centre inside."""
    d = VR.detections(spark, sf)
    cuts = VR.table(spark, sf, "orders").select(F.col("o_orderkey").alias("media"), _division("o_orderkey", 7).alias("across"), _division("o_custkey", 5).alias("down"))
    grid = panels.grid(cuts, "across", "down", WIDTH, HEIGHT)
    return panels.with_person(grid, d.select("media", "x1", "y1", "x2", "y2"), "media").select("media", "x", "y", "w", "h")


O_GRID = f"""
WITH c AS (SELECT o_orderkey AS media, unnest([o_orderkey * (i + 3) % 97 * 7 FOR i IN [0, 1, 2]]) AS cut FROM orders), r AS (SELECT o_orderkey AS media, unnest([o_custkey * (i + 3) % 97 * 5 FOR i IN [0, 1, 2]]) AS cut FROM orders),
xs AS (SELECT media, cut AS x, lead(cut) OVER (PARTITION BY media ORDER BY cut) - cut AS w FROM (SELECT DISTINCT * FROM c WHERE cut > 64 AND cut < 576 UNION SELECT DISTINCT media, 0 FROM c UNION SELECT DISTINCT media, {WIDTH} FROM c)),
ys AS (SELECT media, cut AS y, lead(cut) OVER (PARTITION BY media ORDER BY cut) - cut AS h FROM (SELECT DISTINCT * FROM r WHERE cut > 48 AND cut < 432 UNION SELECT DISTINCT media, 0 FROM r UNION SELECT DISTINCT media, {HEIGHT} FROM r))
SELECT media, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM xs JOIN ys USING (media) WHERE w > {WIDTH * 0.15} AND h > {HEIGHT * 0.15}
AND EXISTS (SELECT 1 FROM ({VR.DET}) d WHERE d.media = xs.media AND (x1 + x2) / 2.0 > x AND (x1 + x2) / 2.0 < x + w AND (y1 + y2) / 2.0 > y AND (y1 + y2) / 2.0 < y + h)
"""


def panel_method(spark: SparkSession, sf: str) -> DataFrame:
    """The first method whose panels hold: by persons, by contours, by lines."""
    d = VR.detections(spark, sf).withColumn("method", F.element_at(F.array(F.lit("yolo"), F.lit("contours"), F.lit("hough_lines")), (F.col("l_partkey") % 3 + 1).cast("int")))
    at = (F.col("frame") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("at")
    return panels.method(d.select("media", "method", at, "x1", "y1", "x2", "y2"), "media", "method", "at", WIDTH * HEIGHT)


O_METHOD = f"""
WITH d AS (SELECT *, frame * 1000000000 + l_partkey * 10000 + l_suppkey AS pos_at, l_partkey % 3 AS m FROM ({VR.DET})),
o AS (SELECT a.media, a.m, count(*) AS k FROM d a JOIN d b ON a.media = b.media AND a.m = b.m AND a.pos_at < b.pos_at AND a.x2 > b.x1 AND b.x2 > a.x1 AND a.y2 > b.y1 AND b.y2 > a.y1 GROUP BY 1, 2),
p AS (SELECT media, m, count(*) AS n, sum((x2 - x1) * (y2 - y1)) / {WIDTH * HEIGHT} AS cover FROM d GROUP BY 1, 2),
g AS (SELECT media, m, n >= 2 AND CASE WHEN m < 2 THEN cover > 0.5 AND cover < 1.5 AND coalesce(k, 0) < floor(n / 2) ELSE cover > 0.85 AND cover < 1.15 END AS good FROM p LEFT JOIN o USING (media, m))
SELECT media, coalesce(CASE min(m) FILTER (WHERE good) WHEN 0 THEN 'yolo' WHEN 1 THEN 'contours' WHEN 2 THEN 'hough_lines' END, 'none') AS method FROM g GROUP BY media
"""

# --- comparison ----------------------------------------------------------------------------------


def cell_states(spark: SparkSession, sf: str) -> DataFrame:
    from .flows import _aligned

    rows = _aligned(spark, sf)
    return rows.select("img", "ordinal", A.cell_state(F.col("r_q"), F.col("q"), False, F.col("row_type")).alias("q_state"), A.cell_state(F.col("r_t"), F.col("t"), True, F.col("row_type")).alias("t_state"))


def _o_cells() -> str:
    from .flows import _ALIGN

    alone = "CASE row_type WHEN 'left_only' THEN 'manual_only' WHEN 'right_only' THEN 'ai_only' ELSE {} END"
    q = alone.format("CASE WHEN rq = 'NA' THEN 'blank' WHEN q = rq THEN 'equal' ELSE 'different' END")
    t = alone.format("CASE WHEN CASE WHEN t = 'sí' THEN 'yes' ELSE 'no' END = rt THEN 'equal' ELSE 'different' END")
    return f"SELECT img, ordinal, {q} AS q_state, {t} AS t_state FROM ({_ALIGN})"


PAIRS = ["gender", "age", "behaviour", "body_display", "body_weight", "muscle", "attire"]


def mismatches_all(spark: SparkSession, sf: str) -> DataFrame:
    """All 14 pairs: a person's attributes and flags against a manual row made by arithmetic."""
    lab = T.person_attributes(VR.answers(spark, sf, "raw"), "raw")
    pairs = [(F.col(a), F.when(F.col("l_partkey") % (i + 2) == 0, F.upper(F.col(a))).when(F.col("l_partkey") % (i + 2) == 1, "other").otherwise("NA"), False) for i, a in enumerate(PAIRS)]
    pairs += [(F.col(a).cast("string"), F.when(F.col("l_suppkey") % (i + 2) == 0, "Sí").when(F.col("l_suppkey") % (i + 2) == 1, "no").otherwise(""), True) for i, a in enumerate(V.ACCESSORIES)]
    return lab.select(*VR.KEY, A.mismatches(pairs).cast("int").alias("mismatches"))


def _o_all() -> str:
    from .answers import O_LABELS

    said = lambda a: f"{a} IS NOT NULL AND {a} NOT IN ('NA', 'na', '')"
    terms = [f"CASE WHEN l_partkey % {i + 2} = 1 AND {said(a)} AND {a} <> 'other' THEN 1 ELSE 0 END" for i, a in enumerate(PAIRS)]
    terms += [f"CASE WHEN l_suppkey % {i + 2} = 0 AND {a} = 0 OR l_suppkey % {i + 2} = 1 AND {a} = 1 THEN 1 ELSE 0 END" for i, a in enumerate(V.ACCESSORIES)]
    return f"SELECT {', '.join(VR.KEY)}, CAST({' + '.join(terms)} AS INTEGER) AS mismatches FROM ({O_LABELS})"


# --- streams and sinks ---------------------------------------------------------------------------


def _streamed(spark: SparkSession, counts: DataFrame, name: str) -> DataFrame:
    """The whole result of a stream's aggregate, after all there is was read, from a table that each batch replaces."""
    path = shared_path(spark, name)
    query = counts.writeStream.foreachBatch(lambda batch, _: results.swap_in(batch, path)).outputMode("complete")
    query.option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a stream reads a folder or a pattern
    return jobs.event_stream(spark, f"{sf}/events*.parquet", schema).withColumn("at", F.col("ts").cast("timestamp"))


def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling counts of the event stream."""
    out = _streamed(spark, jobs.windows(_events(spark, sf), "at", "1 hour", "10 minutes", "event_type"), "counts")
    return out.groupBy(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.sum("n").alias("n"))


def streamed_best(spark: SparkSession, sf: str) -> DataFrame:
    """The running best value of each user's events, of equal ones the first."""
    best = jobs.best_so_far(_events(spark, sf), ["user_id"], F.col("value"), "event_id")
    return _streamed(spark, best, "best").select("user_id", R.scaled_round("score", 6).alias("score"), F.col("at").alias("event_id"))


def workbook_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of customers and one of nations, written as one workbook; the customers' cells as they are read back."""
    c = VR.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("<"), "c_name", F.lit(f"> & {chr(10)} _x0041_"))).alias("remark"), (F.col("c_acctbal") > 0).alias("credit"))
    path = shared_path(spark, "book") + ".xlsx"
    workbook.write_workbook({"nations": VR.table(spark, sf, "nation"), "customers": c}, path)
    return read_sheet(spark, path, "customers", continued=True)


O_WORKBOOK = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN '<' || c_name || '> & ' || chr(10) || ' _x0041_' END AS remark, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS credit FROM customer"


def streamed_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The three candidate slots of each user, taken as a track, after the whole stream: values of all events, of purchases and of every third one."""
    frames = _events(spark, sf).select(
        F.col("user_id").cast("string").alias("track"), F.col("event_id").alias("frame"), F.col("value").alias("general"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("body"), F.when(F.col("event_id") % 3 == 0, F.floor("value")).cast("double").alias("face")
    )
    target = shared_path(spark, "slots")
    with jobs.rocks_state(spark):
        jobs.ingest(jobs.candidate_slots(frames), target, shared_path(spark, "slots-state"), ["track"], output="update").awaitTermination()
    slots = ledger.read_master(spark, target)
    return slots.select("track", *[c for s in jobs.SLOTS for c in (R.scaled_round(s, 6).alias(s), f"{s}_frame")])


def _o_slot(name: str, value: str) -> str:
    return f"round(max({value}), 6) AS {name}, arg_max(CASE WHEN {value} IS NOT NULL THEN event_id END, ({value}, -event_id)) FILTER ({value} IS NOT NULL) AS {name}_frame"


_PURCHASE, _THIRD = "(CASE WHEN event_type = 'purchase' THEN value END)", "(CASE WHEN event_id % 3 = 0 THEN floor(value) END)"
O_SLOTS = f"SELECT CAST(user_id AS VARCHAR) AS track, {_o_slot('general', 'value')}, {_o_slot('body', _PURCHASE)}, {_o_slot('face', _THIRD)} FROM events GROUP BY user_id"


def results_written(spark: SparkSession, sf: str) -> DataFrame:
    """Work that is still to do after results were written, degraded ones left out, and read again."""
    o = VR.table(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey") % 3).alias("run_id"), F.col("o_orderkey").cast("string").alias("img_id"), (F.col("o_orderkey") % 7 == 0).alias("degraded"))
    path = shared_path(spark, "results")
    results.write_results(o.where("o_orderkey % 4 <> 0"), path)
    done = spark.read.schema("img_id string, run_id string").json(path)
    return joins.pending(o.select("img_id", "run_id"), done, ["img_id"])


O_WRITTEN = "SELECT CAST(o_orderkey AS VARCHAR) AS img_id, 'r' || (o_orderkey % 3) AS run_id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 7 = 0"


def queries() -> dict:
    made = (
        json_decoded, accessories_of, accessory_counts, face_scores, common_first, error_states, path_fallback, annotated_lookup, scene_scores, person_boxes, demand_faces, feature_columns, prompt_choice, panel_grid, panel_method, cell_states,
        mismatches_all, streamed_counts, streamed_best, streamed_slots, workbook_rows, results_written,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "json_decoded": O_DECODED,
        "accessories_of": O_ACCESSORIES,
        "accessory_counts": O_NAMES,
        "face_scores": O_FACES,
        "common_first": O_COMMON,
        "error_states": O_ERRORS,
        "path_fallback": O_FALLBACK,
        "annotated_lookup": O_ANNOTATED,
        "scene_scores": O_SCENES,
        "person_boxes": O_PERSONS,
        "demand_faces": _o_demand(),
        "feature_columns": _o_features(),
        "prompt_choice": O_PROMPTS,
        "panel_grid": O_GRID,
        "panel_method": O_METHOD,
        "cell_states": _o_cells(),
        "mismatches_all": _o_all(),
        "streamed_counts": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "streamed_slots": O_SLOTS,
        "workbook_rows": O_WORKBOOK,
        "streamed_best": "SELECT user_id, round(value, 6) AS score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1",
        "results_written": O_WRITTEN,
    }
