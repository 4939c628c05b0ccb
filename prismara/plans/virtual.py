"""Virtual relations over the driver tables.

The driver's tables hold no media, so queries derive detections, keypoints, answers and observations by
integer arithmetic. The expressions are plain SQL that Spark and the oracle engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, small_methods

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table for the catalogue's plans, whose parsers are long branches."""
    small_methods(spark)
    return read_table(spark, sf_dir, name)


def cases(expr: str, values: list[str]) -> str:
    """SQL text choosing one of the values by a number."""
    quoted = [v.replace("'", "''") for v in values]
    return "CASE " + " ".join(f"WHEN ({expr}) % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


NL = "chr(10)"
_GENDER = cases("l_partkey", ["female", "MALE", "na", "Female ", "male", "unsure"])
_AGE = cases("l_suppkey", ["youth", "old age", "adulthood (35)", "Childhood", "N/A"])
_BEHAVIOUR = cases("l_partkey + l_linenumber", ["demand/affiliation", "seduction", "demand/submission", "ideal", "offer/ideal", "na", "other"])
_DISPLAY = cases("l_suppkey + l_linenumber", ["normal clothes", "revealing clothes", "partially naked", "na", "unclear"])
_WEIGHT = cases("l_partkey + l_suppkey", ["light build", "average", "obese", "underweight", "not visible", "median", "NA"])
_MUSCLE = cases("l_orderkey + l_partkey", ["visible", "not visible", "abdominal definition", "toned arms", "soft", "none"])
_ATTIRE = cases("l_orderkey + l_suppkey", ["informal", "swimsuit", "business suit", "traditional tunic", "sportswear", "jeans and t-shirt", "na"])

#: Answer text of a line item: label lines, as they are in most cases, with an odd line before or none at all in some.
PLAIN = (
    f"concat(CASE WHEN l_orderkey % 5 = 0 THEN concat('Here is the answer.', {NL}) ELSE '' END, "
    f"CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE concat('Gender: ', {_GENDER}, {NL}) END, "
    f"'  Age : ', {_AGE}, {NL}, 'Behaviour: ', {_BEHAVIOUR}, {NL}, 'BodyDisplay: ', {_DISPLAY}, {NL}, 'BodyWeight: ', {_WEIGHT}, {NL}, "
    f"'Musculature: ', {_MUSCLE}, {NL}, 'Attire: ', {_ATTIRE}, {NL}, "
    f"'makeup: ', CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '0' END, {NL}, 'bags: ', CASE WHEN l_suppkey % 2 = 0 THEN '1' ELSE 'x' END, {NL}, 'eyewear: ', CASE WHEN l_linenumber % 2 = 0 THEN '1' ELSE '0' END)"
)
_ACT = cases("l_partkey", ["sports", "**Romance**", "posing.", "everyday doings", "<label>", "dancing"])
_ACT2 = cases("l_suppkey", ["other", "posing", "<activity>"])
_LOC = cases("l_suppkey", ["indoors", "a city street", "Wilderness!", "NA", "<one of four>", "unknown"])
_SOC = cases("l_partkey + l_suppkey", ["far social distance", "Public distance.", "<distance>", "none"])
SCENE = (
    f"concat('- **Activity:** ', {_ACT}, {NL}, '2. **Location:** ', {_LOC}, {NL}, CASE WHEN l_linenumber % 2 = 0 THEN concat('Activity: ', {_ACT2}, {NL}) ELSE '' END, "
    f"'> Social Distance: ', {_SOC})"
)
_GENDER_JSON = cases("l_partkey", ["female", "male", "na"])
JSON = (
    f"CASE WHEN l_orderkey % 4 = 0 THEN concat('{{\"gender\": {{\"class\": \"', {_GENDER_JSON}, '\", \"features\": [1]}}, \"age\": {{\"class\": \"youth\"}}}}') "
    f"WHEN l_orderkey % 4 = 1 THEN concat('{{\"gender\": \"', {_GENDER_JSON}, '\", \"attire\": \"casual\"}}') "
    f"WHEN l_orderkey % 4 = 2 THEN concat('Sure. {{\"gender\": {{ \"class\": \"', {_GENDER_JSON}, '\", \"features\": [\"lo') "
    f"ELSE concat('{{\"shoulders\": ', CASE WHEN l_partkey % 2 = 0 THEN '1' ELSE '0' END, ', \"waist\": ', CASE WHEN l_suppkey % 2 = 0 THEN '1' ELSE '0' END, ', \"legs\": ', CASE WHEN l_linenumber % 2 = 0 THEN '1' ELSE '0' END, ', \"feet\": ', CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '0' END, ', \"frame_filled\": ', CASE WHEN l_suppkey % 3 = 0 THEN '1' ELSE '0' END, '}}') END"
)
SCORE = cases("l_partkey * 7 + l_linenumber", ["7.3", "8/10", "score: 3", "15", "N/A", "cannot rate this", "", "The rating is 6.25 of 10", "I give it a 4", "out of 200 it has 150, so 9"])
THINK = cases("l_suppkey + l_linenumber", ["<think>a b</think>female", "<think>unfinished", "plain", "x<think>1</think>y<think>2</think>z", "<think>a</think>kept<think>cut"])
LEGACY = cases("l_partkey + l_linenumber", ["Age: youth", "she looks like a toddler", "around 45 years", "age 7", "Age: NA", "an elderly man", "nothing", "Age: unsure, maybe adulthood", "in the year 300", "young adult"])


TEXTS = {"raw": PLAIN, "scene_raw": SCENE, "json_raw": JSON, "score_raw": SCORE, "think_raw": THINK, "legacy_raw": LEGACY}


def answers(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    """v_ans: media (order), the key columns and the raw answers of the tasks asked for, all by default."""
    li = table(spark, sf_dir, "lineitem").select(*KEY, "l_quantity", "l_discount")
    return li.withColumns({k: F.expr(TEXTS[k]) for k in texts or TEXTS})


#: v_det in SQL, for both engines.
DET = (
    "SELECT l_orderkey AS media, CAST(l_linenumber AS BIGINT) AS frame, l_partkey, l_suppkey, l_suppkey % 5 AS track, l_partkey % 300 AS x1, l_suppkey % 200 AS y1, "
    "l_partkey % 300 + 1 + CAST(floor(l_quantity) AS BIGINT) * 6 AS x2, l_suppkey % 200 + 1 + CAST(floor(l_quantity) AS BIGINT) * 4 AS y2, 1 - l_discount AS conf, "
    "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS ord FROM lineitem"
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_det: boxes on a 640 x 480 frame; ``ord`` numbers the boxes of a frame."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(DET)


#: Keypoint confidences and places by arithmetic; i is the point's number.
KP_X = "((l_partkey + i * 37) % 101) * 1.0"
KP_Y = "((l_suppkey + i * 5) % 97) * 1.0"
KP_CONF = "((l_partkey + l_suppkey + i * 7) % 41) / 40.0"


def keypoints(det: DataFrame) -> DataFrame:
    """v_det with ``kps``: 17 points, null for every 13th part."""
    fields = [f"transform(sequence(0L, 16L), i -> named_struct('x', CAST({KP_X} AS DOUBLE), 'y', CAST({KP_Y} AS DOUBLE), 'conf', CAST({KP_CONF} AS DOUBLE)))"]
    return det.withColumn("kps", F.expr(f"CASE WHEN l_partkey % 13 <> 0 THEN {fields[0]} END"))


#: v_obs in SQL: observations of a user's events in time order.
OBS = (
    "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame, event_id % 7 AS n_face, value, event_type, ts FROM events"
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(OBS)
