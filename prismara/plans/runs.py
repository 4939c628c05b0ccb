"""Catalogue: a run from inputs to written results, with the deterministic backend, whose answers follow from a hash that SQL has too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import run as R
from ..functions import vocab as V
from ..inference import PLACE_ONLY, PROMPT_SETS, SINGLE_PROMPTS, WITH_DISTANCE
from ..sources.tables import shared_path
from . import virtual as VR

#: A picture an order; persons 0 to 2, every fourth one with the distance asked for.
PERSONS, DISTANCE = "o_orderkey % 3", "o_orderkey % 4 = 0"
COLUMNS = ["gender", "age", "behaviour", "attire", "activity", "location", "social_distance"]


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("img_id"), F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"), F.expr(PERSONS).alias("persons"), F.expr(DISTANCE).alias("distance"))


def run_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """All pictures in two runs: the first ends after two thirds of them, the second asks the rest only."""
    inputs, folder = _inputs(spark, sf), shared_path(spark, "run")
    R.run(inputs.where("CAST(img_id AS BIGINT) % 3 <> 1"), folder, "r1")
    rows = R.run(inputs, folder, "r2")
    worn = sum((F.col(a) for a in V.ACCESSORIES), F.lit(0))
    return rows.select("img_id", "person", "run_id", *COLUMNS, worn.cast("int").alias("accessories"))


def run_json_and_single(spark: SparkSession, sf: str) -> DataFrame:
    """Persons classified by the merged question in JSON and by one question an attribute."""
    asked = R.subjects(_inputs(spark, sf)).where("person IS NOT NULL")
    merged = R.classify(asked, "json").select("img_id", "person", "gender", "age")
    single = R.classify_single(asked, ["gender", "attire"]).select("img_id", "person", F.col("gender").alias("single_gender"), F.col("attire").alias("single_attire"))
    return merged.join(single, ["img_id", "person"])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick(values: list[str], i: int, digest: str = "h") -> str:
    return f"[{', '.join(map(_quoted, values))}][1 + CAST('0x' || substr({digest}, {2 * i + 1}, 2) AS INTEGER) % {len(values)}]"


_SCENE = PROMPT_SETS["lines"]["scene"]
_PROMPT = f"CASE WHEN person IS NOT NULL THEN {_quoted(PROMPT_SETS['lines']['person'])} WHEN n = 0 THEN {_quoted(PLACE_ONLY)} WHEN far THEN {_quoted(_SCENE + WITH_DISTANCE)} ELSE {_quoted(_SCENE)} END"
_SUBJECTS = f"SELECT *, 'in/' || img_id || '.jpg' || CASE WHEN person IS NULL THEN '' ELSE '#' || person END AS image FROM (SELECT CAST(o_orderkey AS VARCHAR) AS img_id, {PERSONS} AS n, {DISTANCE} AS far, o_orderkey, unnest(list_concat([NULL], range(0, {PERSONS}))) AS person FROM orders)"
_RENAMED = _pick([V.BEHAVIOUR_RENAMED.get(b, b) for b in V.BEHAVIOURS], 2)


def _of(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


_WORN = " + ".join(f"CAST('0x' || substr(h, {2 * (4 + i) + 1}, 2) AS INTEGER) % 2" for i in range(len(V.ACCESSORIES)))
O_RUN = f"""
WITH s AS ({_SUBJECTS}), a AS (SELECT *, md5(image || '|' || {_PROMPT}) AS h FROM s)
SELECT img_id, CAST(person AS BIGINT) AS person, CASE WHEN o_orderkey % 3 <> 1 THEN 'r1' ELSE 'r2' END AS run_id, {_of('person IS NOT NULL', _pick(V.GENDERS, 0))} AS gender, {_of('person IS NOT NULL', _pick(V.AGE_GROUPS, 1))} AS age, {_of('person IS NOT NULL', _RENAMED)} AS behaviour,
  {_of('person IS NOT NULL', _pick(V.ATTIRES, 3))} AS attire, {_of('person IS NULL', f"CASE WHEN n = 0 THEN 'other' ELSE {_pick(V.ACTIVITIES, 0)} END")} AS activity, {_of('person IS NULL', _pick(V.LOCATIONS, 1))} AS location,
  {_of('person IS NULL AND n > 0 AND far', _pick(V.SOCIAL_DISTANCES, 2))} AS social_distance, {_of('person IS NOT NULL', f'CAST({_WORN} AS INTEGER)')} AS accessories FROM a
"""
O_JSON = f"""
WITH s AS ({_SUBJECTS}), a AS (SELECT *, md5(image || '|' || {_quoted(PROMPT_SETS['json']['person'])}) AS h, md5(image || '|' || {_quoted(SINGLE_PROMPTS['gender'])}) AS g, md5(image || '|' || {_quoted(SINGLE_PROMPTS['attire'])}) AS w FROM s WHERE person IS NOT NULL)
SELECT img_id, CAST(person AS BIGINT) AS person, {_pick(V.GENDERS, 0)} AS gender, {_pick(V.AGE_GROUPS, 1)} AS age, {_pick(V.GENDERS, 0, 'g')} AS single_gender, {_pick(V.ATTIRES, 3, 'w')} AS single_attire FROM a
"""


def queries() -> dict:
    return {f.__name__: f for f in (run_end_to_end, run_json_and_single)}


def oracle_sql() -> dict[str, str]:
    return {"run_end_to_end": O_RUN, "run_json_and_single": O_JSON}
