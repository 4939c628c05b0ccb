"""A run from inputs to results: what is open is asked, parsed and written, and what is written is not asked again.

A row is one question's subject: a marked person of a picture, or a picture's scene (``person`` is null). Rows that got no answer are
marked as degraded; they are not written, so the next run asks them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import textparse as T
from .functions import vocab as V
from .inference import PROMPT_SETS, SINGLE_PROMPTS, infer, scene_prompt
from .operators.joins import pending
from .sources.results import write_results

KEY = ["img_id", "person"]
PERSON = ["gender", "age", "behaviour", "body_display", "body_weight", "muscle", "attire"]
SCENE = ["activity", "location", "social_distance"]
WRITTEN = ", ".join(["run_id string, img_id string, person long", *[f"{a} string" for a in PERSON], *[f"{a} int" for a in V.ACCESSORIES], *[f"{a} string" for a in SCENE]])


def subjects(inputs: DataFrame) -> DataFrame:
    """(img_id, person, image, persons, distance): a row for each person of ``inputs`` (img_id, path, persons, distance), numbered from 0, and one for the scene."""
    persons = F.coalesce(F.col("persons"), F.lit(0)).cast("long")
    numbers = F.concat(F.array(F.lit(None).cast("long")), F.when(persons > 0, F.sequence(F.lit(0).cast("long"), persons - 1)).otherwise(F.array().cast("array<bigint>")))
    rows = inputs.select("img_id", "path", persons.alias("persons"), F.coalesce(F.col("distance"), F.lit(False)).alias("distance"), F.explode(numbers).alias("person"))
    image = F.concat("path", F.when(F.col("person").isNotNull(), F.concat(F.lit("#"), F.col("person").cast("string"))).otherwise(""))
    return rows.select("img_id", "person", image.alias("image"), "persons", "distance")


def read_written(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all runs in a folder; none where there is no folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], WRITTEN)
    return spark.read.schema(WRITTEN).json(folder)


def classify(asked: DataFrame, prompts: str = "lines", backend: str = "stub") -> DataFrame:
    """``asked`` (subjects) with the answers' attributes: one merged question a person and one a scene, ``degraded`` where the answer is empty."""
    person = F.col("person").isNotNull()
    prompt = F.when(person, PROMPT_SETS[prompts]["person"]).otherwise(scene_prompt(F.col("persons"), F.col("distance"), prompts))
    answered = asked.withColumn("raw", T.strip_reasoning(infer(F.col("image"), prompt, backend)))
    if prompts == "json":
        answered = T.flatten_json(answered, "raw", "raw")
    found = T.person_attributes(answered, "raw")
    scene = {"activity": T.parse_activity, "location": T.parse_location, "social_distance": T.parse_social_distance}
    found = found.withColumns({a: F.when(~person, parse(F.col("raw"))) for a, parse in scene.items()})
    found = found.withColumns({a: F.when(person, F.col(a)) for a in (*PERSON, *V.ACCESSORIES)})
    return found.withColumn("degraded", F.trim(F.coalesce("raw", F.lit(""))) == "").drop("raw")


def classify_single(asked: DataFrame, attributes: Sequence[str] = tuple(PERSON), backend: str = "stub") -> DataFrame:
    """Persons with their attributes, each asked by a question of its own: what the merged question replaces."""
    rows = asked.where(F.col("person").isNotNull())
    for a in attributes:
        rows = rows.withColumn(f"__{a}", infer(F.col("image"), F.lit(SINGLE_PROMPTS[a]), backend))
    parsers = {"gender": T.parse_gender, "age": T.parse_age, "behaviour": T.parse_behaviour, "body_display": T.parse_body_display, "body_weight": T.parse_body_weight, "muscle": T.parse_muscle, "attire": T.parse_attire}
    return rows.select(*asked.columns, *[parsers[a](F.col(f"__{a}")).alias(a) for a in attributes])


def run(inputs: DataFrame, folder: str, run_id: str, prompts: str = "lines", backend: str = "stub") -> DataFrame:
    """Asks what no run in ``folder`` has a row of, adds a run's rows to it and returns all there are."""
    spark = inputs.sparkSession
    done = read_written(spark, folder).select("img_id", F.coalesce("person", F.lit(-1).cast("long")).alias("__p"))
    open_ = pending(subjects(inputs).withColumn("__p", F.coalesce("person", F.lit(-1).cast("long"))), done, ["img_id", "__p"]).drop("__p")
    rows = classify(open_, prompts, backend).withColumn("run_id", F.lit(run_id))
    write_results(rows.select("run_id", *KEY, *PERSON, *V.ACCESSORIES, *SCENE, "degraded"), folder)
    return read_written(spark, folder)
