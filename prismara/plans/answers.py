"""Catalogue: parsing answers and aggregating what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textparse as T
from ..functions import vocab as V
from ..operators import aggregates as A
from . import virtual as VR

KEY = VR.KEY
KEYS = ", ".join(KEY)


# --- oracle building blocks: the same rules, stated in the oracle engine's SQL -------------------


def _q(s: str) -> str:
    return s.replace("'", "''")


def o_line(expr: str, label: str) -> str:
    return f"lower(regexp_replace(nullif(regexp_extract({expr}, '(?im)^\\s*{label}\\s*:\\s*([^\\n]+)', 1), ''), '^\\s+|\\s+$', '', 'g'))"


def o_within(expr: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({expr}, '{_q(w)}') THEN '{_q(v)}'" for w, v in pairs) + " END"


def o_member(expr: str, values) -> str:
    return o_within(expr, [(v, v) for v in values])


def o_na(expr: str, parsed: str, na: str) -> str:
    return f"CASE WHEN {expr} IN ('na', 'n/a') THEN '{na}' ELSE {parsed} END"


def o_map(expr: str, mapping) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{_q(k)}' THEN '{_q(v)}'" for k, v in mapping.items()) + f" ELSE {expr} END"


def o_attr(raw: str) -> dict[str, str]:
    """Attribute -> SQL over a raw column."""
    lines = {k: o_line(raw, v) for k, v in {"gender": "Gender", "age": "Age", "behaviour": "Behaviour", "display": "BodyDisplay", "weight": "BodyWeight", "muscle": "Musculature", "attire": "Attire"}.items()}
    behaviour = f"coalesce({o_member(lines['behaviour'], V.BEHAVIOURS)}, {o_within(lines['behaviour'], V.BEHAVIOUR_SUFFIXES.items())})"
    weight = f"coalesce({o_member(lines['weight'], V.BODY_WEIGHTS)}, {o_within(lines['weight'], V.BODY_WEIGHT_SYNONYMS.items())})"
    attire = f"CASE WHEN contains({lines['attire']}, 'informal') THEN 'casual' ELSE coalesce({o_member(lines['attire'], V.ATTIRES)}, {o_within(lines['attire'], V.ATTIRE_SYNONYMS.items())}) END"
    return {
        "gender": o_na(lines["gender"], o_member(lines["gender"], V.GENDERS), "no visible"),
        "age": o_na(lines["age"], o_member(lines["age"], V.AGE_GROUPS), "no visible"),
        "behaviour": o_na(lines["behaviour"], o_map(f"({behaviour})", V.BEHAVIOUR_RENAMED), "no visible"),
        "body_display": o_na(lines["display"], o_member(lines["display"], V.BODY_DISPLAYS), "no visible"),
        "body_weight": o_na(lines["weight"], o_map(f"({weight})", V.ADIPOSITY), "not visible"),
        "muscle": o_within(lines["muscle"], [(w, "not visible") for w in V.MUSCLE_NEGATIVE] + [(w, "visible") for w in V.MUSCLE_POSITIVE]),
        "attire": o_na(lines["attire"], attire, "not visible"),
    }


def o_flag(raw: str, name: str) -> str:
    return f"coalesce(CAST(nullif(regexp_extract({raw}, '(?im)^\\s*{name}\\s*:\\s*([01])', 1), '') AS INTEGER), 0)"


def o_ans(*columns: str) -> str:
    texts = {"raw": VR.PLAIN, "scene_raw": VR.SCENE, "json_raw": VR.JSON, "score_raw": VR.SCORE, "think_raw": VR.THINK, "legacy_raw": VR.LEGACY}
    return f"SELECT {KEYS}, l_quantity, l_discount, " + ", ".join(f"{texts[c]} AS {c}" for c in columns) + " FROM lineitem"


def labels(df: DataFrame) -> DataFrame:
    """Answers with every person attribute as a column."""
    return T.person_attributes(df, "raw")


ATTRS = ["gender", "age", "behaviour", "body_display", "body_weight", "muscle", "attire"]
_RAW = "raw"
_O = o_attr(_RAW)
O_LABELS = f"SELECT *, {', '.join(f'{sql} AS {a}' for a, sql in _O.items())}, {', '.join(f'{o_flag(_RAW, a)} AS {a}' for a in V.ACCESSORIES)} FROM ({o_ans('raw')})"


def parse_person_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels(VR.answers(spark, sf, "raw")).select(*KEY, *ATTRS, *V.ACCESSORIES)


def parse_scene_last_match(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("scene_raw")
    return VR.answers(spark, sf).select(*KEY, T.parse_activity(s).alias("activity"), T.parse_location(s).alias("location"), T.parse_social_distance(s).alias("social_distance"))


def _o_last(label: str, valid: str, fallback: str) -> str:
    rx = f"(?im)^[\\s>*\\-\\d.]*\\**\\s*{label}\\**\\s*:\\s*\\**\\s*([^\\n]+)"
    clean = "regexp_replace(regexp_replace(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '^[*\\s\"'']+|[*\\s\"'']+$', '', 'g'), '[.,;:!]+$', '')"
    seen = f"list_transform(list_transform(list_reverse(regexp_extract_all(scene_raw, '{rx}', 1)), lambda x: {clean}), lambda v: CASE WHEN regexp_matches(v, '[<>]') THEN NULL ELSE {valid} END)"
    last = f"list_filter({seen}, lambda x: x IS NOT NULL)[1]"
    return f"coalesce({last}, {fallback})" if fallback else last


O_SCENE = {
    "activity": _o_last("activity", f"CASE WHEN v IN ({', '.join(repr(a) for a in V.ACTIVITY_ALIASES)}) THEN 'other' ELSE {o_member('v', V.ACTIVITIES)} END", "'other'"),
    "location": _o_last("location", f"CASE WHEN v IN ('na', 'n/a') THEN 'no background' ELSE {o_member('v', V.LOCATIONS)} END", "'no background'"),
    "social_distance": _o_last("social\\s*distance", o_member("v", V.SOCIAL_DISTANCES), ""),
}


def json_flatten_truncated(spark: SparkSession, sf: str) -> DataFrame:
    flat = T.flatten_json(VR.answers(spark, sf, "json_raw"), "json_raw", "flat")
    return T.person_attributes(flat, "flat", ["gender", "attire"], []).select(*KEY, "flat", "gender", "attire")


def _o_salvage(key: str) -> str:
    return f"coalesce(nullif(regexp_extract(json_raw, '\"{key}\"\\s*:\\s*\\{{\\s*\"class\"\\s*:\\s*\"([^\"]*)\"', 1), ''), nullif(regexp_extract(json_raw, '\"{key}\"\\s*:\\s*\"([^\"]*)\"', 1), ''))"


_FLAT = "concat_ws(chr(10), " + ", ".join(f"'{label}: ' || {_o_salvage(key)}" for key, label in V.JSON_LABELS.items()) + ")"
O_FLAT = f"SELECT *, CASE WHEN contains(json_raw, '\"shoulders\"') OR {_FLAT} = '' THEN json_raw ELSE {_FLAT} END AS flat FROM ({o_ans('json_raw')})"


def proxemic_parts(spark: SparkSession, sf: str) -> DataFrame:
    return VR.answers(spark, sf).select(*KEY, T.parse_parts(F.col("json_raw")).alias("social_distance"))


def _o_part(name: str, default: int) -> str:
    return f"coalesce(CAST(nullif(regexp_extract(json_raw, '\"{name}\": (\\d)', 1), '') AS INTEGER), {default})"


O_PARTS = (
    f"SELECT {KEYS}, CASE WHEN NOT regexp_matches(json_raw, '\\{{[^{{}}]*\\}}') THEN NULL WHEN {_o_part('shoulders', 0)} = 0 THEN 'intimate distance' "
    f"WHEN {_o_part('feet', 0)} = 1 THEN CASE WHEN {_o_part('frame_filled', 1)} = 1 THEN 'close social distance' ELSE 'far social distance' END "
    f"WHEN {_o_part('legs', 0)} = 1 THEN 'close social distance' WHEN {_o_part('waist', 0)} = 1 THEN 'far personal distance' ELSE 'close personal distance' END AS social_distance FROM ({o_ans('json_raw')})"
)


def parse_score_cascade(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score_raw")
    return VR.answers(spark, sf).select(*KEY, T.parse_score(s).alias("score"), T.score_status(s).alias("score_status"))


_NA = "|".join(V.SCORE_NA)
_TRIES = [f"TRY_CAST(nullif(regexp_extract(lower(score_raw), '{p.replace('{hi}', '10')}', 1), '') AS DOUBLE)" for p in V.SCORE_PATTERNS]
_SCORE = "coalesce(" + ", ".join(f"CASE WHEN {t} BETWEEN 1 AND 10 THEN round({t}, 2) END" for t in _TRIES) + ")"
O_SCORE = f"SELECT *, CASE WHEN regexp_matches(score_raw, '(?i){_NA}') THEN NULL ELSE {_SCORE} END AS score, regexp_matches(score_raw, '(?i){_NA}') AS cannot FROM ({o_ans('score_raw')})"


def strip_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    return VR.answers(spark, sf).select(*KEY, T.strip_reasoning(F.col("think_raw")).alias("answer"))


O_THINK = (
    f"SELECT {KEYS}, regexp_replace(CASE WHEN contains(c, '<think>') THEN CASE WHEN contains(c, '</think>') THEN split_part(c, '</think>', -1) ELSE split_part(c, '<think>', 1) END ELSE c END, '^\\s+|\\s+$', '', 'g') AS answer "
    f"FROM (SELECT *, regexp_replace(think_raw, '(?s)<think>.*?</think>', '', 'g') AS c FROM ({o_ans('think_raw')}))"
)


def legacy_age_parse(spark: SparkSession, sf: str) -> DataFrame:
    return VR.answers(spark, sf).select(*KEY, T.legacy_age(F.col("legacy_raw")).alias("age"))


_T = "lower(regexp_replace(legacy_raw, '^\\s+|\\s+$', '', 'g'))"
_AGELINE = "lower(regexp_replace(nullif(regexp_extract(legacy_raw, '(?i)Age:\\s*([^\\n]+)', 1), ''), '^\\s+|\\s+$', '', 'g'))"
_YEARS = f"TRY_CAST(nullif(regexp_extract({_T}, '(\\d{{1,3}})', 1), '') AS INTEGER)"
O_LEGACY = (
    f"SELECT {KEYS}, coalesce({o_na(_AGELINE, o_member(_AGELINE, V.AGE_GROUPS), 'no visible')}, {o_member(_T, V.AGE_GROUPS)}, "
    f"{o_within(_T, [(w, v) for words, v in V.LEGACY_AGE for w in words])}, CASE WHEN {_YEARS} < 13 THEN 'childhood' WHEN {_YEARS} < 30 THEN 'youth' WHEN {_YEARS} < 60 THEN 'adulthood' WHEN {_YEARS} <= 100 THEN 'old age' END) AS age FROM ({o_ans('legacy_raw')})"
)

#: Texts of the older single-task answers, for the parsers that have no catalogue answers of their own.
OLD = VR.cases(
    "c_custkey",
    [
        "Behaviour: demand/seduction", "a friendly demand for attention", "she offers herself", "Behaviour: na", "demand, dominant pose", "Activity: posing", "Label: everyday doings",
        "Body Display: normal clothes", "shirtless on the beach", "wearing a bikini by the sea", "partially but mostly naked", "Location: city", "inside a bedroom", "a plain studio wall",
        "near a river and woods", "makeup: 1 bags: 0", "heavy makeup and a pair of bags", "Location: na", "fully covered, regular", "N/A",
    ],
)


def legacy_task_parsers(spark: SparkSession, sf: str) -> DataFrame:
    c = VR.table(spark, sf, "customer").select("c_custkey", F.expr(OLD).alias("t"))
    t = F.col("t")
    return c.select(
        "c_custkey", T.legacy_gender(t).alias("gender"), T.legacy_behaviour(t).alias("behaviour"), T.legacy_activity(t).alias("activity"), T.legacy_body_display(t).alias("body_display"),
        T.legacy_location(t).alias("location"), T.legacy_accessory(t, "makeup").alias("makeup"), T.legacy_accessory(t, "bags").alias("bags"),
    )


def _o_old(label: str) -> str:
    return f"lower(regexp_replace(nullif(regexp_extract(t, '(?i){label}:\\s*([^\\n]+)', 1), ''), '^\\s+|\\s+$', '', 'g'))"


def _words(table) -> str:
    return o_within("lower(t)", [(w, v) for words, v in table for w in words])


_B, _D, _L, _AC, _G = _o_old("Behaviour"), _o_old("Body Display"), _o_old("Location"), _o_old("(?:Activity|Label)"), _o_old("Gender")
_DEMAND = o_within("lower(t)", [("affiliation", "demand/affiliation"), ("friendly", "demand/affiliation"), ("seduction", "demand/seduction"), ("seductive", "demand/seduction"), ("submission", "demand/submission"), ("dominant", "demand/submission")])
O_OLD = f"""
SELECT c_custkey,
  coalesce({o_na(_G, o_member(_G, V.GENDERS), 'no visible')}, CASE WHEN lower(t) = 'na' OR contains(lower(t), 'n/a') THEN 'no visible' ELSE {o_member('lower(t)', V.GENDERS)} END) AS gender,
  coalesce({o_na(_B, o_member(_B, V.BEHAVIOURS), 'no visible')}, {o_member('lower(t)', V.BEHAVIOURS)}, CASE WHEN contains(lower(t), 'demand') THEN {_DEMAND} END, CASE WHEN contains(lower(t), 'offer') OR contains(lower(t), 'ideal') THEN 'offer/ideal' END) AS behaviour,
  coalesce(CASE WHEN {_AC} IN ({', '.join(repr(a) for a in V.ACTIVITY_ALIASES)}) THEN 'other' ELSE {o_member(_AC, V.ACTIVITIES)} END, 'other') AS activity,
  coalesce({o_na(_D, o_member(_D, V.BODY_DISPLAYS), 'no visible')}, {o_member('lower(t)', V.BODY_DISPLAYS)},
    CASE WHEN contains(lower(t), 'partially') AND contains(lower(t), 'naked') THEN 'partially naked' WHEN contains(lower(t), 'nude') OR contains(lower(t), 'naked') THEN 'no clothes at all' END, {_words(V.LEGACY_BODY_DISPLAY)}) AS body_display,
  coalesce({o_na(_L, o_member(_L, V.LOCATIONS), 'no visible')}, {o_member('lower(t)', V.LOCATIONS)}, {_words(V.LEGACY_LOCATION)}, 'no visible') AS location,
  coalesce(CAST(nullif(regexp_extract(t, '(?i)makeup:\\s*([01])', 1), '') AS INTEGER), CASE WHEN regexp_matches(t, '(?i)\\bmakeup\\b') THEN 1 ELSE 0 END) AS makeup,
  coalesce(CAST(nullif(regexp_extract(t, '(?i)bags:\\s*([01])', 1), '') AS INTEGER), CASE WHEN regexp_matches(t, '(?i)\\bbags\\b') THEN 1 ELSE 0 END) AS bags
FROM (SELECT c_custkey, {OLD} AS t FROM customer)
"""


def ocr_text_join(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a conversation's turns in order, as scene texts are joined; every third one carries the label."""
    c = VR.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.expr("CASE WHEN turn % 3 = 0 THEN concat('text: ', text) WHEN turn % 3 = 1 THEN text ELSE '  ' END").alias("raw"))
    parts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", T.ocr_text(F.col("raw")).alias("t")))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["t"]), " | ").alias("texts"))


O_OCR = """
SELECT conv_id, string_agg(t, ' | ' ORDER BY turn, role, t) AS texts FROM (
  SELECT conv_id, turn, role, coalesce(nullif(regexp_replace(CASE WHEN regexp_extract(raw, '(?is)Text:\\s*(.+)', 1) <> '' THEN regexp_extract(raw, '(?is)Text:\\s*(.+)', 1) ELSE raw END, '^\\s+|\\s+$', '', 'g'), ''), 'No text detected') AS t
  FROM (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN concat('text: ', text) WHEN turn % 3 = 1 THEN text ELSE '  ' END AS raw FROM conversations)
) GROUP BY conv_id
"""


def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lab = T.person_attributes(VR.answers(spark, sf, "raw"), "raw", ["gender"], []).select("l_orderkey", "gender")
    return A.distribution(lab, ["l_orderkey"], "gender").select("l_orderkey", F.col("distribution").alias("genders"))


O_DIST = f"""
SELECT l_orderkey, '{{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}}' AS genders FROM (
  SELECT l_orderkey, coalesce({_O['gender']}, '') AS v, count(*) AS n FROM ({o_ans('raw')}) GROUP BY 1, 2
) GROUP BY l_orderkey
"""


def any_flag(spark: SparkSession, sf: str) -> DataFrame:
    lab = labels(VR.answers(spark, sf, "raw"))
    flags = [A.any_flag(F.when(F.col("l_linenumber") % 3 != 0, F.col(a))).alias(a) for a in ("makeup", "bags", "eyewear")]
    return lab.groupBy("l_orderkey").agg(*flags, F.coalesce(F.bool_or((F.col("makeup") == 1) | (F.col("eyewear") == 1)), F.lit(False)).alias("any_accessory"))


O_FLAG = f"""
SELECT l_orderkey, max(CASE WHEN l_linenumber % 3 <> 0 THEN makeup END) AS makeup, max(CASE WHEN l_linenumber % 3 <> 0 THEN bags END) AS bags, max(CASE WHEN l_linenumber % 3 <> 0 THEN eyewear END) AS eyewear,
  bool_or(makeup = 1 OR eyewear = 1) AS any_accessory FROM ({O_LABELS}) GROUP BY l_orderkey
"""


def analysis_status(spark: SparkSession, sf: str) -> DataFrame:
    lab = labels(VR.answers(spark, sf, "raw"))
    counts = lab.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("persons"), *[F.count_if(~F.coalesce(F.lower(a), F.lit("")).isin("", "na", "no visible")).alias(a) for a in ATTRS])
    rate, status = A.analysis_status(F.col("persons"), [F.col(a) for a in ATTRS])
    return counts.select("l_orderkey", "persons", rate.alias("rate"), status.alias("status"), T.status_word(status).alias("status_word"))


_MISSING = " + ".join(f"greatest(0, persons - {a})" for a in ATTRS)
O_STATUS = f"""
SELECT l_orderkey, persons, round(missing / (persons * {len(ATTRS)}), 3) AS rate, status, CASE status WHEN 'ok' THEN 'completado' WHEN 'partial' THEN 'parcial' ELSE 'vlm_failed' END AS status_word FROM (
  SELECT *, CASE WHEN missing / (persons * {len(ATTRS)}) >= 0.5 THEN 'failed' WHEN missing > 0 THEN 'partial' ELSE 'ok' END AS status FROM (
    SELECT *, {_MISSING} AS missing FROM (
      SELECT l_orderkey, count(*) AS persons, {', '.join(f"count(*) FILTER (WHERE lower(coalesce({a}, '')) NOT IN ('', 'na', 'no visible')) AS {a}" for a in ATTRS)} FROM ({O_LABELS}) GROUP BY l_orderkey)))
"""


def display_attrs(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered display texts of a person, blanks left out."""
    lab = labels(VR.answers(spark, sf, "raw"))
    items = [F.when(~T.is_blank(F.col(a)), T.display_label(F.col(a), a)) for a in ("gender", "age", "behaviour", "body_weight")]
    items.append(F.when(F.col("muscle") == "visible", F.lit("Muscular")))
    items.append(F.when(~T.is_blank(F.col("attire")), T.display_label(F.col("attire"), "attire")))
    letters = F.array_compact(F.array(*[F.when(F.col(a) == 1, F.lit(V.ACCESSORY_LETTERS[a])) for a in V.ACCESSORIES]))
    items.append(F.when(F.size(letters) > 0, F.concat(F.lit("Acc: "), F.array_join(letters, ","))))
    return lab.select(*KEY, F.array_join(F.array_compact(F.array(*items)), " / ").alias("shown"))


def _o_display(a: str) -> str:
    base = f"CASE WHEN {a} IS NULL OR {a} IN ({', '.join(repr(b) for b in V.BLANKS)}) THEN NULL ELSE "
    labels_ = V.LABELS.get(a, {})
    plain = f"upper(substr({a}, 1, 1)) || lower(substr({a}, 2))"
    return base + (f"CASE {a} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels_.items()) + f" ELSE {plain} END" if labels_ else plain) + " END"


_LETTERS = "concat_ws(',', " + ", ".join(f"CASE WHEN {a} = 1 THEN '{V.ACCESSORY_LETTERS[a]}' END" for a in V.ACCESSORIES) + ")"
O_DISPLAY = f"""
SELECT {KEYS}, concat_ws(' / ', {', '.join(_o_display(a) for a in ('gender', 'age', 'behaviour', 'body_weight'))}, CASE WHEN muscle = 'visible' THEN 'Muscular' END, {_o_display('attire')},
  CASE WHEN {_LETTERS} <> '' THEN 'Acc: ' || {_LETTERS} END) AS shown FROM ({O_LABELS})
"""


def grouping_sets_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lab = VR.answers(spark, sf).select((F.col("l_orderkey") % 50).alias("part"), F.coalesce(T.parse_gender(F.col("raw")), F.lit("")).alias("gender"))
    lab.createOrReplaceTempView("v_gender")
    return spark.sql("SELECT part, gender, count(*) AS n, CAST(grouping_id(part, gender) AS BIGINT) AS level FROM v_gender GROUP BY GROUPING SETS ((part, gender), (gender), ())")


O_SETS = f"SELECT part, gender, count(*) AS n, CAST(grouping_id(part, gender) AS BIGINT) AS level FROM (SELECT l_orderkey % 50 AS part, coalesce({_O['gender']}, '') AS gender FROM ({o_ans('raw')})) GROUP BY GROUPING SETS ((part, gender), (gender), ())"


def queries() -> dict:
    return {f.__name__: f for f in (parse_person_labels, parse_scene_last_match, json_flatten_truncated, proxemic_parts, parse_score_cascade, strip_reasoning, legacy_age_parse, legacy_task_parsers, ocr_text_join, category_distribution, any_flag, analysis_status, display_attrs, grouping_sets_distribution)}


def oracle_sql() -> dict[str, str]:
    return {
        "parse_person_labels": f"SELECT {KEYS}, {', '.join(ATTRS + V.ACCESSORIES)} FROM ({O_LABELS})",
        "parse_scene_last_match": f"SELECT {KEYS}, {', '.join(f'{sql} AS {a}' for a, sql in O_SCENE.items())} FROM ({o_ans('scene_raw')})",
        "json_flatten_truncated": f"SELECT {KEYS}, flat, {o_attr('flat')['gender']} AS gender, {o_attr('flat')['attire']} AS attire FROM ({O_FLAT})",
        "proxemic_parts": O_PARTS,
        "parse_score_cascade": f"SELECT {KEYS}, score, CASE WHEN cannot THEN 'no visible' WHEN score IS NOT NULL THEN 'scored' ELSE 'none' END AS score_status FROM ({O_SCORE})",
        "strip_reasoning": O_THINK,
        "legacy_age_parse": O_LEGACY,
        "legacy_task_parsers": O_OLD,
        "ocr_text_join": O_OCR,
        "category_distribution": O_DIST,
        "any_flag": O_FLAG,
        "analysis_status": O_STATUS,
        "display_attrs": O_DISPLAY,
        "grouping_sets_distribution": O_SETS,
    }
