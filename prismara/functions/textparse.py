"""Parsers of model answers and small text normalisers, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V

SPACES = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null without a match (an empty group counts as none)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def mapped(c: Column, mapping: Mapping[str, str]) -> Column:
    """Value of an exact key, else the key itself."""
    out = c
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_within(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Label of the first word that the text contains, else null."""
    out = None
    for w, v in pairs:
        hit = c.contains(w)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return F.lit(None).cast("string") if out is None else out


def member(c: Column, values: Iterable[str]) -> Column:
    return first_within(c, [(v, v) for v in values])


def line_value(text: Column, label: str) -> Column:
    """Lower-cased value of the first line ``label: value``, null without one."""
    return F.lower(strip(found(text, rf"(?imd)^\s*{label}\s*:\s*([^\n]+)")))


def _with_na(raw: Column, parsed: Column, na: str) -> Column:
    return F.when(raw.isin("na", "n/a"), F.lit(na)).otherwise(parsed)


def gender_of(raw: Column) -> Column:
    return _with_na(raw, member(raw, V.GENDERS), "no visible")


def age_of(raw: Column) -> Column:
    return _with_na(raw, member(raw, V.AGE_GROUPS), "no visible")


def behaviour_of(raw: Column) -> Column:
    """Full label, else a bare second half; one label is renamed on output."""
    renamed = lambda pairs: [(w, V.BEHAVIOUR_RENAMED.get(v, v)) for w, v in pairs]
    label = first_within(raw, renamed([*((v, v) for v in V.BEHAVIOURS), *V.BEHAVIOUR_SUFFIXES.items()]))
    return _with_na(raw, label, "no visible")


def body_display_of(raw: Column) -> Column:
    return _with_na(raw, member(raw, V.BODY_DISPLAYS), "no visible")


def body_weight_of(raw: Column) -> Column:
    pairs = [*((v, v) for v in V.BODY_WEIGHTS), *V.BODY_WEIGHT_SYNONYMS.items()]
    return _with_na(raw, first_within(raw, [(w, V.ADIPOSITY.get(v, v)) for w, v in pairs]), "not visible")


def muscle_of(raw: Column) -> Column:
    """Negative words first: they may hold positive ones, and ``na`` or ``0`` anywhere counts as negative."""
    return first_within(raw, [(w, "not visible") for w in V.MUSCLE_NEGATIVE] + [(w, "visible") for w in V.MUSCLE_POSITIVE])


def attire_of(raw: Column) -> Column:
    pairs = [("informal", "casual"), *((v, v) for v in V.ATTIRES), *V.ATTIRE_SYNONYMS.items()]
    return _with_na(raw, first_within(raw, pairs), "not visible")


#: Person attribute -> (its line's label, the parser of the line's value).
PERSON = {
    "gender": ("Gender", gender_of), "age": ("Age", age_of), "behaviour": ("Behaviour", behaviour_of), "body_display": ("BodyDisplay", body_display_of),
    "body_weight": ("BodyWeight", body_weight_of), "muscle": ("Musculature", muscle_of), "attire": ("Attire", attire_of),
}


def _parser(name: str):
    label, parse = PERSON[name]
    return lambda text: let(line_value(text, label), parse)


parse_gender, parse_age, parse_behaviour, parse_body_display = (_parser(n) for n in ("gender", "age", "behaviour", "body_display"))
parse_body_weight, parse_muscle, parse_attire = (_parser(n) for n in ("body_weight", "muscle", "attire"))


def parse_accessory(text: Column, name: str) -> Column:
    """0 or 1; 0 without its line."""
    return F.coalesce(found(text, rf"(?imd)^\s*{name}\s*:\s*([01])").cast("int"), F.lit(0))


#: A label line with its value, looked ahead for from every line's start, so a value that is a label line itself is one as well.
_LINE = r"(?md)^(?=(\s*[a-z]+\s*:\s*[^\n]+))"
_WHITE = " \t\n\x0b\f\r"


def person_attributes(df: DataFrame, text: str, attributes: Iterable[str] = tuple(PERSON), accessories: Iterable[str] = tuple(V.ACCESSORIES)) -> DataFrame:
    """``df`` with attributes of an answer in ``text``, as the single parsers find them.

    The label lines are found in one pass with their values, and values are looked up by label; every step is a projection of its
    own, which the optimizer does not fold into its many uses.
    """
    attributes, accessories, kept = list(attributes), list(accessories), df.columns
    df = df.withColumn("__lines", F.regexp_extract_all(F.lower(F.col(text)), F.lit(_LINE), F.lit(1)))
    white = F.lit(_WHITE)
    label = F.transform("__lines", lambda x: F.btrim(F.substring_index(x, ":", 1), white))
    said = F.transform("__lines", lambda x: F.ltrim(F.substring(x, F.locate(":", x) + 1, F.length(x)), white))
    df = df.withColumns({"__k": label, "__v": said})
    first = lambda keys, values, key: F.get(values, (F.array_position(keys, key) - 1).cast("int"))
    raws = {f"__raw_{a}": strip(first("__k", "__v", PERSON[a][0].lower())) for a in attributes}
    if accessories:  # of a flag's lines the first that says 0 or 1
        df = df.withColumn("__f", F.filter(F.zip_with("__k", "__v", lambda k, v: F.concat(k, F.lit(":"), F.left(v, F.lit(1)))), lambda f: f.endswith(":0") | f.endswith(":1")))
    worn = lambda a: F.array_position("__f", f"{a}:1")
    bare = lambda a: F.array_position("__f", f"{a}:0")
    flags = {a: F.when((worn(a) > 0) & ((bare(a) == 0) | (worn(a) < bare(a))), 1).otherwise(0) for a in accessories}
    df = df.withColumns(raws | flags)
    df = df.withColumns({a: PERSON[a][1](F.col(f"__raw_{a}")) for a in attributes})
    return df.select(*[c for c in kept if c not in {*attributes, *accessories}], *attributes, *accessories)


def clean_value(raw: Column) -> Column:
    raw = F.regexp_replace(F.lower(strip(raw)), r"""^[*\s"']+|[*\s"']+$""", "")
    return F.regexp_replace(raw, r"[.,;:!]+$", "")


def last_valid(text: Column, label: str, verdict) -> Column:
    """``verdict`` of the last line of a label that has one; lines with placeholders are passed over."""
    lines = F.regexp_extract_all(text, F.lit(rf"(?imd){V.LABEL_START}{label}{V.LABEL_END}([^\n]+)"), F.lit(1))
    seen = F.transform(F.transform(F.reverse(lines), clean_value), lambda v: F.when(~v.rlike("[<>]"), verdict(v)))
    return F.get(F.filter(seen, lambda x: x.isNotNull()), F.lit(0))


def parse_activity(text: Column) -> Column:
    last = last_valid(text, "activity", lambda v: F.when(v.isin(V.ACTIVITY_ALIASES), "other").otherwise(member(v, V.ACTIVITIES)))
    return F.coalesce(last, F.lit("other"))


def parse_location(text: Column) -> Column:
    last = last_valid(text, "location", lambda v: F.when(v.isin("na", "n/a"), V.LOCATION_FALLBACK).otherwise(member(v, V.LOCATIONS)))
    return F.coalesce(last, F.lit(V.LOCATION_FALLBACK))


def parse_social_distance(text: Column) -> Column:
    return last_valid(text, r"social\s*distance", lambda v: member(v, V.SOCIAL_DISTANCES))


def _balanced(depth: int = 8) -> str:
    """Pattern of ``{...}`` with its inner braces in pairs, nested up to ``depth`` deep."""
    inside = r"[^{}]*+"
    for _ in range(depth):
        inside = rf"[^{{}}]*+(?:\{{{inside}\}}[^{{}}]*+)*+"
    return rf"(\{{{inside}\}})"


def balanced_object(text: Column) -> Column:
    """The first ``{...}`` whose braces are in pairs (quotes do not matter), null where none is, as in a cut answer."""
    return found(text, _balanced())


def json_values(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__json_<key>`` of the known keys of a JSON answer: decoded where an object is whole, else recovered from what is there.

    A value may be nested as ``{"class": v}``. A key of the decoded object that has no value has none here either.
    """
    kept, t = df.columns, F.col(text)
    df = df.withColumn("__o", F.from_json(balanced_object(t), "map<string,string>"))
    df = df.withColumns({f"__d_{k}": F.try_element_at("__o", F.lit(k)) for k in V.JSON_LABELS})
    decoded = {k: F.when(F.col(f"__d_{k}").startswith("{"), F.get_json_object(f"__d_{k}", "$.class")).otherwise(F.col(f"__d_{k}")) for k in V.JSON_LABELS}
    df = df.withColumns({f"__d_{k}": c for k, c in decoded.items()})
    cut = F.coalesce(*[F.col(f"__d_{k}") for k in V.JSON_LABELS]).isNull() & t.contains("{")
    found_in = {"__nk": (V.NESTED_VALUE, 1), "__nv": (V.NESTED_VALUE, 2), "__fk": (V.FLAT_VALUE, 1), "__fv": (V.FLAT_VALUE, 2)}
    df = df.withColumns({c: F.when(cut, F.regexp_extract_all(t, F.lit(p), F.lit(g))) for c, (p, g) in found_in.items()})
    first = lambda keys, values, key: F.nullif(F.get(values, (F.array_position(keys, key) - 1).cast("int")), F.lit(""))
    values = {f"__json_{k}": F.coalesce(f"__d_{k}", first("__nk", "__nv", k), first("__fk", "__fv", k)) for k in V.JSON_LABELS}
    return df.withColumns(values).select(*kept, *values)


def flatten_json(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with ``into``: a JSON answer as ``Label: value`` lines; body-part JSON and texts without a known key as they are."""
    kept, t = df.columns, F.col(text)
    parts = any_of(t, V.PARTS_KEYS)
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(f"__json_{key}")) for key, label in V.JSON_LABELS.items()])
    df = json_values(df, text).withColumn("__lines", lines)
    return df.withColumn(into, F.when(parts | (F.col("__lines") == ""), t).otherwise(F.col("__lines"))).select(*[c for c in kept if c != into], into)


def first_object(text: Column) -> Column:
    """First ``{...}`` without braces inside."""
    return found(text, r"(?s)(\{[^{}]*\})")


def distance_of_parts(shoulders: Column, waist: Column, legs: Column, feet: Column, filled: Column) -> Column:
    return (
        F.when(shoulders == 0, "intimate distance")
        .when(feet == 1, F.when(filled == 1, "close social distance").otherwise("far social distance"))
        .when(legs == 1, "close social distance")
        .when(waist == 1, "far personal distance")
        .otherwise("close personal distance")
    )


def parse_parts(text: Column) -> Column:
    """Proxemic class of a body-part JSON answer, null where there is none."""
    obj = F.from_json(first_object(text), "shoulders int, waist int, legs int, feet int, frame_filled int")
    part = lambda k, d: F.coalesce(obj[k], F.lit(d))
    label = distance_of_parts(part("shoulders", 0), part("waist", 0), part("legs", 0), part("feet", 0), part("frame_filled", 1))
    return F.when(first_object(text).isNotNull(), label)


def cannot_score(text: Column) -> Column:
    return strip(text).rlike("(?i)" + "|".join(V.SCORE_NA))


def parse_score(text: Column, low: float = 1, high: float = 10) -> Column:
    """First pattern whose first match is on the scale; null where none is or the answer says it cannot be given."""
    t = F.lower(strip(text))
    tries = []
    for p in V.SCORE_PATTERNS:
        value = found(t, p.replace("{hi}", str(int(high)))).try_cast("double")
        tries.append(F.when((value >= low) & (value <= high), F.round(value, 2)))
    return F.when(~cannot_score(text), F.coalesce(*tries))


def score_status(text: Column) -> Column:
    return F.when(cannot_score(text), "no visible").when(parse_score(text).isNotNull(), "scored").otherwise("none")


def ocr_text(text: Column) -> Column:
    """What follows ``Text:``, else everything; a fixed sentence where that is empty."""
    after = F.regexp_extract(text, r"(?is)Text:\s*(.+)", 1)
    return F.coalesce(F.nullif(strip(F.when(after != "", after).otherwise(F.coalesce(text, F.lit("")))), F.lit("")), F.lit("No text detected"))


def strip_reasoning(text: Column) -> Column:
    """Without ``<think>`` blocks; what follows an unclosed one is dropped."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    after_close = F.substring_index(closed, "</think>", -1)
    left = F.when(closed.contains("</think>"), after_close).otherwise(F.substring_index(closed, "<think>", 1))
    return strip(F.when(closed.contains("<think>"), left).otherwise(closed))


def any_of(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def heuristics(c: Column, table: Iterable[tuple[list[str], str]]) -> Column:
    out = F.lit(None).cast("string")
    for words, label in reversed(list(table)):
        out = F.when(any_of(c, words), F.lit(label)).otherwise(out)
    return out


def _labelled(text: Column, label: str) -> Column:
    return F.lower(strip(found(text, rf"(?i){label}:\s*([^\n]+)")))


def legacy_gender(text: Column) -> Column:
    t, raw = F.lower(strip(text)), _labelled(text, "Gender")
    anywhere = F.when((t == "na") | t.contains("n/a"), "no visible").otherwise(member(t, V.GENDERS))
    return F.coalesce(_with_na(raw, member(raw, V.GENDERS), "no visible"), anywhere)


def legacy_age(text: Column) -> Column:
    """Line, anywhere, keywords, then the first number up to 100."""
    t, raw = F.lower(strip(text)), _labelled(text, "Age")
    years = found(t, r"(\d{1,3})").try_cast("int")
    group = F.when(years < 13, "childhood").when(years < 30, "youth").when(years < 60, "adulthood").when(years <= 100, "old age")
    return F.coalesce(_with_na(raw, member(raw, V.AGE_GROUPS), "no visible"), member(t, V.AGE_GROUPS), heuristics(t, V.LEGACY_AGE), group)


def legacy_behaviour(text: Column) -> Column:
    t, raw = F.lower(strip(text)), _labelled(text, "Behaviour")
    demand = heuristics(t, [(["affiliation", "friendly"], "demand/affiliation"), (["seduction", "seductive"], "demand/seduction"), (["submission", "dominant"], "demand/submission")])
    return F.coalesce(_with_na(raw, member(raw, V.BEHAVIOURS), "no visible"), member(t, V.BEHAVIOURS), F.when(t.contains("demand"), demand), heuristics(t, [(["offer", "ideal"], "offer/ideal")]))


def legacy_activity(text: Column) -> Column:
    raw = _labelled(text, "(?:Activity|Label)")
    return F.coalesce(F.when(raw.isin(V.ACTIVITY_ALIASES), "other").otherwise(member(raw, V.ACTIVITIES)), F.lit("other"))


def legacy_body_display(text: Column) -> Column:
    t, raw = F.lower(strip(text)), _labelled(text, "Body Display")
    naked = F.when(t.contains("partially") & t.contains("naked"), "partially naked").when(any_of(t, ["no clothes at all", "nude", "naked"]), "no clothes at all")
    return F.coalesce(_with_na(raw, member(raw, V.BODY_DISPLAYS), "no visible"), member(t, V.BODY_DISPLAYS), naked, heuristics(t, V.LEGACY_BODY_DISPLAY))


def legacy_location(text: Column) -> Column:
    t, raw = F.lower(strip(text)), _labelled(text, "Location")
    return F.coalesce(_with_na(raw, member(raw, V.LOCATIONS), "no visible"), member(t, V.LOCATIONS), heuristics(t, V.LEGACY_LOCATION), F.lit("no visible"))


def legacy_accessory(text: Column, name: str) -> Column:
    """Its flag, else 1 where it is merely named."""
    return F.coalesce(found(text, rf"(?i){name}:\s*([01])").cast("int"), F.when(text.rlike(rf"(?i)\b{name}\b"), 1).otherwise(0))


def is_blank(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(V.BLANKS)


def display_label(c: Column, kind: str) -> Column:
    """Label of a value, else the value with only its first letter in upper case."""
    key = F.lower(strip(c))
    label = F.lit(None).cast("string")
    for k, v in V.LABELS.get(kind, {}).items():
        label = F.when(key == k, F.lit(v)).otherwise(label)
    return F.coalesce(label, F.concat(F.upper(F.substring(strip(c), 1, 1)), F.lower(F.substring(strip(c), 2, 1_000_000))))


def normal(c: Column, binary: bool = False) -> Column:
    """For comparisons: ``NA`` for what says nothing, else lower-cased; yes/no words and 0/1 where ``binary``."""
    s = F.lower(strip(c.cast("string")))
    out = F.when(s.isNull() | s.isin("na", "nan", "none", ""), "NA")
    if binary:
        out = out.when(s.isin("yes", "sí", "si", "1"), "yes").when(s.isin("no", "0"), "no")
    return out.otherwise(s)


def normal_id(c: Column) -> Column:
    """``12345.0`` as ``12345``; other ids as they are, trimmed."""
    return F.regexp_replace(strip(c.cast("string")), r"^(\d+)\.0$", "$1")


def flag_word_video(c: Column) -> Column:
    return F.when(c == 1, "sí").when(c == 0, "no")


def flag_word_image(c: Column) -> Column:
    return F.when(c == 1, "sí").otherwise("no")


def status_word(c: Column) -> Column:
    return F.coalesce(F.nullif(mapped(c, V.STATUS), c), F.lit("completado"))


def parse_multimedia(c: Column) -> Column:
    """Array of (id, type, url): JSON, or a literal with single quotes and None/True/False; null where neither."""
    kind = "array<struct<id:string,type:string,url:string>>"
    literal = F.regexp_replace(F.regexp_replace(c, r"\bNone\b", "null"), r"\b(True|False)\b", '"$1"')
    return F.coalesce(F.from_json(c, kind), F.from_json(literal, kind, {"allowSingleQuotes": "true"}))


def track_index(c: Column) -> Column:
    """Third part of ``det_a_b`` as a number, null where it is none."""
    return F.get(F.split(c, "_"), F.lit(2)).try_cast("int")


def accessory_flag(flags: Column, names: Column, accessory: str) -> Column:
    """Whether a person has an accessory, from either kind of result: a map of flags, else a list of the names that were seen."""
    by_flag = F.map_contains_key(flags, "makeup") | F.map_contains_key(flags, "tattoos")
    flagged = F.coalesce(F.try_element_at(flags, F.lit(accessory)), F.lit(0)) != 0
    listed = F.arrays_overlap(F.transform(names, F.lower), F.array(*[F.lit(n) for n in V.ACCESSORY_NAMES[accessory]]))
    return F.when(by_flag, flagged).otherwise(F.coalesce(listed, F.lit(False)))


def error_state(message: Column) -> Column:
    """State text of a failed file: the first 100 characters of the message."""
    return F.concat(F.lit("error: "), F.substring(F.coalesce(message, F.lit("")), 1, 100))


def run_stamp(at: Column) -> Column:
    """Run id of a time, to the second."""
    return F.date_format(at, "yyyyMMdd_HHmmss")
