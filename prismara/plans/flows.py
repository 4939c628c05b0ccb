"""Catalogue: metadata, enrichment, comparison, upserts, samples, windows and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rounding as R
from ..functions import textparse as T
from ..operators import aggregates as A
from ..operators import joins, ranks, select
from ..sources import media, metadata, results
from ..sources.tables import parts_of
from . import virtual as VR

# --- metadata chain ------------------------------------------------------------------------------

_POSTS = [
    ("customer", "c_custkey", "tagA", "c_custkey % 3 = 0"),
    ("supplier", "s_suppkey", "tagB", "s_suppkey % 2 = 0"),
    ("part", "p_partkey", "tagC", "p_partkey % 5 = 1"),
]


def _members(key: str) -> str:
    """Multimedia of a post: two members, with single quotes in some rows and without a url in others."""
    return (
        f"CASE WHEN {key} % 4 = 0 THEN concat('[{{\"id\": \"', CAST({key} * 10 + 1 AS STRING), '\", \"type\": \"photo\", \"url\": \"u', CAST({key} AS STRING), '\"}}, {{\"id\": \"', CAST({key} * 10 + 2 AS STRING), '\", \"type\": \"video\", \"url\": \"\"}}]') "
        f"WHEN {key} % 4 = 1 THEN concat('[{{''id'': ''', CAST({key} * 10 + 1 AS STRING), ''', ''type'': ''photo'', ''url'': None}}]') ELSE '' END"
    )


def _sources(spark: SparkSession, sf: str) -> list[DataFrame]:
    out = []
    for name, key, tag, where in _POSTS:
        t = VR.table(spark, sf, name).where(where)
        ident = F.when(F.col(key) % 7 == 0, F.lit("")).otherwise(F.col(key).cast("string"))
        out.append(t.select(ident.alias("id"), F.expr(_members(key)).alias("multimedia"), F.lit(tag).alias("source_tag"), F.col(key).alias("ord")))
    return out


def metadata_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = metadata.chain(_sources(spark, sf), "ord")
    orders = VR.table(spark, sf, "orders")
    stems = orders.select(F.col("o_orderkey").cast("string").alias("stem")).repartition(parts_of(spark.read.parquet(f"{sf}/orders.parquet")), "stem")
    return metadata.resolve(stems, rows)


def matched_media(spark: SparkSession, sf: str) -> DataFrame:
    """Media that some source knows, by themselves or as a member of an album."""
    return metadata.matched(metadata_chain(spark, sf)).select("stem", "match_source")


_UNION = " UNION ALL ".join(f"SELECT CASE WHEN {key} % 7 = 0 THEN '' ELSE CAST({key} AS VARCHAR) END AS id, {key} AS k, {key} AS ord, {i} AS priority, '{tag}' AS tag FROM {name} WHERE {where}" for i, (name, key, tag, where) in enumerate(_POSTS))
O_CHAIN = f"""
WITH s AS ({_UNION}), p AS (SELECT id, tag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, ord) AS n FROM s WHERE id <> '') WHERE n = 1),
e AS (SELECT id, priority, ord, 0 AS pos, CAST(k * 10 + 1 AS VARCHAR) AS member, CASE WHEN k % 4 = 0 THEN 'u' || k END AS url FROM s WHERE k % 4 IN (0, 1) UNION ALL SELECT id, priority, ord, 1, CAST(k * 10 + 2 AS VARCHAR), '' FROM s WHERE k % 4 = 0),
o AS (SELECT member, id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY priority, ord, pos) AS n FROM e) WHERE n = 1),
u AS (SELECT member, url FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY priority, ord, pos) AS n FROM e WHERE url IS NOT NULL AND url <> '') WHERE n = 1),
t AS (SELECT CAST(o_orderkey AS VARCHAR) AS stem FROM orders)
SELECT t.stem, coalesce(p.id, o.owner) AS post_id, u.url, CASE WHEN p.id IS NOT NULL THEN p.tag WHEN q.id IS NOT NULL THEN q.tag || '-album' WHEN o.owner IS NOT NULL THEN 'album-nometa' ELSE 'none' END AS match_source
FROM t LEFT JOIN p ON t.stem = p.id LEFT JOIN o ON t.stem = o.member LEFT JOIN p q ON o.owner = q.id LEFT JOIN u ON t.stem = u.member
"""


def path_resolution(spark: SparkSession, sf: str) -> DataFrame:
    c = VR.table(spark, sf, "customer")
    kind = F.expr(VR.cases("c_custkey", ["videos", "photos", "albums", "albums", "stories", "albums", "albums", "albums"]))
    c = c.select("c_custkey", kind.alias("kind"), F.expr(_members("c_custkey")).alias("multimedia"))
    return c.select("c_custkey", media.resolve_path(F.col("c_custkey").cast("string"), F.col("kind"), F.col("multimedia")).alias("file"))


O_PATH = "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_custkey || '.mp4' WHEN 1 THEN c_custkey || '.jpg' WHEN 4 THEN NULL ELSE CASE WHEN c_custkey % 4 IN (0, 1) THEN (c_custkey * 10 + 1) || '.jpg' END END AS file FROM customer"


def stem_extension(spark: SparkSession, sf: str) -> DataFrame:
    p = VR.table(spark, sf, "pages").withColumn("path", F.regexp_replace("url", r"[?#].*$", ""))
    path = F.when(F.col("page_id") % 3 == 0, F.concat("path", F.lit(".JPG"))).when(F.col("page_id") % 3 == 1, F.concat("path", F.lit(".mp4"))).otherwise(F.col("path"))
    return p.select("page_id", media.file_name(path).alias("name"), media.stem(path).alias("stem"), media.extension(path).alias("ext"), media.media_kind(path).alias("kind"))


_PATH = "CASE page_id % 3 WHEN 0 THEN p || '.JPG' WHEN 1 THEN p || '.mp4' ELSE p END"
O_STEM = f"""
SELECT page_id, f AS name, regexp_replace(f, '\\.[^.]+$', '') AS stem, lower(regexp_extract(f, '\\.([^.]+)$', 1)) AS ext, CASE WHEN lower(regexp_extract(f, '\\.([^.]+)$', 1)) IN ('jpg','jpeg','png','webp','bmp') THEN 'image' WHEN lower(regexp_extract(f, '\\.([^.]+)$', 1)) IN ('mp4','mov','avi','mkv','webm') THEN 'video' END AS kind
FROM (SELECT page_id, regexp_extract({_PATH}, '([^/]*)$', 1) AS f FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages))
"""


def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return select.first_seen(d, ["h"], [F.col("doc_id")]).select("doc_id", "h")


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = VR.table(spark, sf, "customer")
    return c.orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("42"))), "c_custkey").limit(100).select("c_custkey", "c_name")


def batch_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with results of the analysed ones, the rest null."""
    o = VR.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    res = VR.table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("persons"), R.scaled_round(F.avg("l_quantity"), 1).alias("mean_score"))
    return o.join(res, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def long_last_order(spark: SparkSession, sf: str) -> DataFrame:
    """Processing place and chunk of the media: short ones in order, long ones by duration at the end."""
    m = VR.table(spark, sf, "orders").select("o_orderkey", R.scaled_round(F.col("o_totalprice") / 5000, 3).alias("duration"), (F.col("o_orderkey") % 10).alias("lane"))
    order = {f"by{i}": c for i, c in enumerate(media.long_last(m, "duration", "o_orderkey"))}
    m = ranks.before(m.withColumns(order), ["lane"], [*order, "o_orderkey"], "before")
    place = (F.col("before") + 1).cast("int")
    return m.select("lane", "o_orderkey", place.alias("place"), F.floor((place - 1) / 100).cast("long").alias("chunk"))


O_LONG = """
SELECT lane, o_orderkey, CAST(place AS INTEGER) AS place, CAST(floor((place - 1) / 100) AS BIGINT) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY duration >= 60, CASE WHEN duration >= 60 THEN duration END NULLS FIRST, o_orderkey) AS place
FROM (SELECT o_orderkey, round(o_totalprice / 5000, 3) AS duration, o_orderkey % 10 AS lane FROM orders))
"""

# --- comparison ----------------------------------------------------------------------------------


def _manual(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lab = VR.table(spark, sf, "labels").select((F.col("doc_id") % 40).alias("img"), "doc_id", F.col("quality").cast("string").alias("q"), F.when(F.col("toxic") == 1, "sí").otherwise("No").alias("t"))
    docs = VR.table(spark, sf, "documents").where("doc_id % 3 <> 0")
    ai = docs.select((F.col("doc_id") % 41).alias("img"), "doc_id", F.when(F.col("n_chars") > 800, "1").when(F.col("n_chars") < 100, "NA").otherwise("0").alias("q"), F.when(F.col("n_chars") % 2 == 0, "yes").otherwise("no").alias("t"))
    return lab, ai


_LAB = "SELECT doc_id % 40 AS img, doc_id, CAST(quality AS VARCHAR) AS q, CASE WHEN toxic = 1 THEN 'sí' ELSE 'No' END AS t FROM labels"
_AI = "SELECT doc_id % 41 AS img, doc_id, CASE WHEN n_chars > 800 THEN '1' WHEN n_chars < 100 THEN 'NA' ELSE '0' END AS q, CASE WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'no' END AS t FROM documents WHERE doc_id % 3 <> 0"
_ALIGN = f"""SELECT coalesce(a.img, b.img) AS img, CAST(coalesce(a.ordinal, b.ordinal) AS INTEGER) AS ordinal, a.doc_id, b.doc_id AS r_doc_id, a.q, b.q AS rq, a.t, b.t AS rt, CASE WHEN a.img IS NULL THEN 'right_only' WHEN b.img IS NULL THEN 'left_only' ELSE 'matched' END AS row_type
FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY doc_id) AS ordinal FROM ({_LAB})) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY img ORDER BY doc_id) AS ordinal FROM ({_AI})) b ON a.img = b.img AND a.ordinal = b.ordinal"""


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    lab, ai = _manual(spark, sf)
    return joins.align_ordinal(lab, ai, "img", [F.col("doc_id")], [F.col("doc_id")])


def ordinal_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).select("img", "ordinal", "doc_id", "r_doc_id", "row_type")


def row_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).groupBy("row_type").agg(F.count(F.lit(1)).alias("n"))


def mismatch_count(spark: SparkSession, sf: str) -> DataFrame:
    m = A.mismatches([(F.col("r_q"), F.col("q"), False), (F.col("r_t"), F.col("t"), True)])
    return _aligned(spark, sf).where("row_type = 'matched'").select("img", "ordinal", m.cast("int").alias("mismatches"))


O_MISMATCH = f"""
SELECT img, ordinal, CAST(CASE WHEN rq <> 'NA' AND lower(q) <> lower(rq) THEN 1 ELSE 0 END + CASE WHEN CASE WHEN lower(t) = 'sí' THEN 'yes' ELSE lower(t) END <> rt THEN 1 ELSE 0 END AS INTEGER) AS mismatches FROM ({_ALIGN}) WHERE row_type = 'matched'
"""


def mode_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf).withColumn("v", F.when(F.col("event_id") % 5 == 0, "NA").otherwise(F.upper("event_type")))
    return A.first_mode(o, ["user_id"], "v", "frame")


O_MODE = f"""
SELECT user_id, coalesce(max(v) FILTER (WHERE n = 1), 'NA') AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v IS NULL, c DESC, f) AS n FROM (
  SELECT user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE lower(event_type) END AS v, count(*) AS c, min(frame) AS f FROM ({VR.OBS}) GROUP BY 1, 2)) GROUP BY user_id
"""


def agreement_metrics(spark: SparkSession, sf: str) -> DataFrame:
    both = VR.table(spark, sf, "labels").join(VR.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("guess", (F.col("n_chars") > 400).cast("int"))
    k = A.kappa(both, "quality", "guess")
    stats = both.agg(R.scaled_round(F.corr("quality", "guess"), 6).alias("pearson"), R.scaled_round(F.avg(F.abs(F.col("quality") - F.col("guess"))), 6).alias("mae"))
    return k.crossJoin(stats).select("n", R.scaled_round("agreement", 6).alias("agreement"), R.scaled_round("kappa", 6).alias("kappa"), "pearson", "mae")  # one row each


O_AGREE = """
WITH b AS (SELECT quality AS q, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS g FROM labels JOIN documents USING (doc_id)), t AS (SELECT count(*) AS n, avg(CASE WHEN q = g THEN 1.0 ELSE 0.0 END) AS po, avg(q) AS a, avg(g) AS c FROM b)
SELECT t.n, round(po, 6) AS agreement, round((po - (a * c + (1 - a) * (1 - c))) / (1 - (a * c + (1 - a) * (1 - c))), 6) AS kappa, round((SELECT corr(q, g) FROM b), 6) AS pearson, round((SELECT avg(abs(q - g)) FROM b), 6) AS mae FROM t
"""


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of balance and key inside each segment, ties by average rank."""
    c = VR.table(spark, sf, "customer").withColumn("b", F.floor(F.col("c_acctbal") / 100))
    r = ranks.average_rank(c.select("c_mktsegment", "b", "c_nationkey"), ["c_mktsegment"], "b", "x")
    r = ranks.average_rank(r, ["c_mktsegment"], "c_nationkey", "y")
    return r.groupBy("c_mktsegment").agg(R.scaled_round(F.corr("x", "y"), 6).alias("rho"))


_RANK = "rank() OVER (PARTITION BY c_mktsegment ORDER BY {x}) + (count(*) OVER (PARTITION BY c_mktsegment, {x}) - 1) / 2.0"
O_SPEARMAN = f"SELECT c_mktsegment, round(corr(x, y), 6) AS rho FROM (SELECT c_mktsegment, {_RANK.format(x='b')} AS x, {_RANK.format(x='c_nationkey')} AS y FROM (SELECT *, floor(c_acctbal / 100) AS b FROM customer)) GROUP BY 1"

# --- masters -------------------------------------------------------------------------------------


def score_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.table(spark, sf, "orders")
    master = o.select(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise("")).alias("img"), F.when(F.col("o_orderkey") % 4 == 0, R.scaled_round(F.col("o_totalprice") / 100_000, 2)).alias("score"))
    master = master.withColumn("img", T.normal_id(F.col("img")))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("img"), F.when(F.col("o_orderkey") % 6 == 0, 9.5).alias("score"))
    return results.upsert(master, new, ["img"], ["score"])


O_UPSERT = "SELECT CAST(o_orderkey AS VARCHAR) AS img, CASE WHEN o_orderkey % 6 = 0 THEN 9.5 WHEN o_orderkey % 4 = 0 THEN round(o_totalprice / 100000, 2) END AS score FROM orders"


def location_backfill(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.table(spark, sf, "documents")
    master = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("person"), F.when(F.col("doc_id") % 3 == 0, "city").alias("location"))
    new = d.where("doc_id % 5 <> 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"), F.lit("indoors").alias("location"))
    return results.backfill(master, new, "file", "location", F.col("person").isNull() & F.col("location").isNull())


O_BACKFILL = "SELECT doc_id || '.jpg' AS file, CASE WHEN doc_id % 2 = 0 THEN lang END AS person, CASE WHEN doc_id % 3 = 0 THEN 'city' WHEN doc_id % 2 = 1 AND doc_id % 5 <> 0 THEN 'indoors' END AS location FROM documents"


def backfill_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Populated cells before and after the backfill."""
    before = VR.table(spark, sf, "documents").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("before"))
    return before.crossJoin(location_backfill(spark, sf).agg(F.count("location").alias("after")))  # one row each


def append_replace(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    return results.append_replace(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("state", F.lit("new")), ["o_orderkey"])


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.table(spark, sf, "documents").select("doc_id", "source")
    return joins.pending(d, VR.table(spark, sf, "labels"), ["doc_id"])


def stale_packages(spark: SparkSession, sf: str) -> DataFrame:
    d = VR.table(spark, sf, "documents").select("source", F.col("doc_id").alias("file"))
    return results.stale_packages(d, VR.table(spark, sf, "documents").where("doc_id % 23 <> 0").select(F.col("doc_id").alias("file")), "source", "file")


def skipped_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted, distinct names without a media extension."""
    p = VR.table(spark, sf, "pages").select(media.file_name(F.regexp_replace("url", r"[?#].*$", "")).alias("name"))
    return p.where(media.media_kind(F.col("name")).isNull()).distinct().orderBy("name")


def person_rows_image(spark: SparkSession, sf: str) -> DataFrame:
    """One row a person, padded to the announced number, or one row for an image without any."""
    li = T.person_attributes(VR.answers(spark, sf, "raw"), "raw", ["gender"], []).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "gender")
    got = li.withColumn("idx", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    img = VR.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("n"))
    slots = img.withColumn("idx", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n")))))
    rows = slots.join(got, (slots.o_orderkey == got.l_orderkey) & (slots.idx == got.idx), "left").drop(got.idx)
    track = F.when(F.col("n") > 0, F.coalesce(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")), F.concat(F.lit("det_0_"), (F.col("idx") - 1).cast("string"))))
    return rows.select(F.concat_ws("__", F.col("o_orderkey").cast("string"), F.coalesce(F.col("idx").cast("string"), F.lit("none"))).alias("join_id"), track.alias("track_id"), F.when(F.col("n") > 0, F.col("gender")).alias("gender"))


def _o_person_rows() -> str:
    from .answers import _O, o_ans

    return f"""
WITH g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS idx, {_O['gender']} AS gender FROM ({o_ans('raw')})),
s AS (SELECT o_orderkey, o_orderkey % 4 AS n, unnest(CASE WHEN o_orderkey % 4 > 0 THEN range(1, o_orderkey % 4 + 1) ELSE [NULL] END) AS idx FROM orders)
SELECT o_orderkey || '__' || coalesce(CAST(s.idx AS VARCHAR), 'none') AS join_id, CASE WHEN n > 0 THEN coalesce('t' || l_suppkey, 'det_0_' || (s.idx - 1)) END AS track_id, CASE WHEN n > 0 THEN gender END AS gender FROM s LEFT JOIN g ON s.o_orderkey = g.l_orderkey AND s.idx = g.idx
"""


def person_rows_video(spark: SparkSession, sf: str) -> DataFrame:
    """Persons of a video's scenes, numbered over the whole file; scenes without persons keep a row."""
    d = VR.detections(spark, sf).select("media", F.col("frame").alias("scene"), "l_partkey", "l_suppkey")
    scenes = d.select("media", "scene").distinct()
    persons = d.where("l_partkey % 3 <> 0").withColumn("idx", F.row_number().over(W.partitionBy("media").orderBy("scene", "l_partkey", "l_suppkey")))
    rows = scenes.join(persons, ["media", "scene"], "left")
    return rows.select(F.concat_ws("__", F.col("media").cast("string"), F.col("scene").cast("string"), F.coalesce(F.col("idx").cast("string"), F.lit("none"))).alias("join_id"), "l_partkey", "l_suppkey")


O_VIDEO_ROWS = f"""
WITH d AS ({VR.DET}), p AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY frame, l_partkey, l_suppkey) AS idx FROM d WHERE l_partkey % 3 <> 0)
SELECT s.media || '__' || s.frame || '__' || coalesce(CAST(idx AS VARCHAR), 'none') AS join_id, l_partkey, l_suppkey FROM (SELECT DISTINCT media, frame FROM d) s LEFT JOIN p ON s.media = p.media AND s.frame = p.frame
"""


def output_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed column order with missing ones null, and both recodings of a flag."""
    s = VR.table(spark, sf, "supplier").withColumn("flag", F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 2).cast("int")))
    s = s.select("s_suppkey", T.flag_word_video(F.col("flag")).alias("video_word"), T.flag_word_image(F.col("flag")).alias("image_word"))
    return results.in_columns(s, ["video_word", "s_suppkey", "review", "image_word"])


# --- statistics and windows ----------------------------------------------------------------------


def score_statistics(spark: SparkSession, sf: str) -> DataFrame:
    e = VR.table(spark, sf, "events").withColumn("score", F.when(F.col("event_id") % 6 != 0, F.col("value")))
    return A.score_statistics(e, ["event_type"], "score", 6)


def castable_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the answers' scores that are numbers, to one decimal, a media; null where none is."""
    a = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "_metadata.file_name", "_metadata.row_index", F.expr(VR.TEXTS["score_raw"]).alias("score_raw"))
    return A.means_in_order(a, ["l_orderkey"], "score_raw", ["file_name", "row_index"], 1)


O_CASTABLE = f"SELECT l_orderkey, count(*) AS answers, count(s) AS scores, round(avg(s), 1) AS mean_score FROM (SELECT l_orderkey, TRY_CAST({VR.SCORE} AS DOUBLE) AS s FROM lineitem) GROUP BY l_orderkey"


def percentile_rescale(spark: SparkSession, sf: str) -> DataFrame:
    c = VR.table(spark, sf, "customer")
    ranked = ranks.percent_rank(c.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal", "share")
    return ranked.select("c_custkey", R.scaled_round(1 + 9 * F.col("share"), 6).alias("scaled"))


def decile_split(spark: SparkSession, sf: str) -> DataFrame:
    """Train, validation and test parts of 80, 10 and 10 percent inside deciles."""
    c = VR.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.md5(F.col("c_custkey").cast("string")).alias("draw"))
    c = ranks.ntile(c, ["c_mktsegment"], ["c_acctbal", "c_custkey"], 10, "decile")
    part = ["c_mktsegment", "decile"]
    c = ranks.sized(ranks.before(c, part, ["draw", "c_custkey"], "at"), part, "n")
    share = F.col("at") / F.col("n")
    return c.select("c_custkey", "decile", F.when(share < 0.8, "train").when(share < 0.9, "val").otherwise("test").alias("part"))


O_DECILE = """
WITH d AS (SELECT *, CAST(ntile(10) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INTEGER) AS decile FROM customer),
s AS (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment, decile ORDER BY md5(CAST(c_custkey AS VARCHAR))) - 1) / count(*) OVER (PARTITION BY c_mktsegment, decile) AS share FROM d)
SELECT c_custkey, decile, CASE WHEN share < 0.8 THEN 'train' WHEN share < 0.9 THEN 'val' ELSE 'test' END AS part FROM s
"""


def throughput_moving(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf).withColumn("tokens", F.col("event_id") % 50).withColumn("seconds", 1 + F.col("event_id") % 7)
    return A.moving_rate(o, "user_id", [F.col("frame")], "tokens", "seconds").select("user_id", "frame", R.scaled_round("rate", 6).alias("rate"))


O_MOVING = f"SELECT user_id, frame, round(sum(event_id % 50) OVER w / sum(1 + event_id % 7) OVER w, 6) AS rate FROM ({VR.OBS}) WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def forward_fill_cache(spark: SparkSession, sf: str) -> DataFrame:
    o = VR.observations(spark, sf).withColumn("answer", F.when(F.col("event_id") % 4 == 0, F.col("event_type")))
    return select.forward_fill(o, "user_id", [F.col("frame")], "answer").select("user_id", "frame", "filled")


O_FILL = f"SELECT user_id, frame, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM ({VR.OBS})"


def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = VR.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"), R.scaled_round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.unix_timestamp(F.col("session_window.start").cast("timestamp")).alias("start_s"), "n", "total")


O_SESSION = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
"""


def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = VR.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    t = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def scene_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Scene labels in numeric order, sub-scenes included."""
    d = VR.table(spark, sf, "orders").select((F.col("o_orderkey") % 30).cast("string").alias("a"), (F.col("o_orderkey") % 7).cast("string").alias("b"), "o_custkey").withColumn("label", F.when(F.col("b") == "0", F.col("a")).otherwise(F.concat_ws(".", "a", "b")))
    rows = d.select("o_custkey", "label").distinct()
    w = W.partitionBy("o_custkey").orderBy(F.split("label", r"\.")[0].cast("int"), F.coalesce(F.get(F.split("label", r"\."), F.lit(1)).cast("int"), F.lit(0)))
    return rows.select("o_custkey", "label", F.row_number().over(w).alias("place"))


O_SORT = """
SELECT o_custkey, label, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(split_part(label, '.', 1) AS INTEGER), coalesce(TRY_CAST(split_part(label, '.', 2) AS INTEGER), 0)) AS INTEGER) AS place
FROM (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 30 AS VARCHAR) ELSE (o_orderkey % 30) || '.' || (o_orderkey % 7) END AS label FROM orders)
"""


def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Track pairs of a media that share a frame."""
    d = VR.detections(spark, sf).select("media", "frame", "track").distinct()
    b = d.withColumnRenamed("track", "other")
    return d.join(b, ["media", "frame"]).where("track < other").groupBy("media", "track", "other").agg(F.count(F.lit(1)).alias("frames"))


O_COOC = f"WITH d AS (SELECT DISTINCT media, frame, track FROM ({VR.DET})) SELECT a.media, a.track, b.track AS other, count(*) AS frames FROM d a JOIN d b ON a.media = b.media AND a.frame = b.frame AND a.track < b.track GROUP BY 1, 2, 3"


def queries() -> dict:
    made = (
        metadata_chain, matched_media, path_resolution, stem_extension, first_wins_dedup, seeded_sample, batch_enrichment, long_last_order, ordinal_alignment, row_type_counts, mismatch_count, mode_first_seen, agreement_metrics, spearman, score_upsert,
        location_backfill, backfill_cells, append_replace, resume_pending, stale_packages, skipped_files, person_rows_image, person_rows_video, output_columns, score_statistics, castable_means, percentile_rescale, decile_split, throughput_moving,
        forward_fill_cache, session_windows, tumbling_counts, scene_sort, cooccurrence,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    score = "CASE WHEN event_id % 6 <> 0 THEN value END"
    return {
        "metadata_chain": O_CHAIN,
        "matched_media": f"SELECT stem, match_source FROM ({O_CHAIN}) WHERE match_source <> 'none'",
        "path_resolution": O_PATH,
        "stem_extension": O_STEM,
        "first_wins_dedup": "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)",
        "seeded_sample": "SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), c_custkey LIMIT 100",
        "batch_enrichment": "SELECT o_orderkey, o_custkey, o_orderstatus, persons, mean_score FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS persons, round(avg(l_quantity), 1) AS mean_score FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1) ON o_orderkey = l_orderkey",
        "long_last_order": O_LONG,
        "ordinal_alignment": f"SELECT img, ordinal, doc_id, r_doc_id, row_type FROM ({_ALIGN})",
        "row_type_counts": f"SELECT row_type, count(*) AS n FROM ({_ALIGN}) GROUP BY 1",
        "mismatch_count": O_MISMATCH,
        "mode_first_seen": O_MODE,
        "agreement_metrics": O_AGREE,
        "spearman": O_SPEARMAN,
        "score_upsert": O_UPSERT,
        "location_backfill": O_BACKFILL,
        "backfill_cells": f"SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS before, (SELECT count(location) FROM ({O_BACKFILL})) AS after",
        "append_replace": "SELECT o_orderkey, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0",
        "resume_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "stale_packages": "SELECT source, bool_or(doc_id % 23 = 0) AS stale FROM documents GROUP BY 1",
        "skipped_files": "SELECT DISTINCT regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages WHERE lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '\\.([^.]+)$', 1)) NOT IN ('jpg','jpeg','png','webp','bmp','mp4','mov','avi','mkv','webm')",
        "person_rows_image": _o_person_rows(),
        "person_rows_video": O_VIDEO_ROWS,
        "output_columns": "SELECT CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 2 = 1 THEN 'sí' ELSE 'no' END END AS video_word, s_suppkey, CAST(NULL AS VARCHAR) AS review, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 1 THEN 'sí' ELSE 'no' END AS image_word FROM supplier",
        "score_statistics": f"SELECT event_type, count({score}) AS n, round(avg({score}), 6) AS mean, round(median({score}), 6) AS median, min({score}) AS low, max({score}) AS high, round(stddev_pop({score}), 6) AS spread FROM events GROUP BY 1",
        "castable_means": O_CASTABLE,
        "percentile_rescale": "SELECT c_custkey, round(1 + 9 * percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 6) AS scaled FROM customer",
        "decile_split": O_DECILE,
        "throughput_moving": O_MOVING,
        "forward_fill_cache": O_FILL,
        "session_windows": O_SESSION,
        "tumbling_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "scene_sort": O_SORT,
        "cooccurrence": O_COOC,
    }
