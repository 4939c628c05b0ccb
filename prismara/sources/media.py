"""Media listings, path resolution and the duration cache."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textparse as T
from ..functions import vocab as V
from .containers import probe_contents
from .sheets import read_sheet


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def media_kind(path: Column) -> Column:
    return F.when(extension(path).isin(V.IMAGE_EXTENSIONS), "image").when(extension(path).isin(V.VIDEO_EXTENSIONS), "video")


def list_media(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, length, modified, stem, ext, kind) of image and video files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.select("*", stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("ext"), media_kind(F.col("path")).alias("kind")).where("kind IS NOT NULL")


def collect_inputs(spark: SparkSession, source: str, id_columns: Sequence[str] = ("Img ID", "id", "img_id"), path_columns: Sequence[str] = ("Ruta Img.", "path", "input_path"), limit: int | None = None) -> DataFrame:
    """(img_id, path), first of each id, from a CSV file or a sheet, a folder or a glob."""
    csv = source.lower().endswith((".csv", ".xlsx"))
    if csv:
        rows = read_sheet(spark, source) if source.lower().endswith(".xlsx") else spark.read.csv(source, header=True)
        pick = lambda names: next((n for n in names if n in rows.columns), None)
        ident, path = pick(id_columns), pick(path_columns)
        if path is None:
            raise ValueError(f"no path column among {rows.columns}")
        rows = rows.select(F.col(f"`{path}`").alias("path"), (F.col(f"`{ident}`") if ident else stem(F.col(f"`{path}`"))).alias("img_id"))
    else:
        rows = list_media(spark, source, recursive="*" not in source).select("path", F.col("stem").alias("img_id"))
    # a file's rows keep their order in the file, a folder's files are taken by path
    rows = rows.withColumn("img_id", T.normal_id(F.col("img_id"))).withColumn("__place", F.monotonically_increasing_id() if csv else F.col("path"))
    rows = rows.groupBy("img_id").agg(F.min_by("path", "__place").alias("path"), F.min("__place").alias("__place"))
    return (rows if limit is None else rows.orderBy("__place").limit(limit)).drop("__place")


def resolve_path(ident: Column, content_type: Column, multimedia: Column) -> Column:
    """File name of a post: its id for videos and photos, the first member's for albums, else null."""
    first = F.get(T.parse_multimedia(multimedia), F.lit(0))
    album = F.when(first["id"].isNotNull(), F.concat(first["id"], F.when(first["type"] == "photo", ".jpg").otherwise(".mp4")))
    return F.when(content_type == "videos", F.concat(ident, F.lit(".mp4"))).when(content_type == "photos", F.concat(ident, F.lit(".jpg"))).when(content_type == "albums", album)


def existing(rows: DataFrame, name_col: str, listing: DataFrame) -> DataFrame:
    """Rows whose file is in the listing, with its path."""
    known = listing.select(file_name(F.col("path")).alias(name_col), F.col("path").alias("found_path")).groupBy(name_col).agg(F.min("found_path").alias("found_path"))
    return rows.join(known, name_col)


def fallback_paths(rows: DataFrame, token: str, base: str, listing: DataFrame) -> DataFrame:
    """``rows`` with ``found_path``: the token where it is a listed path, else that name under ``base``, else null."""
    known = listing.select(F.col("path").alias("__p")).distinct()
    under = known.select(F.col("__p").alias("__u"))
    out = rows.join(known, F.col(token) == F.col("__p"), "left").join(under, F.concat(F.lit(base.rstrip("/") + "/"), F.col(token)) == F.col("__u"), "left")
    return out.withColumn("found_path", F.coalesce("__p", "__u")).drop("__p", "__u")


def subset(rows: DataFrame, ident: str, ids: str | DataFrame) -> DataFrame:
    """Rows of the wanted ids: numbers in a text, parted by commas, or a frame of lines with one each."""
    if isinstance(ids, str):
        wanted = rows.sparkSession.createDataFrame([(int(x),) for x in ids.split(",") if x.strip()], "__id long")
    else:
        wanted = ids.select(F.trim(F.col(ids.columns[0])).try_cast("long").alias("__id")).where("__id IS NOT NULL").distinct()
    return rows.join(wanted, F.col(ident).try_cast("long") == F.col("__id"), "left_semi")


def downloaded(rows: DataFrame, flag: str, path: str) -> DataFrame:
    """Rows that are marked as downloaded and have a path."""
    return rows.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) & F.col(path).isNotNull())


def annotated_assets(listing: DataFrame) -> DataFrame:
    """(img_id, idx, path): the newest run's annotated picture of an image (idx null) and of each of its persons.

    Names are ``<img>_annotated.jpg`` and ``<img>_person_<idx>[_track_<track>]_annotated.jpg`` in a folder under
    ``runs/<run>``; of a person's files in a run those with a track come first, then by name.
    """
    path = F.col("path")
    name = file_name(path)
    person = F.nullif(F.regexp_extract(name, r"^(.*)_person_(\d+)(_track_.*)?_annotated\.jpg$", 2), F.lit("")).cast("int")
    rows = listing.select(path, F.regexp_extract(path, r"runs/([^/]+)/", 1).alias("run"), person.alias("idx"), name.alias("name")).where(F.col("name").endswith("_annotated.jpg"))
    rows = rows.withColumn("img_id", F.when(F.col("idx").isNull(), F.regexp_extract("name", r"^(.*)_annotated\.jpg$", 1)).otherwise(F.regexp_extract("name", r"^(.*)_person_\d+(_track_.*)?_annotated\.jpg$", 1)))
    tracked = F.col("name").contains("_track_").cast("int")
    newest = rows.groupBy("img_id", "idx").agg(F.max("run").alias("run"))
    of_run = rows.join(newest.withColumnsRenamed({"img_id": "__i", "idx": "__x", "run": "__r"}), (F.col("img_id") == F.col("__i")) & F.col("idx").eqNullSafe(F.col("__x")) & (F.col("run") == F.col("__r")))
    return of_run.groupBy("img_id", "idx").agg(F.min_by("path", F.struct(-tracked, "path")).alias("path"))


def probe_durations(rows: DataFrame, header) -> DataFrame:
    """(media_id, duration_s) by ``header(path) -> (frames, fps) | None``, null where that fails or is not positive."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf.path:
                got = header(path)
                seconds = got[0] / (got[1] or 30.0) if got else None
                out.append(round(seconds, 6) if seconds and seconds > 0 else None)
            yield pd.DataFrame({"media_id": pdf.media_id, "duration_s": pd.Series(out, dtype="float64")})

    return rows.select("media_id", "path").mapInPandas(probe, "media_id string, duration_s double")


def refresh_durations(cache: DataFrame, media: DataFrame, header=None) -> DataFrame:
    """The cache with the missing media probed, by id: by ``header(path)``, or else by the containers' own headers.

    Only missing files are opened. Their paths are listed on the driver, as Spark lists the files of any source.
    """
    missing = media.join(cache.select("media_id"), "media_id", "left_anti")
    if header is not None:
        fresh = probe_durations(missing, header)
    else:
        paths = [r[0] for r in missing.select("path").distinct().toLocalIterator()]
        if not paths:
            return cache.select("media_id", "duration_s").orderBy("media_id")
        files = cache.sparkSession.read.format("binaryFile").load(paths).select(F.col("path").alias("__at"), "content")
        plain = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "/+", "/")
        named = missing.select("media_id", plain.alias("__name"))
        files = files.withColumn("__name", F.regexp_replace(F.regexp_replace("__at", "^file:/*", "/"), "/+", "/"))
        fresh = probe_contents(files.join(named, "__name"))
    return cache.select("media_id", "duration_s").unionByName(fresh.where("duration_s IS NOT NULL")).orderBy("media_id")


def long_last(df: DataFrame, duration: str, order: str, limit: float = 60.0) -> list[Column]:
    """Ordering: short media in their order, then long ones by duration."""
    late = F.coalesce(F.col(duration) >= limit, F.lit(False))
    return [late, F.when(late, F.col(duration)), F.col(order)]
