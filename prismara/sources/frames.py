"""Uncompressed videos (YUV4MPEG2) as a data source: a row a frame, a partition a range of frames.

All frames of such a file have one length, so a range is found by its place in the file. Filters on ``frame`` and ``media`` decide which
ranges and files are read at all.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .workbook import local_path

SCHEMA = "media string, frame long, fps double, width int, height int, pixels binary"
#: Bytes of all planes to those of the brightness, by the colour mode.
PLANES = {"mono": (1, 1), "420": (3, 2), "411": (3, 2), "422": (2, 1), "444": (3, 1)}
BATCH = 64


@dataclass
class Video:
    width: int
    height: int
    fps: float | None
    start: int
    planes: int
    frames: int

    @property
    def step(self) -> int:
        return self.planes + 6  # before each frame stands its mark of six bytes


def probe(path: str) -> Video | None:
    """The header of a file; null for files of another kind and with parameters at their frames."""
    with open(path, "rb") as f:
        line = f.readline(4096)
        if not line.startswith(b"YUV4MPEG2 ") or not line.endswith(b"\n") or f.read(6) not in (b"FRAME\n", b""):
            return None
    fields = {x[:1]: x[1:] for x in line.decode("ascii", "replace").split()[1:]}
    mode = re.match(r"mono|\d+", fields.get("C", "420"))
    if not {"W", "H"} <= fields.keys() or mode is None or mode[0] not in PLANES or "p1" in fields.get("C", ""):
        return None
    width, height = int(fields["W"]), int(fields["H"])
    many, of = PLANES[mode[0]]
    if mode[0] == "420":
        planes = width * height + 2 * ((width + 1) // 2) * ((height + 1) // 2)
    else:
        planes = width * height * many // of
    rate = re.fullmatch(r"(\d+):(\d+)", fields.get("F", ""))
    fps = int(rate[1]) / int(rate[2]) if rate and int(rate[2]) else None
    return Video(width, height, fps, len(line), planes, (os.path.getsize(path) - len(line)) // (planes + 6))


@dataclass
class Range(InputPartition):
    path: str
    media: str
    first: int
    end: int


class FrameSource(DataSource):
    """``spark.read.format("frames").option("frames_per_partition", n).load(path or pattern)``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(local_path(self.options["path"]), int(self.options.get("frames_per_partition", 256)))


class FrameReader(DataSourceReader):
    def __init__(self, pattern: str, step: int):
        self.pattern, self.step = pattern, step
        self.low, self.end, self.media = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Narrows the ranges; every filter is given back, as Spark applies it to what is read."""
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if column == ("media",) and isinstance(f, EqualTo | In):
                wanted = set(value) if isinstance(f, In) else {value}
                self.media = wanted if self.media is None else self.media & wanted
            elif column == ("frame",):
                if isinstance(f, EqualTo):
                    self._within(value, value + 1)
                elif isinstance(f, In):
                    known = [v for v in value if v is not None]
                    self._within(min(known, default=0), max(known, default=-1) + 1)
                elif isinstance(f, GreaterThan):
                    self._within(value + 1, None)
                elif isinstance(f, GreaterThanOrEqual):
                    self._within(value, None)
                elif isinstance(f, LessThan):
                    self._within(0, value)
                elif isinstance(f, LessThanOrEqual):
                    self._within(0, value + 1)
            yield f

    def _within(self, low: int, end: int | None) -> None:
        self.low = max(self.low, low)
        self.end = end if self.end is None else self.end if end is None else min(self.end, end)

    def partitions(self) -> list[Range]:
        paths = sorted(glob.glob(os.path.join(self.pattern, "*.y4m") if os.path.isdir(self.pattern) else self.pattern))
        out = []
        for path in paths:
            media = os.path.splitext(os.path.basename(path))[0]
            if self.media is not None and media not in self.media:
                continue
            video = probe(path)
            if video is None:
                continue
            end = video.frames if self.end is None else min(self.end, video.frames)
            first = self.low // self.step * self.step
            out += [Range(path, media, max(a, self.low), min(a + self.step, end)) for a in range(first, end, self.step)]
        return out or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        video = probe(partition.path) if partition.first < partition.end else None
        if video is None:
            return
        size = video.width * video.height
        with open(partition.path, "rb") as f:
            for at in range(partition.first, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                f.seek(video.start + at * video.step)
                raw = f.read(n * video.step)
                pixels = [raw[k * video.step + 6 : k * video.step + 6 + size] for k in range(n)]
                columns = [pa.array([partition.media] * n), pa.array(range(at, at + n), pa.int64()), pa.array([video.fps] * n, pa.float64()), pa.array([video.width] * n, pa.int32()), pa.array([video.height] * n, pa.int32()), pa.array(pixels, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)


def read_frames(spark: SparkSession, path: str, frames_per_partition: int = 256) -> DataFrame:
    """Frames of a file, a folder or a pattern: media (the file's name), number, rate, size and brightness bytes.

    Filters reach a Python source only where the session allows it, so this sets ``spark.sql.python.filterPushdown.enabled``.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").option("frames_per_partition", frames_per_partition).load(path)
