"""Headers of media containers: durations, frame counts and frame rates from the bytes, without a codec.

Three families of containers are walked: boxes (MP4, MOV), RIFF chunks (AVI) and EBML elements (Matroska, WebM).
Only headers are read and payloads are skipped by their sizes, so the work on a file grows with its number of boxes, not with its bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "container string, frames long, fps double, width int, height int, duration_s double"
#: Boxes that hold boxes, and the Matroska elements on the way to what is read.
PARENTS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl"))
SEGMENT, INFO, TRACKS, TRACK, VIDEO, CLUSTER = 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0x1F43B675
SCALE, DURATION, TRACK_TYPE, FRAME_NS, PIXEL_WIDTH, PIXEL_HEIGHT = 0x2AD7B1, 0x4489, 0x83, 0x23E383, 0xB0, 0xBA
EBML, RIFF = b"\x1a\x45\xdf\xa3", b"RIFF"
DEPTH = 12


@dataclass
class Header:
    """What a file says of its video; ``seconds`` of a container that has no frame count."""

    container: str
    frames: int | None = None
    fps: float | None = None
    width: int | None = None
    height: int | None = None
    seconds: float | None = None

    @property
    def duration(self) -> float | None:
        """frames / fps where both are known and positive, else the container's own duration; null where that is not positive."""
        if self.frames and self.fps and self.frames > 0 and self.fps > 0:
            return self.frames / self.fps
        return self.seconds if self.seconds and self.seconds > 0 else None


def boxes(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, end, depth) of every box's payload, parents before what they hold. A size of 1 stands for 64 bits, one of 0 for the rest."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        stop = end if size == 0 else at + size
        if size != 0 and size < head:
            return
        yield kind, at + head, min(stop, end), depth
        if kind in PARENTS and depth < DEPTH:
            yield from boxes(data, at + head, min(stop, end), depth + 1)
        at = stop


def _mp4(data: memoryview) -> Header:
    """The first video track: samples of its time-to-sample table over its own clock."""
    head, track = Header("mp4"), {}

    def take() -> bool:
        if track.get("video") and track.get("scale"):
            ticks, scale = track.get("ticks", 0), track["scale"]
            head.frames, head.width, head.height = track.get("samples"), track.get("width"), track.get("height")
            if ticks:
                head.seconds = ticks / scale
                head.fps = head.frames * scale / ticks if head.frames else None
            return True
        return False

    movie: float | None = None
    for kind, a, b, _ in boxes(data, 0, len(data)):
        wide = a < b and data[a] == 1
        if kind == b"mvhd" and b - a >= (32 if wide else 20):
            scale, ticks = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            movie = ticks / scale if scale else None
        elif kind == b"trak":
            if take():
                break
            track = {}
        elif kind == b"tkhd" and b - a >= (96 if wide else 84):
            w, h = struct.unpack_from(">II", data, b - 8)
            track |= {"width": w >> 16, "height": h >> 16}
        elif kind == b"mdhd" and b - a >= (32 if wide else 20):
            track["scale"], track["ticks"] = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif kind == b"hdlr" and b - a >= 12:
            track["video"] = bytes(data[a + 8 : a + 12]) == b"vide"
        elif kind == b"stts" and b - a >= 8:
            n = min(struct.unpack_from(">I", data, a + 4)[0], (b - a - 8) // 8)
            track["samples"] = sum(struct.unpack_from(f">{2 * n}I", data, a + 8)[::2])
    take()
    if head.seconds is None:
        head.seconds = movie
    return head


def _avi(data: memoryview) -> Header:
    """The main header, and the rate of the first video stream where it has one."""
    head, lists = Header("avi"), [(12, len(data))]
    while lists:
        at, end = lists.pop()
        while at + 8 <= end:
            kind, size = struct.unpack_from("<4sI", data, at)
            a, b = at + 8, min(at + 8 + size, end)
            if kind == b"LIST":
                if bytes(data[a : a + 4]) in (b"hdrl", b"strl"):
                    lists.append((a + 4, b))
            elif kind == b"avih" and b - a >= 40:
                micros, total = struct.unpack_from("<I", data, a)[0], struct.unpack_from("<I", data, a + 16)[0]
                head.width, head.height = struct.unpack_from("<II", data, a + 32)
                head.frames = total
                head.fps = head.fps or (1e6 / micros if micros else None)
            elif kind == b"strh" and b - a >= 28 and bytes(data[a : a + 4]) == b"vids":
                scale, rate = struct.unpack_from("<II", data, a + 20)
                head.fps = rate / scale if scale and rate else head.fps
            at = a + size + (size & 1)
    return head


def _number(data: memoryview, at: int, end: int, keep_marker: bool) -> tuple[int, int] | None:
    """A variable-length number and where it ends; unknown sizes are -1."""
    if at >= end or data[at] == 0:
        return None
    length = 9 - data[at].bit_length()
    if at + length > end:
        return None
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << (7 * length)) - 1
    return (-1 if value == (1 << (7 * length)) - 1 else value), at + length


def _matroska(data: memoryview) -> Header:
    head, scale, ticks, track = Header("matroska"), 1_000_000, None, {}
    stack = [(0, len(data))]
    while stack:
        at, end = stack.pop()
        while True:
            found = _number(data, at, end, True)
            sized = found and _number(data, found[1], end, False)
            if not sized:
                break
            kind, (size, a) = found[0], sized
            b = end if size < 0 else min(a + size, end)
            if kind in (SEGMENT, INFO, TRACKS, TRACK, VIDEO):
                if kind == TRACK:
                    track = {}
                stack.append((b, end))
                at, end = a, b
                continue
            raw = bytes(data[a:b]) if b - a <= 8 else b""
            number = int.from_bytes(raw, "big") if raw else 0
            if kind == SCALE:
                scale = number
            elif kind == DURATION and len(raw) in (4, 8):
                ticks = struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0]
            elif kind in (TRACK_TYPE, FRAME_NS, PIXEL_WIDTH, PIXEL_HEIGHT):
                track[kind] = number
                if track.get(TRACK_TYPE) == 1:
                    head.width, head.height = track.get(PIXEL_WIDTH, head.width), track.get(PIXEL_HEIGHT, head.height)
                    head.fps = 1e9 / track[FRAME_NS] if track.get(FRAME_NS) else head.fps
            if kind == CLUSTER and size < 0:
                break
            at = b
    if ticks is not None:
        head.seconds = ticks * scale / 1e9
        if head.fps:
            head.frames = round(head.seconds * head.fps)
    return head


def read_header(content: bytes | None) -> Header | None:
    """The header of a file's bytes; null for other formats and broken files."""
    if not content or len(content) < 12:
        return None
    data = memoryview(content)
    try:
        if content[:4] == EBML:
            return _matroska(data)
        if content[:4] == RIFF and content[8:12] == b"AVI ":
            return _avi(data)
        if content[4:8] in (b"ftyp", b"moov", b"free", b"skip", b"wide", b"mdat"):
            return _mp4(data)
    except (struct.error, OverflowError, ValueError, ZeroDivisionError):
        return None
    return None


def _headers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [x.split()[0] for x in HEADER.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
    for contents in batches:
        found = [read_header(c.as_buffer().to_pybytes() if c.is_valid else None) for c in contents]
        rows = [(h.container, h.frames, h.fps, h.width, h.height, h.duration) if h else (None,) * 6 for h in found]
        yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def header_of(content: Column) -> Column:
    """Struct of ``container``, ``frames``, ``fps``, ``width``, ``height`` and ``duration_s`` of a file's bytes; each is null where the file does not say it."""
    return F.arrow_udf(_headers, HEADER)(content)


def probe_contents(files: DataFrame, content: str = "content", ident: str = "media_id") -> DataFrame:
    """(media_id, duration_s) of files whose bytes are given, as ``binaryFile`` reads them; durations to six places, null where unknown."""
    return files.select(F.col(ident).cast("string").alias("media_id"), F.round(header_of(F.col(content))["duration_s"], 6).alias("duration_s"))
