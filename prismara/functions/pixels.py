"""Arithmetic on pixel arrays, vectorised over Arrow batches: the differences of neighbouring frames, sharpness and edges.

Pixels are bytes, row by row. Rows of one size are stacked, so a batch of frames is one array operation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of blue, green and red in a grey value, in 2^-14.
GREY = (1868, 9617, 4899)


def grey(bgr: np.ndarray) -> np.ndarray:
    """Grey values of (..., 3) bytes in the order blue, green, red."""
    return ((bgr.astype(np.int64) * np.array(GREY)).sum(axis=-1) + (1 << 13)) >> 14


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue (0 to 179), saturation and value (0 to 255) of (..., 3) bytes in the order blue, green, red."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    span = v - np.minimum(np.minimum(b, g), r)
    safe = np.where(span > 0, span, 1.0)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(span > 0, np.where(hue < 0, hue + 360, hue), 0.0)
    saturation = np.where(v > 0, span / np.where(v > 0, v, 1.0) * 255, 0.0)
    return np.stack([np.rint(hue / 2) % 180, np.rint(saturation), v], axis=-1)


def laplacian_variance(image: np.ndarray) -> np.ndarray:
    """Variance of the 3x3 Laplacian of a stack of images (n, height, width); beyond a border stands its neighbour's mirror image."""
    x = np.pad(image.astype(np.float64), ((0, 0), *((1, 1) if s > 1 else (0, 0) for s in image.shape[1:])), mode="reflect")
    x = np.pad(x, ((0, 0), *((0, 0) if s > 1 else (1, 1) for s in image.shape[1:])), mode="edge")
    out = x[:, :-2, 1:-1] + x[:, 2:, 1:-1] + x[:, 1:-1, :-2] + x[:, 1:-1, 2:] - 4 * x[:, 1:-1, 1:-1]
    return out.reshape(len(out), -1).var(axis=1)


def _by_size(rows: list[tuple[bytes | None, ...]], sizes: list[tuple | None], work: Callable[[list[np.ndarray], tuple], np.ndarray]) -> pa.Array:
    """``work`` on the stacked rows of each size; rows without one give null."""
    groups: dict[tuple, list[int]] = {}
    for i, size in enumerate(sizes):
        if size is not None:
            groups.setdefault(size, []).append(i)
    out: list[float | None] = [None] * len(rows)
    for size, members in groups.items():
        stacks = [np.frombuffer(b"".join(rows[i][k] for i in members), np.uint8).reshape(len(members), -1) for k in range(len(rows[0]))]
        for i, value in zip(members, work(stacks, size), strict=True):
            out[i] = float(value)
    return pa.array(out, pa.float64())


def sharpness(pixels: Column, width: Column, height: Column, channels: int = 1) -> Column:
    """Focus of a crop: the variance of its grey values' Laplacian. Null, empty and crops whose bytes do not fit their size: 0."""

    def run(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        def work(stacks: list[np.ndarray], size: tuple) -> np.ndarray:
            image = stacks[0].reshape(-1, size[1], size[0], channels)
            return laplacian_variance(grey(image) if channels == 3 else image[..., 0])

        rows = list(zip(pixels.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True))
        sizes = [(x, y) if d and x and y and x > 0 and y > 0 and x * y * channels == len(d) else None for d, x, y in rows]
        return _by_size([(d,) for d, _, _ in rows], sizes, work).fill_null(0.0)

    return F.arrow_udf(run, "double")(pixels.cast("binary"), width.cast("int"), height.cast("int"))


def content_difference(now: Column, before: Column, kind: str = "hsv") -> Column:
    """Mean over the three channels of the mean absolute difference of two frames' hue, saturation and value; frames as interleaved
    ``hsv`` or ``bgr`` bytes. Null where one is missing or the sizes differ."""

    def run(now: pa.Array, before: pa.Array) -> pa.Array:
        def work(stacks: list[np.ndarray], size: tuple) -> np.ndarray:
            a, b = (s.reshape(len(s), -1, 3) for s in stacks)
            if kind == "bgr":
                a, b = hsv(a), hsv(b)
            return np.abs(a.astype(np.float64) - b.astype(np.float64)).mean(axis=(1, 2))

        rows = list(zip(now.to_pylist(), before.to_pylist(), strict=True))
        return _by_size(rows, [(len(a),) if a and b and len(a) == len(b) and len(a) % 3 == 0 else None for a, b in rows], work)

    return F.arrow_udf(run, "double")(now.cast("binary"), before.cast("binary"))


def edge_points(pixels: Column, width: Column, height: Column, least: int = 100) -> Column:
    """Array of (x, y) of a grey picture's places where the brightness changes by ``least`` or more, sums of both directions' central differences."""

    def run(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for data, w, h in zip(pixels.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
            if not data or not w or not h or w * h != len(data):
                out.append([])
                continue
            x = np.pad(np.frombuffer(data, np.uint8).reshape(h, w).astype(np.int64), 1, mode="edge")
            change = np.abs(x[1:-1, 2:] - x[1:-1, :-2]) + np.abs(x[2:, 1:-1] - x[:-2, 1:-1])
            rows, columns = np.nonzero(change >= least)
            out.append([{"x": int(a), "y": int(b)} for a, b in zip(columns, rows, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))

    return F.arrow_udf(run, "array<struct<x:int,y:int>>")(pixels.cast("binary"), width.cast("int"), height.cast("int"))


def side_means(pixels: Column, width: Column, height: Column) -> Column:
    """Struct of the mean brightness of each column (``across``) and row (``down``) of a grey picture; null where bytes and size do not fit."""

    def run(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for data, w, h in zip(pixels.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
            fits = bool(data and w and h and w * h == len(data))
            x = np.frombuffer(data, np.uint8).reshape(h, w).astype(np.float64) if fits else None
            out.append({"across": x.mean(axis=0).tolist(), "down": x.mean(axis=1).tolist()} if fits else None)
        side = pa.list_(pa.float64())
        return pa.array(out, pa.struct([("across", side), ("down", side)]))

    return F.arrow_udf(run, "across array<double>, down array<double>")(pixels.cast("binary"), width.cast("int"), height.cast("int"))
