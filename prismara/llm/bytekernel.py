"""Vectorised word and shingle hashing over the bytes of Arrow string columns.

The contracts' word classes can be told from single UTF-8 bytes (every byte of a non-ASCII
character is at least 0x80), so words are runs in the byte buffer and are hashed without decoding:
prefix sums of ``random[byte] * P^i`` modulo 2^64, shifted back by the inverse power and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
P, Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, P, dtype=np.uint64), np.full(size, pow(P, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > SLICE_BYTES + 1:
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """uint8[256]: 0 for separators, else the byte, A-Z lower-cased where asked for. Byte 0 must be a separator or stands as 0xFF, which UTF-8 never has."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 0xFF
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


#: Words as runs of anything but space, \t \n \v \f \r.
SPACED = byte_table(b" \t\n\v\f\r", lower=True)
#: Words as runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters.
ALNUM = byte_table(bytes([*range(0, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


class Words:
    """The words of a few documents: ``start``/``end`` byte offsets, ``hash``, and ``offs``, the word range of each document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        kind = table[data]
        inside = kind != 0
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        first = offs[:-1][offs[:-1] < len(data)]
        fresh[first] = inside[first]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        final = offs[1:][offs[1:] > 0] - 1
        last[final] = inside[final]
        self.data, self.start, self.end = kind, np.flatnonzero(fresh), np.flatnonzero(last) + 1
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_RANDOM[kind] * up[:-1], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _U(Q))
        self.offs = np.searchsorted(self.start, offs)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; those that run over the document's end are meaningless."""
        h = np.full(len(self.hash), k, dtype=np.uint64)
        for i in range(k):
            h = h * _U(P)
            h[: len(h) - i] += self.hash[i:]
        return mix(h)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(off, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``limit`` text bytes (one document at least), with their bytes and offsets."""
    raw, offs = string_bytes(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
