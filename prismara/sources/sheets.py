"""Sheets of workbooks, read without a library: an .xlsx file is a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
BATCH_ROWS = 5_000
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    """0 for A, 26 for AA."""
    out = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def _texts(node: ElementTree.Element) -> str:
    raw = "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), raw)


def _links(z: zipfile.ZipFile, sheet: str | None, continued: bool) -> list[str]:
    """Parts of the named sheet, or the first; ``continued``: and of those that go on with it, called ``name (2)`` and so forth."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    entries = [(e.get("name"), links[e.get(_RELATION)]) for e in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)]
    named = dict(reversed(entries))
    first = entries[0][0] if sheet is None else sheet
    wanted = [named[first]]
    while continued and (more := named.get(f"{first} ({len(wanted) + 1})")):
        wanted.append(more)
    return [p if p.startswith("xl/") else f"xl/{p}" for p in wanted]


def stream_rows(file, sheet: str | None = None, continued: bool = False) -> Iterator[list[str | None]]:
    """Cells of the named sheet, or the first, as texts, a row at a time; the parts that go on with it without their headers."""
    m = f"{{{_NS['m']}}}"
    with zipfile.ZipFile(file) as z:
        shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in z.namelist() else []
        for k, part in enumerate(_links(z, sheet, continued)):
            with z.open(part) as xml:
                data, header = None, k > 0
                for event, node in ElementTree.iterparse(xml, events=("start", "end")):
                    if event == "start" and node.tag == f"{m}sheetData":
                        data = node
                    elif event == "end" and node.tag == f"{m}row" and data is not None:
                        cells: list[str | None] = []
                        for c in node.findall(f"{m}c"):
                            at = _column(c.get("r", "")) if c.get("r") else len(cells)
                            cells += [None] * (at + 1 - len(cells))
                            value = c.findtext(f"{m}v")
                            cells[at] = _texts(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
                        data.clear()  # else every row stays
                        if not header:
                            yield cells
                        header = False


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of the named sheet, or the first, as texts."""
    return list(stream_rows(io.BytesIO(content), sheet))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, continued: bool = False) -> DataFrame:
    """All-string rows of a sheet, its first row the header; ``continued``: with the sheets ``name (2)`` and so forth, into which the writer parts what is too long.

    A workbook is one task, which holds the packed file and some rows at a time; several files are read in parallel.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, place = stream_rows(pa.BufferReader(content.as_buffer()), sheet, continued), 0
                while some := list(islice(found, BATCH_ROWS)):
                    places = pa.array(range(place, place + len(some)), pa.int64())
                    yield pa.RecordBatch.from_arrays([places, pa.array(some, pa.list_(pa.string()))], ["place", "cells"])
                    place += len(some)

    cells = files.mapInArrow(rows, "place long, cells array<string>")
    header = cells.where("place = 0").select("cells").first()
    names = [n or f"_c{i}" for i, n in enumerate(header[0] if header else [])]
    return cells.where("place > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
