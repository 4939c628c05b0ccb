"""Workbooks as a data source: tasks write rows of sheets as XML fragments, the commit joins them into an .xlsx file.

Fragments lie beside the target until the commit, which puts the finished file in its place in one step; an aborted write takes them away
and leaves the target as it was. Rows and cells need no numbers in this format, so no task has to know the others' counts.
The target is a path that driver and executors can open, such as a mounted shared folder.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: A sheet's greatest number of rows, its name's length and the characters that may not be in it.
MOST_ROWS, MOST_NAME, FORBIDDEN = 1_048_576, 31, re.compile(r"[\[\]:*?/\\]")
FRAGMENT_ROWS = 50_000
#: Characters that XML cannot hold, and texts that look like their replacement.
UNWRITABLE = re.compile("[\x00-\x08\x0b-\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


@dataclass
class Fragments(WriterCommitMessage):
    """Files of one task in their order, with their numbers of rows."""

    partition: int
    files: list[tuple[str, int]]


def local_path(path: str) -> str:
    """The path of a ``file:`` address; other stores cannot be opened here."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a workbook needs a path that can be opened, not {path}")
    return parts.path if parts.scheme else path


def cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def row(values: Sequence) -> str:
    return f"<row>{''.join(map(cell, values))}</row>"


class WorkbookSource(DataSource):
    """``df.write.format("workbook").option("sheet", name).mode("overwrite" or "append").save(path)``: one workbook of this sheet, or
    the sheet put into the workbook that is there. ``fallback``: where the file goes when the target cannot be replaced."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite)


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names, self.overwrite = schema.names, overwrite
        self.target, self.sheet = local_path(options["path"]), FORBIDDEN.sub("_", options.get("sheet", "Sheet1"))[: MOST_NAME - 5] or "Sheet1"
        self.fallback = options.get("fallback")
        self.stage = f"{self.target}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragments:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.stage, exist_ok=True)
        files: list[tuple[str, int]] = []
        out, rows = None, 0
        try:
            for batch in iterator:
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or rows >= FRAGMENT_ROWS:
                        if out is not None:
                            out.close()
                            files[-1] = (files[-1][0], rows)
                        files.append((f"{self.stage}/{context.partitionId():06d}-{context.taskAttemptId()}-{len(files):06d}.xml", 0))
                        out, rows = open(files[-1][0], "w", encoding="utf-8"), 0
                    out.write(row(values))
                    rows += 1
        finally:
            if out is not None:
                out.close()
                files[-1] = (files[-1][0], rows)
        return Fragments(context.partitionId(), files)

    def commit(self, messages: list[Fragments | None]) -> None:
        files = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for f in m.files]
        sheets: list[list[str]] = [[]]
        held = 1
        for path, rows in files:
            if held + rows > MOST_ROWS:
                sheets.append([])
                held = 1
            sheets[-1].append(path)
            held += rows
        made = f"{self.target}.made-{uuid.uuid4().hex}"
        try:
            self._join(made, {self.sheet + (f" ({k})" if k > 1 else ""): s for k, s in enumerate(sheets, 1)})
            try:
                os.replace(made, self.target)
            except OSError:
                if not self.fallback:
                    raise
                os.replace(made, local_path(self.fallback))
        finally:
            self._discard(made)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._discard(None)

    def _discard(self, made: str | None) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)
        if made and os.path.exists(made):
            os.remove(made)

    def _join(self, made: str, sheets: dict[str, list[str]]) -> None:
        kept: list[tuple[str, bytes]] = []
        if not self.overwrite and os.path.exists(self.target):
            kept = [(n, b) for n, b in sheet_parts(self.target) if n not in sheets]
        names = [n for n, _ in kept] + list(sheets)
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as book:
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
            defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            main = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{defaults}{main}{types}</Types>')
            book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            entries = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
            book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{entries}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
            book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
            for k, (_, content) in enumerate(kept, 1):
                book.writestr(f"xl/worksheets/sheet{k}.xml", content)
            for k, name in enumerate(sheets, len(kept) + 1):
                with book.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as part:
                    part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{row(self.names)}'.encode())
                    for path in sheets[name]:
                        with open(path, "rb") as fragment:
                            shutil.copyfileobj(fragment, part, 1 << 20)
                    part.write(b"</sheetData></worksheet>")


def sheet_parts(path: str) -> list[tuple[str, bytes]]:
    """Names and parts of a workbook's sheets, as far as they stand by themselves: with inline texts, as this source writes them."""
    from xml.etree import ElementTree

    with zipfile.ZipFile(path) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        if "xl/sharedStrings.xml" in book.namelist():
            raise ValueError(f"{path} was made elsewhere, with shared texts: a sheet cannot be added to it")
        entries = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{{{_MAIN}}}sheets/{{{_MAIN}}}sheet")
        return [(e.get("name"), book.read(f"xl/{links[e.get(f'{{{_REL}}}id')]}")) for e in entries]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def write_workbook(sheets: dict[str, DataFrame], path: str, fallback: str | None = None) -> None:
    """A workbook of these sheets in their order; rows keep the order of their frames."""
    mode = "overwrite"
    for name, df in sheets.items():
        register(df.sparkSession)
        writer = df.write.format("workbook").option("sheet", name).mode(mode)
        (writer.option("fallback", fallback) if fallback else writer).save(path)
        mode = "append"
