"""Workbooks (.xlsx, .xlsm): the first sheet as a table, through a Python data source whose partitions are ranges of rows.

A range's reader unpacks the sheet up to its rows without parsing what comes
before.  Shared strings and styles are read once by a worker process, and kept
for the file's other ranges.  Numbers shown as dates are dates, as text; other
values are taken as stored.

Files are opened through Arrow's file systems.  Where those can't reach a path,
Spark reads the file and one task takes all its rows.  The older binary .xls
can't be read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import constants as C
from . import roles

#: Rows of a range, and bytes of a sheet unpacked at once.
RANGE_ROWS, CHUNK = 50_000, 1 << 20
# The name spaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = "_row long, cells array<string>"


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The path of the first sheet in the archive."""
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == sheet.get(LINK):
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise KeyError("the first sheet is not in the file")


def _said(node: ElementTree.Element) -> str:
    """All text runs of a string, phonetic readings left out."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t") if part.tag == f"{MAIN}r" else []))


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


# Number formats of dates and times that have a number and no code in the file.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ROW = re.compile(rb'<(?:\w+:)?row\b[^>]*?\br="(\d+)"')
_DATA = re.compile(rb"<(?:\w+:)?sheetData\b[^>]*>")


def _is_date(code: str) -> bool:
    """Whether a number format shows days or times: a letter of them outside quotes, brackets and escapes."""
    plain = re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.|\*.', "", code.lower()).split(";")[0]
    return plain != "general" and bool(re.search(r"[dmyhs]", plain))


def date_of(serial: float, since_1904: bool = False) -> str | None:
    """A serial number as the date, or the time of day if it is below one, that it stands for; None beyond what dates can be."""
    if not 0 <= serial < 2_958_466:
        return None
    days, seconds = divmod(round(serial * 86_400), 86_400)
    if days == 0 and not since_1904:
        return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    # Day 60 of the calendar from 1900 is one that never was.
    first = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    return str(first + timedelta(days=days, seconds=seconds))


class Book:
    """An open workbook."""

    def __init__(self, file):
        self.archive = zipfile.ZipFile(file)
        names, self.shared, self.dates = set(self.archive.namelist()), [], set()
        self.sheet = _first_sheet(self.archive)
        properties = ElementTree.fromstring(self.archive.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
        self.since_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        if "xl/sharedStrings.xml" in names:
            self.shared = [_said(item) for item in ElementTree.fromstring(self.archive.read("xl/sharedStrings.xml"))]
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.archive.read("xl/styles.xml"))
            codes = {f.get("numFmtId"): f.get("formatCode") or "" for f in styles.iter(f"{MAIN}numFmt")}
            kinds = [x.get("numFmtId") or "0" for x in styles.findall(f"{MAIN}cellXfs/{MAIN}xf")]
            self.dates = {str(i) for i, k in enumerate(kinds) if (_is_date(codes[k]) if k in codes else int(k) in DATE_FORMATS)}

    def last_row(self) -> int:
        """The number of the last row, as the sheet says before its rows; 0 if it doesn't."""
        with self.archive.open(self.sheet) as sheet:
            found = re.search(rb'<(?:\w+:)?dimension\b[^>]*\bref="[A-Z]+\d+:[A-Z]+(\d+)"', sheet.read(CHUNK))
        return int(found.group(1)) if found else 0

    def _text(self, cell: ElementTree.Element) -> str | None:
        value, kind = cell.find(f"{MAIN}v"), cell.get("t")
        text = value.text if value is not None else None
        if kind == "inlineStr":
            return _said(cell.find(f"{MAIN}is"))
        if text is None:
            return None
        if kind == "s":
            return self.shared[int(text)]
        if kind == "b":
            return "True" if text == "1" else "False"
        if kind in (None, "n") and cell.get("s") in self.dates:
            return date_of(float(text), self.since_1904) or text
        return text

    def rows(self, first: int = 1, last: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """Numbers and cells of the rows from ``first`` to ``last``, those left out of the file left out."""
        with self.archive.open(self.sheet) as sheet:
            held = b""
            while not (found := _DATA.search(held)):
                if not (more := sheet.read(CHUNK)):
                    return
                held += more
            parser = ElementTree.XMLPullParser(["end"])
            parser.feed(held[: found.end()])
            held = held[found.end() :]
            while first > 1:  # what comes before is not parsed
                start = next((m.start() for m in _ROW.finditer(held) if int(m.group(1)) >= first), None)
                if start is not None:
                    held = held[start:]
                    break
                more = sheet.read(CHUNK)
                if not more:
                    return
                held = held[held.rfind(b"<") :] + more
            done = first - 1
            while held:
                parser.feed(held)
                for _, row in parser.read_events():
                    if row.tag != f"{MAIN}row":
                        continue
                    done = int(row.get("r", done + 1))
                    if last is not None and done > last:
                        return
                    cells: list[str | None] = []
                    for cell in row.iter(f"{MAIN}c"):
                        at = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = self._text(cell) or None
                    yield done, cells
                    row.clear()
                held = sheet.read(CHUNK)


@lru_cache(maxsize=2)
def _opened(path: str, size: int, changed: str) -> Book:
    """The workbook at a path, kept by the worker for the ranges that follow; another size or time is another book."""
    system, name = fs.FileSystem.from_uri(path)
    return Book(system.open_input_file(name))


def open_book(path: str) -> Book:
    system, name = fs.FileSystem.from_uri(path)
    known = system.get_file_info(name)
    return _opened(path, known.size, str(known.mtime_ns))


class RowRange(InputPartition):
    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.most = options["path"], int(options.get("rows", RANGE_ROWS)), int(options.get("most", 0))

    def partitions(self) -> list[RowRange]:
        if self.most:
            return [RowRange(1, self.most)]
        starts = range(1, max(open_book(self.path).last_row(), 1) + 1, self.rows)
        # The last range has no end: what a sheet says of its size may be wrong.
        return [RowRange(a, a + self.rows - 1 if a + self.rows <= starts[-1] else None) for a in starts]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        for number, cells in open_book(self.path).rows(partition.first, partition.last):
            yield number - 1, cells


class SheetSource(DataSource):
    """``spark.read.format("first_sheet").load(path)``: _row (from 0) and cells of the first sheet; ``rows``: rows of a partition; ``most``: read no more."""

    @classmethod
    def name(cls) -> str:
        return "first_sheet"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options)


def header_of(rows: list[list[str | None]]) -> tuple[int, list[str]] | None:
    """The first row, of twenty, that names a description, else the first; its place and a name for each column."""
    width, fallback = max(map(len, rows), default=0), None
    if width < C.MIN_TABLE_COLUMNS:
        return None
    for skip, cells in enumerate(rows[:-1]):
        given = [*cells, *[None] * (width - len(cells))]
        names = [(c or "").strip() or f"col_{i}" for i, c in enumerate(given)]
        if roles.named(names, "description"):
            return skip, names
        fallback = fallback or (skip, names)
    return fallback


def _parsed(spark: SparkSession, path: str, most: int | None) -> DataFrame:
    try:
        fs.FileSystem.from_uri(path)
    except (OSError, ValueError, ImportError):
        return _by_spark(spark, path, most)
    spark.dataSource.register(SheetSource)
    reader = spark.read.format(SheetSource.name())
    return (reader.option("most", str(most)) if most else reader).load(path)


def _by_spark(spark: SparkSession, path: str, most: int | None) -> DataFrame:
    """The rows of a file that only Spark can reach."""

    def run(frames):
        for frame in frames:
            for raw in frame["content"]:
                some = []
                for number, cells in Book(io.BytesIO(bytes(raw))).rows(1, most):
                    some.append((number - 1, cells))
                    if len(some) == 1000:
                        yield pd.DataFrame(some, columns=["_row", "cells"])
                        some = []
                yield pd.DataFrame(some, columns=["_row", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _ROWS)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet's rows below its header, cells as text, with ``_row``; columns without any value are left out."""
    top = {r["_row"]: list(r["cells"]) for r in _parsed(spark, path, C.MAX_HEADER_SCAN + 1).collect()}  # twenty rows and one below
    found = header_of([top.get(i, []) for i in range(max(top, default=-1) + 1)])
    if found is None:
        raise ValueError("no header row with two columns or more")
    skip, names = found
    for i, name in enumerate(names):
        k, stem = 0, name
        while names[i] in names[:i]:
            k += 1
            names[i] = f"{stem}.{k}"
    rows = _parsed(spark, path, None).filter(F.col("_row") > skip)
    table = rows.select("_row", *[F.when(F.trim(F.get("cells", F.lit(i))) != "", F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)])
    filled = table.agg(*[F.count(F.col(f"`{n}`")).alias(str(i)) for i, n in enumerate(names)]).first()
    kept = [n for i, n in enumerate(names) if filled[i]]
    return table.select("_row", *[F.col(f"`{n}`") for n in kept]).dropna("all", subset=[f"`{n}`" for n in kept]) if kept else table.limit(0)
