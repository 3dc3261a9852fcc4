"""Tables out of delimited text files: header and separator found, roles inferred, files united.

Only the first 64 KB of a file reach the driver, to find its separator and the
line of its header; rows are read and split on executors, also those of a file
whose cells hold line breaks.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from . import files, records, roles, workbook

HEAD_BYTES = 1 << 16
SEPARATORS = (",", "\t", ";", "|")
CANONICAL = ("row_id", "description", "cpse", "code", "price", "uom", "label", "source_file")


class TableError(Exception):
    """A file that holds no usable table, with a reason to show."""


@dataclass(frozen=True)
class Layout:
    """Where a file's header is, what separates its cells, how it is encoded, and its column names."""

    skip: int
    separator: str
    encoding: str
    columns: tuple[str, ...]


def unique_names(cells: list[str]) -> tuple[str, ...]:
    """Column names: empty ones by position, repeated ones numbered."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = cell.strip() or f"Unnamed: {i}"
        tries, stem = 0, name
        while name in out:
            tries += 1
            name = f"{stem}.{tries}"
        out.append(name)
    return tuple(out)


def find_layout(lines: list[str], encoding: str = "UTF-8") -> Layout:
    """The first line, of twenty, that reads as a header with a known description; else the first with two cells and a row below."""
    fallback = None
    for skip, line in enumerate(lines[: C.MAX_HEADER_SCAN]):
        below = next((x for x in lines[skip + 1 :] if x.strip()), None)
        if below is None or not line.strip():
            continue
        other = max(SEPARATORS[1:], key=line.count)
        for separator in (",", other):
            columns = unique_names(next(csv.reader([line], delimiter=separator)))
            if len(columns) < C.MIN_TABLE_COLUMNS:
                continue
            layout = Layout(skip, separator, encoding, columns)
            if roles.named(list(columns), "description"):
                return layout
            fallback = fallback or layout
    if fallback is None:
        raise TableError("no header row with two columns or more")
    return fallback


def probe(spark: SparkSession, path: str) -> Layout:
    """The layout of the file at ``path``."""
    content = F.substring("content", 1, HEAD_BYTES)
    name = F.element_at(F.split("path", "/"), -1)
    # A head cut inside a character is still UTF-8 if it is without its last line.
    whole = F.when(F.length("content") > HEAD_BYTES, F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[^\n]*$", "")).otherwise(F.decode(content, "ISO-8859-1"))
    head = F.encode(whole, "ISO-8859-1")
    found = spark.read.format("binaryFile").load(path).select(files.binary_kind(name, F.col("content")).alias("refused"), files.decode(head).alias("text"), F.is_valid_utf8(head.cast("string")).alias("utf8")).first()
    if found is None or not (found["refused"] or (found["text"] or "").strip()):
        raise TableError("the file is empty")
    if found["refused"]:
        raise TableError(f"it looks like {found['refused']}")
    return find_layout(found["text"].splitlines(), "UTF-8" if found["utf8"] else "windows-1252")


def read_table(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """All cells as text, empty ones null, with ``_row``, which follows the order of the file.

    A file's first split, and no other, holds the lines down to the header;
    they are told by their place in it, and hold no line breaks themselves.
    Rows with too many cells are left out, short ones filled with nulls.  In a
    file that has a line with an odd number of quotes a cell may hold a line
    break; its lines are joined to records first.
    """
    layout = layout or probe(spark, path)
    lines = spark.read.text(path)  # keeps the bytes of a line as they are
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    broken = not lines.filter(quotes % 2 == 1).isEmpty()
    if layout.encoding != "UTF-8":
        lines = lines.withColumn("value", files.windows(F.decode(F.col("value").cast("binary"), "ISO-8859-1")))
    place = F.monotonically_increasing_id()
    lines = lines.select("value", place.alias("_row"), F.col("_metadata.file_block_start").alias("_from"))
    rows = lines.filter((F.col("_from") > 0) | (F.col("_row").bitwiseAND((1 << 33) - 1) > layout.skip))
    rows = (records.records(rows, layout.separator) if broken else rows).filter(F.trim("value") != "")
    fields = [f"c{i}" for i in range(len(layout.columns))]
    schema = ", ".join(f"{f} string" for f in (*fields, "_extra"))
    cells = F.from_csv(F.regexp_replace("value", "\r$", ""), schema, {"sep": layout.separator, "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "", "escape": '"'})
    split = rows.select("_row", cells.alias("c")).filter("c._extra IS NULL")
    empty = lambda c: F.when(F.col(f"c.{c}") != "", F.col(f"c.{c}"))
    return split.select("_row", *[empty(f).alias(n) for f, n in zip(fields, layout.columns)])


def canonical(table: DataFrame, stem: str) -> tuple[DataFrame, dict[str, roles.Choice]]:
    """A table in the engine's columns, and the column chosen for each role."""
    given = table.drop("_row")
    chosen = roles.infer(roles.profiles(given))
    if "description" not in chosen:
        raise TableError(f"no column of descriptions among {', '.join(given.columns)}")
    cell = lambda role: F.col(f"`{chosen[role].column}`")

    def kept(role: str, make, absent: Column) -> Column:
        return make(cell(role)) if role in chosen else absent

    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    row = F.col("_row") if "_row" in table.columns else F.monotonically_increasing_id()
    return table.select(
        row.alias("row_id"), cell("description").alias("description"), kept("unit", T.clean_unit, F.lit(stem)).alias("cpse"), kept("code", text, F.lit("")).alias("code"),
        kept("price", T.parse_price, F.lit(None).cast("double")).alias("price"), kept("measure", lambda c: T.uom(c)["canonical"], F.lit(C.UNSPECIFIED)).alias("uom"),
        kept("label", text, F.lit("")).alias("label"), F.lit(stem).alias("source_file"),
    ), chosen


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A workbook or a delimited file."""
    if not path.lower().endswith((".xlsx", ".xlsm")):
        return read_table(spark, path)
    try:
        return workbook.read_workbook(spark, path)
    except (ValueError, PythonException) as problem:
        raise TableError("its first sheet can't be read: " + str(problem).strip().splitlines()[-1]) from None


def fit(table: DataFrame) -> DataFrame:
    """``table``, or an error if nothing of it is left to unify."""
    if table.isEmpty():
        raise TableError("every row was blank, a duplicate or a placeholder")
    return table


def read_tables(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """All usable files as one table, and a note for each file left out.

    ``row_id`` follows the order of the files and of the rows in each.
    """
    frames, notes = [], []
    for i, path in enumerate(paths):
        name = path.rsplit("/", 1)[-1]
        try:
            table, _ = canonical(read_any(spark, path), name.rsplit(".", 1)[0])
        except TableError as reason:
            notes.append(f"{name} was skipped: {reason}")
            continue
        frames.append(table.withColumn("row_id", F.col("row_id") + F.lit(i << 48)))
    if not frames:
        raise TableError("no usable file; " + "; ".join(notes))
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame)
    return united, notes


def clean(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit to be unified, with ``text``; and one row of counts of what went: blank, duplicate, junk.

    Of rows equal in everything but ``row_id`` the first stays.
    """
    keys = [c for c in table.columns if c != "row_id"]
    told = table.groupBy(*keys).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies"))
    blank, junk = F.col("description").isNull(), T.is_junk(F.col("description"))
    counts = told.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum(F.when(blank, F.col("copies"))), F.lit(0)).alias("rows_blank"),
        F.coalesce(F.sum(F.when(~blank, F.col("copies") - 1)), F.lit(0)).alias("rows_duplicate"), F.count_if(~blank & junk).alias("rows_junk"), F.count_if(~blank & ~junk).alias("records"),
    )
    return told.filter(~blank & ~junk).select(*table.columns, T.normalize(F.col("description")).alias("text")), counts
