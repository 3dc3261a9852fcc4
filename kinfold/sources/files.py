"""Uploaded files: what isn't text is named and refused, the rest is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def binary_kind(name: Column, content: Column) -> Column:
    """What a binary file is, by its first bytes or a NUL in its first 4,096; null for text and for workbooks."""
    head = F.hex(F.substring(content, 1, 8))
    workbook = F.lower(name).rlike(r"\.(xlsx|xlsm|xltx|xls)$") & (head.startswith("504B0304") | head.startswith("D0CF11E0"))
    kind = F.when(workbook, F.lit(None).cast("string"))
    for signature, label in C.BINARY_SIGNATURES:
        kind = kind.when(head.startswith(signature), label)
    nul = F.decode(F.substring(content, 1, 4096), "ISO-8859-1").contains(F.lit("\0"))
    return kind.when(nul, "a binary file")


def windows(latin: Column) -> Column:
    """Latin-1 text as windows-1252 has its bytes; as it is where it holds a byte that has no character there."""
    high = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    free = "".join(c for c, real in high if not real)
    table = [x for x in high if x[1]]
    return F.when(latin.rlike(f"[{free}]"), latin).otherwise(F.translate(latin, "".join(c for c, _ in table), "".join(real for _, real in table)))


def decode(content: Column) -> Column:
    """UTF-8 without its byte order mark where the bytes are that; else windows-1252, else Latin-1."""
    body = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    return F.when(F.is_valid_utf8(body.cast("string")), F.decode(body, "UTF-8")).otherwise(windows(F.decode(content, "ISO-8859-1")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, refused (why, or null), text (null where refused) of the files at a path; Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    refused = binary_kind(name, F.col("content"))
    return files.select(name.alias("file"), refused.alias("refused"), F.when(refused.isNull(), decode(F.col("content"))).alias("text"))
