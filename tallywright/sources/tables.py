"""Reading survey files: CSV with guessed encoding and separator, workbooks, Parquet."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.profile import promoted
from tallywright.sources import spss, workbook

ENCODINGS = ("utf-8", "windows-1252", "ISO-8859-1")
SEPARATORS = (",", ";", "\t", "|")
#: Spark reads no windows-1252: its text is read as ISO-8859-1, whose control characters it uses for signs.
C1 = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0))


def sniff(head: bytes) -> tuple[str, str]:
    """Encoding and separator of a CSV from its first bytes; a header of one column asks for another separator."""
    encoding = "utf-8"
    for name, codec in zip(ENCODINGS, ("utf-8-sig", "cp1252", "latin-1")):
        try:
            text = head.decode(codec)
        except UnicodeDecodeError as e:
            if codec == "utf-8-sig" and e.start >= len(head) - 3:  # cut inside a character
                text = head[: e.start].decode(codec)
            else:
                continue
        encoding = name
        break
    line = text.lstrip("﻿").split("\n", 1)[0]
    return encoding, next((s for s in SEPARATORS if s in line), ",")


def read_csv(spark: SparkSession, path: str, promote: bool = True) -> DataFrame:
    """All columns as text first; only an empty cell is missing, so "NA" stays. Numbers are promoted if all are."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("h")).first()
    encoding, sep = sniff(bytes(head.h) if head else b"")
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1" if encoding == "windows-1252" else encoding).option("nullValue", "").option("multiLine", True).option("escape", '"').csv(path)
    if encoding == "windows-1252":
        df = df.select(*[F.translate(c, C1, WINDOWS).alias(c.translate(str.maketrans(C1, WINDOWS))) for c in df.columns])
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return promoted(df) if promote else df


def read_survey(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A survey table and what is known of it, by the file's ending: .csv, .xlsx, .sav or .parquet."""
    end = os.path.splitext(path)[1].lower()
    if end == ".csv":
        return read_csv(spark, path), {"format": "csv"}
    if end == ".xlsx":
        raw = bytes(spark.read.format("binaryFile").load(path).first().content)
        book = workbook.Workbook(raw)
        sheet, row, tabulated = workbook.find_table(book)
        if tabulated:
            return workbook.banner_sheet(spark, book, sheet, row), {"format": "xlsx", "sheet": sheet, "pretabulated": True}
        return promoted(workbook.sheet_frame(spark, book, sheet, row)), {"format": "xlsx", "sheet": sheet, "pretabulated": False}
    if end in (".sav", ".zsav"):
        return spss.read_sav(spark, path)
    if end == ".parquet" or not end:
        return spark.read.parquet(path), {"format": "parquet"}
    raise ValueError(f"{end} files are not read; use .csv, .xlsx, .sav or .parquet")


def with_value_labels(df: DataFrame, labels: dict[str, dict[str, str]], missing: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Codes as labels, by column; codes in a missing range become null. Scales named ``_XtoY`` keep their codes."""
    for column, low_high in (missing or {}).items():
        df = df.withColumn(column, F.when(~F.col(column).try_cast("double").between(*low_high), F.col(column)))
    for column, table in labels.items():
        if table and not re.search(r"_\d+to\d+$", column):
            key = F.col(column).cast("string")
            pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(str(k)), F.lit(v))])
            df = df.withColumn(column, F.coalesce(F.try_element_at(pairs, key), key))
    return df
