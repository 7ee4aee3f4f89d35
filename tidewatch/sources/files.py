"""File sources and sinks: CSV, JSON, Parquet, workbooks. Writers go through Spark's commit protocol, so that a failed or
repeated task never leaves half a table; a table is replaced as a whole.

Defined cases: a missing path raises FileNotFoundError with the path; cells that can't be read as their type are null; NaN
and infinities are written as null in JSON; empty tables keep their schema.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _read(make, path: str) -> DataFrame:
    try:
        return make()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{path}: no such table; run the step that writes it first") from error
        raise


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, dates: Sequence[str] = ()) -> DataFrame:
    """UTF-8 with a header. With a schema nothing is read twice; without one types are inferred. ``dates`` become dates."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    frame = _read(lambda: reader.csv(path), path)
    return frame.withColumns({d: F.try_to_timestamp(F.col(d).cast("string")).cast("date") for d in dates}) if dates else frame


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    frame = _read(lambda: spark.read.parquet(path), path)
    return frame.select(*columns) if columns else frame


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return _read(lambda: reader.json(path), path)


def plain_numbers(frame: DataFrame) -> DataFrame:
    """NaN and infinities as null in the columns of floating point."""
    fixed = {n: F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(F.col(n)) for n, t in frame.dtypes if t in ("double", "float")}
    return frame.withColumns(fixed) if fixed else frame


def write_parquet(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = frame.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n").csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    plain_numbers(frame).write.mode("overwrite").option("ignoreNullFields", False).json(path)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an .xlsx workbook as text; a workbook is zipped XML, so nothing else is needed."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{_NS}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                at = at - 1 if at else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = cell.find(f"{_NS}v")
                text = value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{_NS}t")) or None
                cells[at] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
            yield cells


def read_excel(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of the first sheet of each workbook under ``path``, as text; one workbook is one row of a task."""
    books = _read(lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                sheet = list(sheet_rows(content))
                head = [str(h or "").strip().lower() for h in sheet[0]] if sheet else []
                place = [head.index(c.lower()) if c.lower() in head else None for c in columns]
                yield pd.DataFrame([[r[p] if p is not None and p < len(r) else None for p in place] for r in sheet[1:]], columns=list(columns))

    return books.select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))
