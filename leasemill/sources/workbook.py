"""Spreadsheet files to the cells table.

A workbook is a zip of XML parts. Spark distributes the files; each file is opened on its own by a small helper
that streams one sheet at a time and yields cells in batches.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leasemill.functions.expressions import safe_sheet_name
from leasemill.schemas import CELLS
from leasemill.sources.bronze import WORKBOOK_GLOB

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_BATCH = 20_000


def read_workbooks(spark: SparkSession, path: str, glob: str = WORKBOOK_GLOB) -> DataFrame:
    """Cells of every workbook below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )
    return cells_of(files)


def cells_of(files: DataFrame) -> DataFrame:
    """(path, content) rows to cells.

    A file that cannot be read, or that has no cell, is one row without a sheet; ``value`` says what was wrong.
    """
    return files.select("path", "content").mapInPandas(_decode, CELLS)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "sheet", "sheet_no", "row", "col", "value"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows, some, error = [], False, None
            try:
                for cell in _workbook_cells(content):
                    rows.append((path, *cell))
                    some = True
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except Exception as failure:  # a file is data: a bad one must not stop the others
                error = f"{type(failure).__name__}: {failure}"
            if rows:
                yield pd.DataFrame(rows, columns=columns)
            if error or not some:
                yield pd.DataFrame([(path, None, None, None, None, error or "no cells")], columns=columns, dtype=object)


def _workbook_cells(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        names = set(parts.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t"))
                      for s in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(parts.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        links = {r.get("Id"): r.get("Target")
                 for r in ElementTree.fromstring(parts.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(parts.read("xl/workbook.xml"))
        for number, sheet in enumerate(book.iter(f"{_MAIN}sheet"), start=1):
            target = links[sheet.get(_LINK)]
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            with parts.open(part) as stream:
                for _, node in ElementTree.iterparse(stream):
                    if node.tag == f"{_MAIN}row":
                        for cell in node.iter(f"{_MAIN}c"):
                            value = _value(cell, shared, dates)
                            if value is not None and cell.get("r"):
                                row, col = _address(cell.get("r"))
                                yield sheet.get("name"), number, row, col, value
                        node.clear()


def _date_styles(styles: bytes) -> set[int]:
    root = ElementTree.fromstring(styles)
    custom = {int(n.get("numFmtId")) for n in root.iter(f"{_MAIN}numFmt")
              if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", "")), re.I)}
    cell_formats = root.find(f"{_MAIN}cellXfs")
    formats = [] if cell_formats is None else [int(x.get("numFmtId", 0)) for x in cell_formats]
    return {i for i, fmt in enumerate(formats) if fmt in _DATE_FORMATS or fmt in custom}


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
    raw = cell.findtext(f"{_MAIN}v")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)] or None
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return str(datetime(1899, 12, 30) + timedelta(days=float(raw)))
    return raw


def _address(reference: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", reference).groups()
    col = 0
    for letter in letters:
        col = col * 26 + ord(letter) - ord("A") + 1
    return int(digits), col


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Non-empty sheets as rows of (file, sheet_safe, row, values by column number).

    A group is one worksheet row, at most 16,384 cells.
    """
    return cells.where("sheet IS NOT NULL").groupBy("file", safe_sheet_name(F.col("sheet")).alias("sheet_safe"), "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells")
    )


# A number as JSON writes it, of at most 18 digits; codes with leading zeros are text.
_JSON_NUMBER = r"^(?=(?:[^0-9]*[0-9]){1,18}[^0-9]*$)-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?$"


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def sheet_tables(cells: DataFrame) -> DataFrame:
    """Sheets as tables of their own: (file, sheet_safe, row, names, record), one row per row below a sheet's header.

    The header is a sheet's first row with a value. ``names`` holds the sheet's columns in order: the trimmed header cell, with .1, .2 ...
    where it repeats, or column_<number> for a column without one. ``record`` is a variant object of the row's values, numbers as
    numbers. Empty rows and sheets without a row below the header have none.
    """
    filled = cells.where("sheet IS NOT NULL AND trim(value) <> ''").select(
        "file", safe_sheet_name(F.col("sheet")).alias("sheet_safe"), "row", "col", F.trim("value").alias("value"))
    grain = ["file", "sheet_safe"]
    first = filled.groupBy(*grain).agg(F.min("row").alias("header_row"))
    # One row per column of a sheet, 16,384 at most.
    columns = filled.join(first, grain).groupBy(*grain, "header_row", "col").agg(
        F.max(F.when(F.col("row") == F.col("header_row"), F.col("value"))).alias("header"))
    given = F.coalesce("header", F.concat(F.lit("column_"), F.col("col").cast("string")))
    again = F.row_number().over(Window.partitionBy(*grain, given).orderBy("col")) - 1
    columns = columns.withColumn("name", F.when(again > 0, F.concat_ws(".", given, again.cast("string"))).otherwise(given))
    names = columns.groupBy(*grain).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda c: c["name"]).alias("names"))
    value = F.when(F.col("value").rlike(_JSON_NUMBER), F.col("value")).otherwise(_quoted(F.col("value")))
    member = F.concat(_quoted(F.col("name")), F.lit(": "), value)
    body = filled.join(columns.select(*grain, "header_row", "col", "name"), [*grain, "col"]).where(F.col("row") > F.col("header_row"))
    records = body.groupBy(*grain, "row").agg(F.array_join(F.collect_list(member), ", ").alias("members"))
    return records.join(names, grain).select(
        *grain, "row", "names", F.parse_json(F.concat(F.lit("{"), F.col("members"), F.lit("}"))).alias("record"))
