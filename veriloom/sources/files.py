"""File sources: discovery, format checks, registration, JSON lines, lexicons and workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from veriloom.functions.ids import stable_id

# The formats taken and how their files start.
SUFFIXES = ["pdf", "doc", "docx", "xls", "xlsx"]
_OLE = "D0CF11E0A1B11AE1"


def discover(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, name, suffix, length, content): files of the formats taken, without temporary ones."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    x = df.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), "length", "content")
    return x.filter(F.col("suffix").isin(*SUFFIXES) & ~F.col("name").startswith("~$"))


@F.pandas_udf(StringType())
def _zip_kind(content: pd.Series) -> pd.Series:
    def one(data: bytes) -> str | None:
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except Exception:
            return None
        return "docx" if "word/document.xml" in names else "xlsx" if "xl/workbook.xml" in names else None

    return content.map(one)


def detected_format(content: Column, suffix: Column) -> Column:
    """The format by content, or null: PDF mark, OLE header (doc or xls by suffix), ZIP with its mandatory part."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("255044462D"), "pdf")
        .when(head == _OLE, F.when(suffix.isin("doc", "xls"), suffix))
        .when(head.startswith("504B0304"), _zip_kind(content))
    )


def register(files: DataFrame, knowledge_base: str) -> DataFrame:
    """files with content hash, source id (same content, same id), detected format and whether it fits the suffix."""
    digest = F.sha2("content", 256)
    kind = detected_format(F.col("content"), F.col("suffix"))
    x = files.withColumns({"source_sha256": digest, "detected": kind})
    return x.withColumns({"source_id": stable_id("src", F.lit(knowledge_base), F.col("source_sha256")), "format_ok": F.coalesce(F.col("detected") == F.col("suffix"), F.lit(False))}).drop("content")


def changed_sources(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, problem): registered files that are gone or whose size or hash differs."""
    b = before.select("path", F.col("length").alias("l0"), F.col("source_sha256").alias("h0"))
    x = b.join(now.select("path", "length", "source_sha256"), "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when((F.col("l0") != F.col("length")) | (F.col("h0") != F.col("source_sha256")), "changed")
    return x.select("path", problem.alias("problem")).filter("problem is not null")


def first_per_format(files: DataFrame, n: int) -> DataFrame:
    """The first n files of each suffix by path without case."""
    w = Window.partitionBy("suffix").orderBy(F.lower("path"), "path")
    return files.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON lines by a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, idx): one term per line, each once, in the order of first appearance (one small file)."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("idx", "term"))
    return x.withColumn("term", F.trim("term")).filter("term <> ''").groupBy("term").agg(F.min("idx").alias("idx"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that workbooks refer to by number.
_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "yyyy/m/d"}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str | None, str | None, str]]:
    """(sheet, row, col, value, formula, number format) of the cells of an XLSX file, by the standard library.

    Only sheet data is read, so a broken filter or view in a sheet does no harm. A formula without a cached value has a
    null value.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    formats = [_FORMATS[0]]
    if "xl/styles.xml" in names:
        styles = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.findall("m:numFmts/m:numFmt", _NS)}
        formats = [own.get(i) or _FORMATS.get(i, "General") for i in (int(x.get("numFmtId") or 0) for x in styles.findall("m:cellXfs/m:xf", _NS))] or formats
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
        target = targets[sheet.get(_REL)].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        for c in ET.fromstring(z.read(part)).findall("m:sheetData/m:row/m:c", _NS):
            ref, kind, style = c.get("r"), c.get("t"), int(c.get("s") or 0)
            v, f = c.find("m:v", _NS), c.find("m:f", _NS)
            text = v.text if v is not None else None
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            formula = f"={f.text or ''}" if f is not None else None
            if text is not None or formula:
                yield sheet.get("name"), int(re.search("[0-9]+", ref)[0]), _column(ref), text, formula, formats[style] if style < len(formats) else "General"


def cells(files: DataFrame) -> DataFrame:
    """(file, sheet, row, col, value, formula, format, error) of XLSX files (path, content). A file that can't be read
    gives one row with the error, and stops no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "sheet", "row", "col", "value", "formula", "format", "error"]
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows = [(path, *c, None) for c in workbook_cells(data)]
                except Exception as e:
                    rows = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "file string, sheet string, row int, col int, value string, formula string, format string, error string")
