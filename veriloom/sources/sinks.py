"""Writers: immutable snapshots, idempotent upserts, a pointer to the current version, reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.session import bounded


def write_facts(df: DataFrame, path: str) -> None:
    """Facts as zstd parquet, sorted within files for row-group pruning; an existing path is never replaced."""
    order = [c for c in ("metric_code", "period_end", "source_id") if c in df.columns]
    (df.sortWithinPartitions(*order) if order else df).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def union_all(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a dataset as one, their schemas merged by name."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of an idempotent upsert that have to be appended: one per key, none that is there already."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def write_atomic(path: str, text: str) -> None:
    """A small text file written beside its place and moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def activate(pointer: str, version: str, checks: dict[str, bool]) -> None:
    """Point to a version, only if all its checks hold."""
    failed = sorted(k for k, ok in checks.items() if not ok)
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")
    write_atomic(pointer, json.dumps({"current": version}, ensure_ascii=False))


def current(pointer: str) -> str:
    """The version a pointer names."""
    with open(pointer, encoding="utf-8") as f:
        return json.load(f)["current"]


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of the files under a folder, paths relative to it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root else f"file:{os.path.abspath(root)}"
    return df.select(F.regexp_replace(F.substring("path", len(base) + 2, 1 << 20), "^/+", "").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def report_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header and, in each file, the byte order mark that spreadsheets look for."""
    first, rest = df.columns[0], df.columns[1:]
    marked = df.withColumnRenamed(first, "\ufeff" + first)
    marked.select("\ufeff" + first, *rest).write.mode("errorifexists").option("header", "true").csv(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more than `most` rows are an error, as none is left out."""
    rows = bounded(df, most)
    if rows is None:
        raise ValueError(f"more than {most} rows: write the result as CSV")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"
