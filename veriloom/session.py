"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings that the operators rely on; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above. Names in conf use '__' for '.'."""
    b = SparkSession.builder.appName("veriloom")
    if master:
        b = b.master(master)
    settings = DEFAULTS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_veriloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # The driver serves the archive to the executors from here, as long as it runs; executors never see this folder.
    folder = tempfile.mkdtemp(prefix="veriloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "veriloom_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(root, n)
                    z.write(path, os.path.join("veriloom", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    sc._veriloom_shipped = True


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of a data folder, pruned to the columns named."""
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, so that its consumers start from files.

    The folder is the cluster's spark.checkpoint.dir. Only where that is unset (local runs and tests) is a
    temporary folder taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"veriloom-checkpoint-{sc.applicationId}")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def balanced(df: DataFrame) -> DataFrame:
    """df on all cores: rows of a scan with fewer splits than the cluster has cores are dealt out; others stay put.

    For costly work per row. Inputs of any size beyond that have splits enough and aren't moved.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def bounded(df: DataFrame, most: int):
    """The rows of df as a list if there are at most `most`, else None. At most `most` + 1 rows are fetched."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with `name`, the place of each row in the order of a column, from 1: ranges are sorted each by itself and
    counted, so no task holds all rows. Equal values are numbered in any order."""
    parts = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # one row per partition
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    at = F.create_map(*(F.lit(x) for kv in offsets for x in kv)) if offsets else None
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn(name, (place + (F.element_at(at, F.col("_part")) if at is not None else F.lit(0))).cast("long")).drop("_part")
