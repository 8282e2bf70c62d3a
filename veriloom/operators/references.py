"""References to records that are not there (orphans): found per reference, counted per table and period.

A reference is (table_name, record_id, field_name, ref_id, at, period). Its target set is the table that field_name
points to. Only distinct references are matched: repeated keys are folded before any shuffle, so that a key which
holds a third of all rows costs one row per map task.

Reasons, the first that holds:
  missing  no row of the target table has the id (compared exactly, as stored)
  deleted  the target's deleted_at is set
  late     the target's created_at is after the referring row's
A repeated target counts as deleted if every row of it is, and as late only if its earliest row is. A null reference
is no reference; a null created_at on either side is never late; an empty string is an id like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """One foreign key: a column of a table (an array gives one reference per element) and the field's target."""

    table_name: str
    record_id: str
    field: str
    target: str
    field_name: str | None = None
    at: str = "created_at"
    period: str | None = None


def references(df: DataFrame, links: list[Link]) -> DataFrame:
    """Non-null references of df, one row per referring row and key, from a single scan."""
    types = dict(df.dtypes)

    def entry(x: Link) -> Column:
        ids = F.col(x.field) if types[x.field].startswith("array") else F.array(F.col(x.field))
        return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.struct(F.lit(x.field_name or x.field).alias("field_name"), F.lit(x.target).alias("target"), i.cast("string").alias("ref_id")))

    one = links[0]
    return (
        df.select(
            F.lit(one.table_name).alias("table_name"),
            F.col(one.record_id).alias("record_id"),
            (F.col(one.at) if one.at in types else F.lit(None)).cast("timestamp").alias("at"),
            (F.date_format(one.period, "yyyy-MM") if one.period else F.lit(None).cast("string")).alias("period"),
            F.explode(F.concat(*(entry(x) for x in links))).alias("r"),
        )
        .select("table_name", "record_id", "at", "period", "r.field_name", "r.target", "r.ref_id")
        .filter("ref_id is not null")
    )


def targets(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(target, ref_id, live, since) of each target table, one row per id; tables: target -> (rows, id column)."""
    out = None
    for name, (df, key) in tables.items():
        have = set(df.columns)
        part = df.filter(F.col(key).isNotNull()).select(
            F.lit(name).alias("target"),
            F.col(key).cast("string").alias("ref_id"),
            (F.col("deleted_at").isNull() if "deleted_at" in have else F.lit(True)).alias("live"),
            (F.col("created_at").cast("timestamp") if "created_at" in have else F.lit(None).cast("timestamp")).alias("since"),
        )
        out = part if out is None else out.unionByName(part)
    return out.groupBy("target", "ref_id").agg(F.max("live").alias("live"), F.min("since").alias("since"))


def orphans(refs: DataFrame, target_rows: DataFrame) -> DataFrame:
    """The orphan references with their reason: (table_name, record_id, field_name, ref_id, reason, period, n).

    Two steps. The distinct keys, with the earliest time of a row that refers to each, go through one join with the
    target keys; sound keys drop out there by an anti join. The rows come back only for the keys left, in a join that
    adaptive execution splits where a key is hot. n is the number of referring rows.
    """
    keys = refs.groupBy("target", "ref_id").agg(F.min("at").alias("first_at"))
    found = keys.join(target_rows, ["target", "ref_id"], "left")
    state = F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("since") > F.col("first_at"), "late")
    bad = found.select("target", "ref_id", state.alias("reason"), "since").filter("reason is not null")
    rows = refs.join(bad, ["target", "ref_id"]).filter("reason <> 'late' or since > at")
    return rows.groupBy("table_name", "record_id", "field_name", "ref_id", "reason", "period").agg(F.count(F.lit(1)).alias("n"))


def orphan_counts(refs: DataFrame, target_rows: DataFrame) -> DataFrame:
    """Per table, field and period: references, orphans by reason, distinct orphan ids, and the orphan share.

    Every reference counts once per referring row; periods without an orphan are listed with zeros. All references are
    counted where they stand; only the distinct keys are matched, and only the rows of keys in doubt come back (orphans).
    """
    group = ["table_name", "field_name", "period"]
    total = refs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_refs"))
    by = lambda r: F.sum(F.when(F.col("reason") == r, F.col("n")).otherwise(0)).alias(f"n_{r}")
    found = orphans(refs, target_rows).groupBy(*group).agg(by("missing"), by("deleted"), by("late"), F.count_distinct("ref_id").alias("n_orphan_ids"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    x = total.alias("a").join(found.alias("b"), same, "left").select(*(F.col(f"a.{g}") for g in group), "n_refs", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_missing", "n_deleted", "n_late", "n_orphan_ids")))
    return x.withColumn("orphan_share", F.round((F.col("n_missing") + F.col("n_deleted") + F.col("n_late")) / F.col("n_refs"), 6))
