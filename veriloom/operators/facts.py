"""Structured questions over facts: lookup, aggregates, difference, ratio and trend as parameterised plans.

Facts are (source_id, metric_code/name, entity_code/name, period_end, normalized_value text, unit, …). User text only
ever becomes a literal in a Column, never SQL. A fact without a normalised value takes no part; text that is no number
is skipped by aggregates. group_by is our extension: the reference declares it and doesn't use it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units that name one thing.
UNIT_ALIASES = {"亿元": ("亿元", "CNY_100M"), "万件": ("万件", "TEN_THOUSAND_POLICIES")}
#: Most rows that a lookup or a derived operation reads, in order.
MOST_ROWS = 200
ORDER = ["period_end", "metric_code", "entity_code", "fact_id"]


@dataclass(frozen=True)
class FactQuery:
    """One operation with its filters; an empty filter lets all through."""

    operation: str = "lookup"
    sources: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    periods: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    group_by: tuple[str, ...] = field(default=())

    def where(self) -> Column:
        """AND over the facets, any value within one; metrics and entities by code or name, units with their aliases."""
        out = F.col("normalized_value").isNotNull()
        if self.sources:
            out &= F.col("source_id").isin(*self.sources)
        if self.metrics:
            out &= F.col("metric_code").isin(*self.metrics) | F.col("metric_name").isin(*self.metrics)
        if self.entities:
            out &= F.col("entity_code").isin(*self.entities) | F.col("entity_name").isin(*self.entities)
        if self.periods:
            out &= F.col("period_end").cast("string").isin(*self.periods)
        if self.units:
            out &= F.col("unit").isin(*{a for u in self.units for a in UNIT_ALIASES.get(u, (u,))})
        return out


def latest(facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """Each fact once: of redelivered rows the one of the latest run, ties by the whole row."""
    rest = [c for c in facts.columns if c != key]
    order = F.struct("created_at", "run_id", F.to_json(F.struct(*rest)))
    return facts.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def first_by(facts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key once: the first row by an order, nulls last."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return facts.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _value() -> Column:
    return F.col("normalized_value").try_cast("decimal(38,12)")


def lookup(facts: DataFrame, q: FactQuery, most: int = MOST_ROWS) -> DataFrame:
    """The facts themselves, ordered, at most `most`, each with the line that cites it."""
    rows = facts.filter(q.where()).orderBy(*(F.col(c).asc_nulls_last() for c in ORDER)).limit(most)
    return rows.withColumn("excerpt", excerpt())


def excerpt() -> Column:
    """entity；metric；period：value unit."""
    label = F.concat_ws("；", "entity_name", "metric_name", F.col("period_end").cast("string"))
    return F.concat(label, F.lit("："), F.coalesce("normalized_value", F.lit("")), F.coalesce("unit", F.lit("")))


def aggregate(facts: DataFrame, q: FactQuery) -> DataFrame:
    """sum, average, minimum, maximum or count, one row per group; a group without a value gives no row.

    Units aren't checked, as in the reference. The average is a double.
    """
    v = _value()
    how = {
        "sum": F.sum(v).cast("decimal(38,12)"),
        "average": F.avg(v.cast("double")),
        "minimum": F.min(v),
        "maximum": F.max(v),
        "count": F.count(F.lit(1)),
    }[q.operation]
    return facts.filter(q.where()).groupBy(*q.group_by).agg(how.alias("value")).filter("value is not null")


def derived(facts: DataFrame, q: FactQuery, most: int | None = None) -> DataFrame:
    """difference and trend (last less first) or ratio (last over first, none for a zero first), one row per group.

    Needs at least two rows of one unit, one metric and one entity. Of a single question (no group_by) the first
    MOST_ROWS rows by period take part, as in the reference; in groups all rows do, unless `most` is set. Null units,
    codes count as one value of their own.
    """
    rows = facts.filter(q.where())
    if most is None and not q.group_by:
        most = MOST_ROWS
    if most is None:
        pass
    elif q.group_by:
        w = Window.partitionBy(*q.group_by).orderBy(*(F.col(c).asc_nulls_last() for c in ORDER))
        rows = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    else:
        rows = rows.orderBy(*(F.col(c).asc_nulls_last() for c in ORDER)).limit(most)
    key = F.struct(F.coalesce("period_end", F.lit("9999-12-31").cast("date")), *(F.coalesce(c, F.lit("\U0010ffff")) for c in ORDER[1:]))
    kinds = lambda c: F.count_distinct(F.coalesce(c, F.lit("\x00")))
    g = rows.groupBy(*q.group_by).agg(
        F.count(F.lit(1)).alias("n"), kinds("unit").alias("nu"), kinds("metric_code").alias("nm"), kinds("entity_code").alias("ne"),
        F.min_by(F.struct(_value().alias("v"), "period_end"), key).alias("a"), F.max_by(F.struct(_value().alias("v"), "period_end"), key).alias("b"),
    )
    ok = g.filter("n >= 2 and nu = 1 and nm = 1 and ne = 1 and a.v is not null and b.v is not null")
    if q.operation == "ratio":
        value = F.when(F.col("a.v") != 0, F.round(F.col("b.v").cast("double") / F.col("a.v").cast("double"), 6))
    else:
        value = (F.col("b.v") - F.col("a.v")).cast("decimal(38,12)")
    return ok.select(*q.group_by, F.col("a.period_end").alias("first_period"), F.col("b.period_end").alias("last_period"), "n", value.alias("value")).filter("value is not null")


def run(facts: DataFrame, q: FactQuery, most: int | None = None) -> DataFrame:
    """The plan of a query by its operation; most: rows of a group that a derived operation reads (None: all)."""
    if q.operation == "lookup":
        return lookup(facts, q)
    return derived(facts, q, most) if q.operation in ("difference", "ratio", "trend") else aggregate(facts, q)


def dictionaries(facts: DataFrame) -> DataFrame:
    """(kind, code, name): the distinct metrics and entities for planning."""
    cell = F.explode(F.array(F.struct(F.lit("metric").alias("kind"), F.col("metric_code").alias("code"), F.col("metric_name").alias("name")), F.struct(F.lit("entity").alias("kind"), F.col("entity_code").alias("code"), F.col("entity_name").alias("name"))))
    return facts.select(cell.alias("c")).select("c.*").filter("name is not null").distinct()
