"""Periods: tokens of table headers, file names and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quarter numbers as written.
QUARTERS = {"一": 1, "二": 2, "三": 3, "四": 4, "1": 1, "2": 2, "3": 3, "4": 4}


def _quarter(text: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in QUARTERS.items() for x in kv)), F.nullif(text, F.lit("")))


def period_from_token(year: Column, token: Column) -> Column:
    """struct(start, end, frequency) of '3月' or '四季度(末)', or null."""
    t = F.regexp_replace(token, r"\s+", "")
    month = F.nullif(F.regexp_extract(t, r"^([0-9]{1,2})月$", 1), F.lit("")).cast("int")
    quarter = _quarter(F.regexp_extract(t, r"^([一二三四1234])季度末?$", 1))
    first = F.when(month.between(1, 12), month).otherwise(quarter * 3 - 2)
    start = F.when(first.isNotNull(), F.make_date(year, first, F.lit(1)))
    end = F.last_day(F.when(quarter.isNotNull(), F.add_months(start, 2)).otherwise(start))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), F.when(quarter.isNotNull(), "quarter").otherwise("month").alias("frequency")))


def quarter_from_filename(year: Column, name: Column) -> Column:
    """struct(quarter, start, end) of the quarter in a file name, or null."""
    q = _quarter(F.regexp_extract(F.regexp_replace(name, r"\s+", ""), "([一二三四1234])季度", 1))
    start = F.make_date(year, q * 3 - 2, F.lit(1))
    return F.when(q.isNotNull(), F.struct(q.alias("quarter"), start.alias("start"), F.last_day(F.add_months(start, 2)).alias("end")))


def period_start(basis: Column, end: Column) -> Column:
    """A point in time starts at its end, a year-to-date period on January 1."""
    return F.when(basis == "POINT_IN_TIME", end).when(basis == "YTD", F.make_date(F.year(end), F.lit(1), F.lit(1)))


def question_periods(text: Column) -> Column:
    """The sorted period ends a question names: full dates; months without a full date in them (month end); quarters;
    bare years without any other period in them (December 31)."""
    all_of = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    pad = lambda x: F.lpad(x, 2, "0")
    none = F.array().cast("array<string>")
    full = F.transform(F.arrays_zip(all_of(r"(?<![0-9])(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日", 1).alias("y"), all_of(r"(?<![0-9])(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日", 2).alias("m"), all_of(r"(?<![0-9])(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日", 3).alias("d")), lambda z: F.concat(z["y"], F.lit("-"), pad(z["m"]), F.lit("-"), pad(z["d"])))
    month_pattern = r"(?<![0-9])(20[0-9]{2})年([0-9]{1,2})月(?![0-9]*日)"
    months = F.transform(F.arrays_zip(all_of(month_pattern, 1).alias("y"), all_of(month_pattern, 2).alias("m")), lambda z: F.concat(z["y"], F.lit("-"), pad(z["m"])))
    months = F.filter(months, lambda p: ~F.exists(full, lambda q: q.startswith(p)))
    month_ends = F.filter(F.transform(months, lambda p: F.last_day(F.try_to_date(F.concat(p, F.lit("-01")))).cast("string")), lambda p: p.isNotNull())
    quarter_pattern = r"(?<![0-9])(20[0-9]{2})年(?:第)?([一二三四1234])季度"
    quarters = F.transform(F.arrays_zip(all_of(quarter_pattern, 1).alias("y"), all_of(quarter_pattern, 2).alias("q")), lambda z: F.last_day(F.make_date(z["y"].cast("int"), _quarter(z["q"]) * 3, F.lit(1))).cast("string"))
    told = F.concat(full, month_ends, quarters)
    years = F.filter(all_of(r"(?<![0-9])(20[0-9]{2})年", 1), lambda y: ~F.exists(told, lambda q: q.startswith(y)))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(told, F.transform(years, lambda y: F.concat(y, F.lit("-12-31")))))), none)


def missing_months(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(keys, month): the months between a key's first and last that have no row."""
    month = F.trunc(F.col(day).cast("date"), "month")
    have = df.filter(F.col(day).isNotNull()).select(*keys, month.alias("month")).distinct()
    span = have.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(have, [*keys, "month"], "left_anti")
