"""Decimal policies. They differ on purpose and stay separate.

parsed_decimal  statistics tables: percent signs and stars dropped, half-even to six places, status and flags
premium_decimal premium tables: percent signs are errors, rounds only beyond six places
shown           display text by number format, half-up
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells that stand for 'not reported'.
DASHES = ["-", "--", "—", "/", "不适用"]
# Name parts of metrics given in percent.
PERCENT_WORDS = ["率", "占比", "净息差", "存贷比", "比例"]


def _signed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\((.*)\)$", "-$1")


def parsed_decimal(text: Column) -> Column:
    """struct(value decimal(38,6), status, flags) of a cell's text (apply nfkc first where it may be full-width)."""
    raw = F.trim(text)
    number = _signed(F.regexp_replace(raw, "[,%％*]", "")).try_cast("decimal(38,18)")
    rounded = F.bround(number, 6).cast("decimal(38,6)")
    status = (
        F.when(raw.isNull() | (raw == ""), "missing")
        .when(raw.isin(DASHES), "not_reported")
        .when(raw.startswith("#") | number.isNull(), "parse_error")
        .when(rounded == 0, "reported_zero")
        .otherwise("reported")
    )
    good = status.isin("reported", "reported_zero")
    flag = lambda c, f: F.when(c, F.array(F.lit(f))).otherwise(F.array().cast("array<string>"))
    flags = F.when(good, F.concat(flag(rounded.cast("decimal(38,18)") != number, "PRECISION_ROUNDED_6DP"), flag(rounded < 0, "NEGATIVE_VALUE"))).when(
        status == "parse_error", F.array(F.when(raw.startswith("#"), "EXCEL_ERROR").otherwise("NON_NUMERIC_VALUE"))
    ).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(good, rounded).alias("value"), status.alias("status"), flags.alias("flags"))


def premium_decimal(text: Column) -> Column:
    """struct(value decimal(38,6), flag): a percent sign is no number; rounding is flagged only beyond six places."""
    raw = F.regexp_replace(F.trim(text), ",", "")
    number = F.when(raw.rlike(r"^\(?[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\)?$"), _signed(raw).try_cast("decimal(38,18)"))
    rounded = F.bround(number, 6).cast("decimal(38,6)")
    flag = (
        F.when(raw.isNull() | (raw == ""), None)
        .when(raw.startswith("#"), "EXCEL_ERROR")
        .when(number.isNull(), "NON_NUMERIC_VALUE")
        .when(rounded.cast("decimal(38,18)") != number, "PRECISION_ROUNDED_6DP")
        .when(number < 0, "NEGATIVE_VALUE")
    )
    return F.struct(rounded.alias("value"), flag.alias("flag"))


def shown(value: Column, number_format: Column) -> Column:
    """A number as a workbook shows it: the format's section by sign, percent, places (half-up), thousands, brackets.

    A null value is empty text; a null or general format shows the number as it is.
    """
    v = value.cast("decimal(38,18)")
    sections = F.split(number_format, ";")
    section = F.when((v < 0) & (F.size(sections) > 1), F.try_element_at(sections, F.lit(2))).otherwise(F.try_element_at(sections, F.lit(1)))
    percent = F.contains(section, F.lit("%"))
    places = F.length(F.regexp_extract(section, r"\.([0#]+)", 1))
    size = F.abs(v) * F.when(percent, 100).otherwise(1)
    rounded = F.coalesce(*(F.when(places == k, F.round(size, k).cast(f"decimal(38,{k})").cast("string")) for k in range(10)))
    whole, part = F.substring_index(rounded, ".", 1), F.when(F.contains(rounded, F.lit(".")), F.concat(F.lit("."), F.substring_index(rounded, ".", -1))).otherwise("")
    grouped = F.when(F.contains(section, F.lit(",")), F.concat(F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ","), part)).otherwise(rounded)
    signed = F.when(v < 0, F.when(F.contains(section, F.lit("(")), F.concat(F.lit("("), grouped, F.lit(")"))).otherwise(F.concat(F.lit("-"), grouped))).otherwise(grouped)
    general = number_format.isNull() | (number_format == "") | (F.lower(number_format) == "general")
    return F.when(value.isNull(), "").when(general, F.trim(value.cast("string"))).otherwise(F.concat(signed, F.when(percent, "%").otherwise("")))


def with_shown(df: DataFrame, value: str, number_format: str, to: str) -> DataFrame:
    """df with `to`, the text that shown() gives for a decimal column and its format, in steps: each is a column of its
    own, so that the plan holds no expression twice."""
    kept = df.columns
    f = F.col(number_format)
    x = df.withColumns({"_v": F.col(value).cast("decimal(38,18)"), "_sections": F.split(f, ";")})
    x = x.withColumn("_section", F.when((F.col("_v") < 0) & (F.size("_sections") > 1), F.try_element_at("_sections", F.lit(2))).otherwise(F.try_element_at("_sections", F.lit(1))))
    x = x.withColumns({"_percent": F.contains("_section", F.lit("%")), "_places": F.length(F.regexp_extract("_section", r"\.([0#]+)", 1))})
    x = x.withColumn("_size", F.abs("_v") * F.when(F.col("_percent"), 100).otherwise(1))
    x = x.withColumn("_rounded", F.coalesce(*(F.when(F.col("_places") == k, F.round("_size", k).cast(f"decimal(38,{k})").cast("string")) for k in range(10))))
    x = x.withColumns({"_whole": F.substring_index("_rounded", ".", 1), "_part": F.when(F.contains("_rounded", F.lit(".")), F.concat(F.lit("."), F.substring_index("_rounded", ".", -1))).otherwise("")})
    x = x.withColumn("_grouped", F.when(F.contains("_section", F.lit(",")), F.concat(F.regexp_replace("_whole", r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ","), "_part")).otherwise(F.col("_rounded")))
    x = x.withColumn("_signed", F.when(F.col("_v") < 0, F.when(F.contains("_section", F.lit("(")), F.concat(F.lit("("), "_grouped", F.lit(")"))).otherwise(F.concat(F.lit("-"), "_grouped"))).otherwise(F.col("_grouped")))
    general = f.isNull() | (f == "") | (F.lower(f) == "general")
    text = F.when(F.col(value).isNull(), "").when(general, F.trim(F.col(value).cast("string"))).otherwise(F.concat("_signed", F.when(F.col("_percent"), "%").otherwise("")))
    return x.select(*kept, text.alias(to))


def metric_unit(code: Column, name: Column) -> Column:
    """% for metrics whose name says a ratio, else 亿元."""
    return F.when(code == "net_profit_ytd", "亿元").when(F.coalesce(name, F.lit("")).rlike("|".join(PERCENT_WORDS)), "%").otherwise("亿元")


def value_type(raw: Column, unit: Column) -> Column:
    """blank, percentage, integer or decimal."""
    return F.when(raw.isNull() | (F.trim(raw) == ""), "blank").when(F.coalesce(unit, F.lit("")).isin("%", "PERCENT") | raw.endswith("%"), "percentage").when(F.regexp_replace(raw, "[,\\s]", "").rlike("^[-+]?[0-9]+$"), "integer").otherwise("decimal")


def plain_decimal(value: Column) -> Column:
    """Fixed-point text without trailing zeros."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def precision_unit(values: Column) -> Column:
    """Over a group: 1 if all values are whole, else 0.01 (an aggregate)."""
    return F.when(F.bool_and(values == F.floor(values)), F.lit(1).cast("decimal(3,2)")).otherwise(F.lit("0.01").cast("decimal(3,2)"))


def display_precision(text: Column) -> Column:
    """Ten to the minus number of places of a number's text."""
    places = F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    return F.pow(F.lit(10.0), -places)


def option_number(text: Column) -> Column:
    """An option's number, percent as a fraction; null if it isn't one number."""
    t = F.regexp_replace(F.trim(text), "[,，]", "")
    return F.when(t.rlike("[%％]$"), F.regexp_replace(t, "[%％]$", "").try_cast("double") / 100).otherwise(t.try_cast("double"))
