"""Tables out of cell grids: headers found, body unpivoted by join, labels mapped, no per-cell Python.

A cell is (file, sheet, row, col, value, formula, format). Rows and columns count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.dates import period_from_token
from veriloom.functions.numbers import premium_decimal
from veriloom.functions.text import label_key, squeezed
from veriloom.operators.dims import PREMIUM_METRICS

SHEET = ["file", "sheet"]


def address(row: Column, col: Column) -> Column:
    """The A1 address of a cell (columns up to XFD, the last of a sheet)."""
    letter = lambda n: F.when(n > 0, F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)))).otherwise("")
    high = F.floor((col - 1) / 26)
    return F.concat(letter(F.floor((high - 1) / 26)), letter(high), letter(col), row.cast("string"))


def header_rows(cells: DataFrame, required: list[str]) -> DataFrame:
    """(file, sheet, header_row): the first row of each sheet that holds all required labels."""
    x = cells.select(*SHEET, "row", squeezed(F.col("value")).alias("v")).filter(F.col("v").isin(*required))
    return x.groupBy(*SHEET, "row").agg(F.count_distinct("v").alias("n")).filter(F.col("n") == len(required)).groupBy(*SHEET).agg(F.min("row").alias("header_row"))


def sheets_with(cells: DataFrame, required: list[str], rows: int = 100, cols: int = 12) -> DataFrame:
    """(file, sheet) whose first cells hold every required text."""
    v = squeezed(F.col("value"))
    flags = [F.bool_or(F.contains(v, F.lit(t))).alias(f"t{i}") for i, t in enumerate(required)]
    g = cells.filter((F.col("row") <= rows) & (F.col("col") <= cols) & F.col("value").isNotNull()).groupBy(*SHEET).agg(*flags)
    for i in range(len(required)):
        g = g.filter(f"t{i}")
    return g.select(*SHEET)


def period_columns(cells: DataFrame, headers: DataFrame, year: Column) -> DataFrame:
    """(file, sheet, col, period): the header cells that name a month or quarter."""
    h = cells.join(headers, SHEET).filter("row = header_row").withColumn("period", period_from_token(year, F.col("value")))
    return h.filter("period is not null").select(*SHEET, "col", "period")


def filled_down(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns with nulls filled by the last value above."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def body(cells: DataFrame, headers: DataFrame, columns: DataFrame, label_col: int = 1) -> DataFrame:
    """Below the header, each cell of a wanted column beside its row's label and its column's attributes."""
    under = cells.join(headers, SHEET).filter("row > header_row")
    labels = under.filter(F.col("col") == label_col).select(*SHEET, "row", F.col("value").alias("label"))
    return under.join(columns, [*SHEET, "col"]).join(labels, [*SHEET, "row"], "left").drop("header_row")


def footnotes(cells: DataFrame, mark: str = "注", marks: tuple[str, ...] = ()) -> DataFrame:
    """(file, sheet, footnotes): the texts from the first row on that starts with the mark, or any of the marks, each
    once, in order."""
    v = F.trim("value")
    x = cells.filter(F.col("value").isNotNull() & (v != "")).withColumn("v", v)
    starts = x.filter(F.col("v").rlike("^(?:" + "|".join(marks or (mark,)) + ")")).groupBy(*SHEET).agg(F.min("row").alias("start"))
    g = x.join(starts, SHEET).filter("row >= start").groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row", "col", "v"))).alias("n"))
    return g.select(*SHEET, F.array_join(F.array_distinct(F.transform("n", lambda s: s["v"])), "\n").alias("footnotes"))


def premium_facts(cells: DataFrame, periods: DataFrame, regions: DataFrame) -> DataFrame:
    """Regional premiums of monthly sheets: one fact per region row and metric column.

    periods: (file, period_end); regions: alias dimension with key, region_code, region_name. Values follow the premium
    decimal policy; a formula without a cached value is flagged for review. Periods run from January 1.
    """
    headers = header_rows(cells, ["地区", "合计", "寿险", "意外险", "健康险"])
    code = F.coalesce(*(F.when(squeezed(F.col("value")).isin(*labels), c) for c, labels, _ in PREMIUM_METRICS))
    name = F.coalesce(*(F.when(F.col("metric_code") == c, n) for c, _, n in PREMIUM_METRICS))
    columns = cells.join(headers, SHEET).filter("row = header_row").withColumn("metric_code", code).filter("metric_code is not null").groupBy(*SHEET, "metric_code").agg(F.min("col").alias("col"), F.min_by("value", "col").alias("metric_name_raw"))
    x = body(cells, headers, columns).withColumn("key", label_key(F.col("label"))).join(regions.drop("alias"), "key")
    parsed = x.join(periods, "file").withColumn("d", premium_decimal(F.col("value")))
    missing = F.col("formula").isNotNull() & F.col("value").isNull()
    return parsed.select(
        *SHEET, "region_code", "region_name", F.col("label").alias("region_name_raw"), "metric_code", name.alias("metric_name"), "metric_name_raw",
        F.make_date(F.year("period_end"), F.lit(1), F.lit(1)).alias("period_start"), "period_end", F.lit("YTD").alias("period_basis"),
        F.col("value").alias("raw_value"), F.col("d.value").alias("value"), F.col("d.flag").alias("flag"), F.lit("CNY_100M").alias("unit"),
        address(F.col("row"), F.col("col")).alias("cell"), F.col("formula").alias("formula_raw"), missing.alias("requires_manual_review"),
    )


def period_table_facts(cells: DataFrame, required: list[str], year: Column, labels: DataFrame, numbers) -> DataFrame:
    """Facts of any table with one row per metric or entity and one column per period: header by its labels, columns by
    period, rows by an alias dimension (key, …), values by a decimal policy that gives a struct."""
    headers = header_rows(cells, required)
    columns = period_columns(cells, headers, year)
    x = body(cells, headers, columns).withColumn("key", label_key(F.col("label")))
    return x.join(labels.drop("alias"), "key").withColumn("d", numbers(F.col("value"))).drop("key")


def table_regions(rows: DataFrame, keys: list[str], order: str, blank: str) -> DataFrame:
    """(keys, region, start_row, end_row, n_rows): runs of rows between blank rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("region", F.sum(F.col(blank).cast("int")).over(w)).filter(~F.col(blank))
    return x.groupBy(*keys, "region").agg(F.min(order).alias("start_row"), F.max(order).alias("end_row"), F.count(F.lit(1)).alias("n_rows"))


def grid_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, source_range, row_text, n_cells, n_errors, n_missing_cache): non-blank rows of any sheet."""
    v = F.trim(F.coalesce("value", F.lit("")))
    missing = F.col("formula").isNotNull() & (v == "")
    g = cells.filter((v != "") | missing).groupBy(*SHEET, "row").agg(
        F.min("col").alias("a"), F.max("col").alias("b"), F.array_sort(F.collect_list(F.struct("col", v.alias("v")))).alias("c"),
        F.count_if(v != "").alias("n_cells"), F.count_if(v.startswith("#")).alias("n_errors"), F.count_if(missing).alias("n_missing_cache"),
    )
    text = F.array_join(F.filter(F.transform("c", lambda s: s["v"]), lambda t: t != ""), " | ")
    return g.select(*SHEET, "row", F.concat(address(F.col("row"), F.col("a")), F.lit(":"), address(F.col("row"), F.col("b"))).alias("source_range"), text.alias("row_text"), "n_cells", "n_errors", "n_missing_cache")


def schema_by_labels(rows: DataFrame, keys: list[str], label: str, rules: list[tuple[str, list[str]]], other: str) -> DataFrame:
    """(keys, schema_version): the first rule all of whose labels occur in the group."""
    g = rows.groupBy(*keys).agg(F.collect_set(label_key(F.col(label))).alias("s"))
    version = F.coalesce(*(F.when(F.forall(F.array(*map(F.lit, need)), lambda n: F.array_contains("s", n)), v) for v, need in rules), F.lit(other))
    return g.select(*keys, version.alias("schema_version"))


# Name patterns of monthly workbooks and of regulatory tables, first match wins.
MONTHLY = [
    ("regional_premium_monthly", r"^[0-9]+_20[0-9]{2}年0?[0-9]{1,2}月全国各地区原保险保费收入情况表"),
    ("life_insurance_monthly", r"^[0-9]+_20[0-9]{2}年0?[0-9]{1,2}月人身险公司经营情况表_"),
    ("property_insurance_monthly", r"^[0-9]+_20[0-9]{2}年0?[0-9]{1,2}月财产(?:保险|险)公司经营情况表_"),
    ("insurance_industry_monthly", r"^[0-9]+_20[0-9]{2}年0?[0-9]{1,2}月保险业经营情况表_"),
]
REGULATORY = [
    ("bank_balance_monthly", "银行业总资产、总负债（月度）"),
    ("inclusive_small_business_loans", "普惠型小微企业贷款情况"),
    ("inclusive_agricultural_loans", "普惠型涉农贷款情况"),
    ("affordable_housing_loans", "保障性安居工程贷款情况"),
    ("commercial_bank_indicators_by_type", "商业银行主要指标分机构类情况表"),
    ("commercial_bank_regulatory_indicators", "商业银行主要监管指标情况表"),
    ("bank_balance_quarterly", "总资产、总负债（季度）"),
]
TEMPLATES = ["394", "395", "441", "444", "445", "446", "449", "461", "464", "466", "468", "469", "470", "471", "496"]


def workbook_kind(name: Column) -> Column:
    """The dataset a workbook holds, by its file name: monthly tables, release schedule, regulatory tables, funds,
    solvency, templates by number, else a reference document. Ordered, the first match wins."""
    compact = F.regexp_replace(name, r"\s+", "")
    dated = compact.rlike(r"^[0-9]+_20[0-9]{2}年")
    out = F.when(F.substring_index(name, "_", 1).isin(*TEMPLATES), "excel_template_library").otherwise("excel_reference_documents")
    out = F.when(dated & F.contains(compact, F.lit("偿付能力")) & compact.rlike("状况表|情况表"), "insurance_solvency").otherwise(out)
    out = F.when(dated & compact.rlike("[一二三四1234]季度保险(?:业|公司)资金运用情况表"), "insurance_funds_investment").otherwise(out)
    for dataset, token in reversed(REGULATORY):
        out = F.when(dated & F.contains(compact, F.lit(token)), dataset).otherwise(out)
    out = F.when(dated & compact.rlike("监管统计信息发布日程|机构范围|指标解释"), "regulatory_release_schedule").otherwise(out)
    for dataset, pattern in reversed(MONTHLY):
        out = F.when(name.rlike(pattern), dataset).otherwise(out)
    return out
