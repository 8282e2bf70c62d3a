"""Facts out of the cell grids of statistical workbooks, one plan per layout.

cells (file, sheet, row, col, value, formula, format), all text but row and col; files (file, dataset, year, month,
source_format, source_file_hash), one row per file. Every parser turns all files of its datasets at once: the header is
found by its labels, running marks (entity, group, period, parent metric) are filled down a sheet by a window, and the
body is the join of line labels, column labels and cells. No cell is looked at in Python, but for the compatibility form
of the labels. Sheets are small; files are many, and partition the work.

Defined results: blank cells give no fact; a label that isn't known gives none either and is listed by
unknown_metrics / unknown_lines where it stands beside numbers; a file without the header gives no fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.dates import period_from_token, quarter_from_filename
from veriloom.functions.numbers import metric_unit, parsed_decimal, premium_decimal, with_shown
from veriloom.functions.text import full_label_key, nfkc, squeezed
from veriloom.operators import dims
from veriloom.operators.tables import SHEET, address, footnotes, sheets_with
from veriloom.session import cut

#: The columns of a regulatory fact, in order.
FACT = [
    "dataset_id", "release_id", "period_start", "period_end", "frequency", "period_basis", "scope", "entity_code", "entity_name", "entity_name_raw", "metric_code", "metric_name", "metric_name_raw",
    "metric_group", "measure_type", "value", "value_storage", "value_display", "value_decimal", "value_raw", "value_status", "unit", "unit_raw", "schema_version", "scope_version", "comparability_flag",
    "source_file", "source_file_hash", "source_format", "source_origin", "source_sheet", "source_cell", "formula_raw", "number_format", "calculation_basis", "footnotes", "quality_flags",
]
# Texts that tell a layout's sheet.
SHEET_TEXTS = {
    "bank_balance_monthly": ["总资产", "总负债", "项目"], "bank_balance_quarterly": ["总资产", "总负债", "项目"],
    "inclusive_small_business_loans": ["普惠型小微企业贷款", "项目"], "inclusive_agricultural_loans": ["普惠型涉农贷款", "项目"], "affordable_housing_loans": ["保障性安居工程贷款", "项目"],
    "commercial_bank_indicators_by_type": ["时间/指标", "大型商业银行", "不良贷款余额"], "commercial_bank_regulatory_indicators": ["信用风险指标", "不良贷款余额", "资本充足率"],
    "insurance_solvency": ["综合偿付能力", "核心偿付能力"], "insurance_funds_investment": ["资金运用余额"],
}
# Entities that head a block of a balance table.
BALANCE_ENTITIES = ["银行业金融机构", "商业银行合计", "大型商业银行", "股份制商业银行", "城市商业银行", "农村金融机构", "其他类金融机构", "其他类银行业金融机构"]
# Loan tables, dataset -> (metric code, metric name).
LOANS = {
    "inclusive_small_business_loans": ("inclusive_small_business_loan_balance", "普惠型小微企业贷款余额"),
    "inclusive_agricultural_loans": ("inclusive_agricultural_loan_balance", "普惠型涉农贷款余额"),
    "affordable_housing_loans": ("affordable_housing_loan_balance", "保障性安居工程贷款余额"),
}
# Solvency metrics, (words, code, name, group, unit, measure).
SOLVENCY = [
    ("综合偿付能力充足率", "comprehensive_solvency_adequacy_ratio", "综合偿付能力充足率", "偿付能力", "%", "ratio"),
    ("核心偿付能力充足率", "core_solvency_adequacy_ratio", "核心偿付能力充足率", "偿付能力", "%", "ratio"),
    ("风险综合评级", "risk_comprehensive_rating_company_count", "风险综合评级公司数量", "风险综合评级", "家", "count"),
]

_CODE_NAME = ((0, "code"), (1, "name"))


def _so_far():
    """A sheet's rows down to the present one."""
    return Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)


def _down(value: Column) -> Column:
    """The last non-null value so far in the sheet."""
    return F.last(value, ignorenulls=True).over(_so_far())


def _filled(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) != ""


def grid(cells: DataFrame, files: DataFrame, datasets: list[str]) -> DataFrame:
    """The filled cells, or those with a formula, of the chosen sheet of each file of some datasets, with the file's
    attributes and `key`, the label key of the value. The sheet is the first, by name, that holds the dataset's texts."""
    mine = files.filter(F.col("dataset").isin(*datasets))
    told = cells.join(mine.select("file", "dataset"), "file", "left_semi")
    chosen = None
    for texts in {tuple(SHEET_TEXTS[d]) for d in datasets}:
        with_texts = [d for d in datasets if tuple(SHEET_TEXTS[d]) == texts]
        part = sheets_with(told.join(mine.filter(F.col("dataset").isin(*with_texts)).select("file"), "file", "left_semi"), list(texts)).groupBy("file").agg(F.min("sheet").alias("sheet"))
        chosen = part if chosen is None else chosen.unionByName(part)
    x = told.filter(_filled(F.col("value")) | F.col("formula").isNotNull()).join(chosen, SHEET, "left_semi").join(mine, "file")
    return cut(x.withColumn("key", full_label_key(F.coalesce("value", F.lit("")))))


def _attributes(cells: DataFrame) -> DataFrame:
    """One row per sheet with its file's attributes and footnotes."""
    files = cells.select(*SHEET, "dataset", "year", "month", "source_format", "source_file_hash").distinct()
    notes = footnotes(cells.filter("col <= 10"), marks=("注", "备注", "说明"))
    return files.join(notes, SHEET, "left").withColumn("footnotes", F.coalesce("footnotes", F.lit("")))


def _before_notes(lines: DataFrame) -> DataFrame:
    """The lines of a sheet before its first note, told by the label in the first column."""
    note = F.max(F.coalesce(F.col("label_key").rlike("^(?:注|备注)"), F.lit(False))).over(_so_far())
    return lines.withColumn("_note", note).filter("not _note").drop("_note")


def _lines(cells: DataFrame, *columns: int) -> DataFrame:
    """(file, sheet, row, label, label_key) of the first column and, if asked for, (label2, key2) of the second: one row
    per row of the sheet that has any cell, blank labels null."""
    at = lambda c, v: F.max(F.when(F.col("col") == c, F.col(v)))
    more = [x for c in columns for x in (at(c, "value").alias(f"label{c}"), at(c, "key").alias(f"key{c}"))]
    return cells.groupBy(*SHEET, "row").agg(at(1, "value").alias("label"), at(1, "key").alias("label_key"), *more)


def _period_cells(cells: DataFrame, frequency: Column) -> DataFrame:
    """(file, sheet, header_row, col, period): cells right of the first column that name a period of the frequency."""
    x = cells.filter("col >= 2").withColumn("period", period_from_token(F.col("year"), squeezed(nfkc(F.col("value")))))
    return x.filter(F.col("period").isNotNull() & (F.col("period.frequency") == frequency)).select(*SHEET, F.col("row").alias("header_row"), "col", "period")


def assemble(body: DataFrame, attributes: DataFrame) -> DataFrame:
    """Facts of FACT columns. body: file, sheet, row, col, value, formula, format, period, entity (struct code, name),
    entity_raw, metric (struct code, name), metric_raw, metric_group, measure_type, unit, unit_raw, schema_version, scope,
    scope_version, period_basis, comparability_flag, release_id, divisor (null for none).

    Workbooks of the newer format store numbers: ratios are read as shown, others as stored; of the older format all
    are read as shown.
    """
    x = body.drop("dataset", "footnotes").join(attributes.select(*SHEET, "dataset", "source_format", "source_file_hash", "footnotes"), SHEET)
    stored = F.col("source_format") == "xlsx"
    x = with_shown(x.withColumn("_number", F.col("value").try_cast("decimal(38,18)")), "_number", "format", "_text")
    general = F.coalesce("format", F.lit("")) == ""
    as_is = ~stored | F.col("_number").isNull() | general | (F.lower(F.coalesce("format", F.lit(""))) == "general")
    x = x.withColumn("_shown", F.trim(F.when(as_is, F.coalesce("value", F.lit(""))).otherwise(F.col("_text"))))
    x = x.withColumn("_read", nfkc(F.when((F.col("unit") == "%") | ~stored, F.col("_shown")).otherwise(F.col("value"))))
    x = x.withColumn("_p", parsed_decimal(F.col("_read")))
    number = F.col("_number")
    divided = F.col("_p.value").isNotNull() & F.col("divisor").isNotNull()
    value = F.when(divided, F.bround(F.col("_p.value") / F.col("divisor"), 6)).otherwise(F.col("_p.value")).cast("decimal(38,6)")
    converted = F.when(divided, F.array(F.concat(F.lit("UNIT_CONVERTED_"), "unit_raw", F.lit("_TO_"), "unit"))).otherwise(F.array().cast("array<string>"))
    return x.select(
        F.col("dataset").alias("dataset_id"), "release_id", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), F.col("period.frequency").alias("frequency"), "period_basis", "scope",
        F.col("entity.code").alias("entity_code"), F.col("entity.name").alias("entity_name"), F.trim(F.coalesce("entity_raw", F.lit(""))).alias("entity_name_raw"),
        F.col("metric.code").alias("metric_code"), F.col("metric.name").alias("metric_name"), F.trim(F.coalesce("metric_raw", F.lit(""))).alias("metric_name_raw"), "metric_group", "measure_type",
        value.alias("value"), F.when(stored, number).alias("value_storage"), F.col("_shown").alias("value_display"), value.alias("value_decimal"), F.col("_shown").alias("value_raw"), F.col("_p.status").alias("value_status"),
        "unit", "unit_raw", "schema_version", "scope_version", "comparability_flag", F.col("file").alias("source_file"), "source_file_hash", "source_format", F.lit("local_attachment").alias("source_origin"),
        F.col("sheet").alias("source_sheet"), address(F.col("row"), F.col("col")).alias("source_cell"), F.col("formula").alias("formula_raw"), F.col("format").alias("number_format"),
        F.when(stored, "STORAGE").otherwise("DISPLAYED").alias("calculation_basis"), "footnotes", F.array_join(F.array_distinct(F.concat(F.col("_p.flags"), converted)), "|").alias("quality_flags"),
    )


def _body(lines: DataFrame, columns: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Lines and columns of a sheet, and the filled cells where they meet."""
    at = cells.filter(_filled(F.col("value"))).select(*SHEET, "row", "col", "value", "formula", "format")
    return lines.join(columns, [*SHEET, *by]).join(at, [*SHEET, "row", "col"])


def _shared(x: DataFrame, **columns) -> DataFrame:
    """x with constant or computed fact columns; text stands for itself."""
    fixed = {"divisor": F.lit(None).cast("decimal(10,0)"), "comparability_flag": F.lit(""), "release_id": F.col("year").cast("string")}
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    return x.withColumns({**fixed, **given})


def balances(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Assets and liabilities, monthly or quarterly: blocks headed by an entity, a header of periods in each, and rows of
    balance, growth and share; the latter two belong to the balance above them."""
    g = grid(cells, files, ["bank_balance_monthly", "bank_balance_quarterly"])
    about = _attributes(g)
    monthly = F.col("dataset") == "bank_balance_monthly"
    x = _lines(g).join(about.select(*SHEET, "dataset", "year"), SHEET)
    k = F.col("label_key")
    heads = k.isin(*BALANCE_ENTITIES)
    x = x.withColumns({
        "entity": _down(F.when(heads, F.struct(dims.lookup(dims.ENTITIES, k, *_CODE_NAME).alias("e"), F.col("label").alias("raw"), F.col("row").alias("at")))),
        "header_row": _down(F.when(k == "项目", F.col("row"))),
        "base": _down(F.when(k.isin("总资产", "总负债"), F.struct(F.when(k == "总资产", "total_assets").otherwise("total_liabilities").alias("code"), k.alias("name"), F.col("row").alias("at")))),
    })
    suffix = F.when(k.isin("总资产", "总负债"), F.struct(F.lit("").alias("code"), F.lit("").alias("name"), F.lit("balance").alias("measure"))).when(k == "比上年同期增长率", F.struct(F.lit("_yoy").alias("code"), k.alias("name"), F.lit("year_over_year").alias("measure"))).when(k == "占银行业金融机构比例", F.struct(F.lit("_industry_share").alias("code"), k.alias("name"), F.lit("industry_share").alias("measure")))
    x = x.withColumn("suffix", suffix).filter("suffix is not null and base.at > entity.at and header_row is not null")
    unit = F.when(F.col("suffix.measure") == "balance", "亿元").otherwise("%")
    lines = _shared(
        x.select(*SHEET, "row", "year", "dataset", "header_row", F.col("entity.e").alias("entity"), F.col("entity.raw").alias("entity_raw"), F.col("label").alias("metric_raw"), F.struct(F.concat("base.code", "suffix.code").alias("code"), F.concat("base.name", "suffix.name").alias("name")).alias("metric"), F.col("suffix.measure").alias("measure_type"), unit.alias("unit"), unit.alias("unit_raw")),
        metric_group="资产负债", schema_version=F.when(monthly, "BANK_BALANCE_MONTHLY_V1").otherwise("BANK_BALANCE_QUARTERLY_V1"), scope=F.when(monthly, "境内").otherwise("法人"), scope_version=F.when(monthly, "DOMESTIC").otherwise("LEGAL_ENTITY"),
        period_basis=F.when(monthly, "month_end").otherwise("quarter_end"), comparability_flag=F.when(F.col("year") >= 2023, "SCOPE_CHANGE_2023_WEALTH_MANAGEMENT_INCLUDED").otherwise(""),
    )
    return assemble(_body(lines, _period_cells(g, F.when(monthly, "month").otherwise("quarter")), g, ["header_row"]), about)


def _first_header(lines: DataFrame, columns: DataFrame, label: str | None, n: int | None = None) -> DataFrame:
    """(file, sheet, header_row): the first row with the label that has columns, or the first with exactly n columns."""
    per = columns.groupBy(*SHEET, "header_row").agg(F.count(F.lit(1)).alias("n"))
    if n is not None:
        per = per.filter(F.col("n") == n)
    if label is not None:
        per = per.join(lines.filter(F.col("label_key") == label).select(*SHEET, F.col("row").alias("header_row")), [*SHEET, "header_row"], "left_semi")
    return per.groupBy(*SHEET).agg(F.min("header_row").alias("header_row"))


def loans(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Loan tables: entities down, quarters across."""
    g = grid(cells, files, list(LOANS))
    about = _attributes(g)
    columns = _period_cells(g, F.lit("quarter"))
    all_lines = _lines(g)
    headers = _first_header(all_lines, columns, "项目")
    x = _before_notes(all_lines.join(headers, SHEET).filter("row > header_row")).withColumn("entity", dims.lookup(dims.ENTITIES, F.col("label_key"), *_CODE_NAME)).filter("entity is not null").join(about.select(*SHEET, "dataset", "year"), SHEET)
    metric = F.element_at(F.create_map(*(v for d, (c, n) in LOANS.items() for v in (F.lit(d), F.struct(F.lit(c).alias("code"), F.lit(n).alias("name"))))), F.col("dataset"))
    lines = _shared(
        x.select(*SHEET, "row", "year", "header_row", "entity", F.col("label").alias("entity_raw"), F.col("label").alias("metric_raw"), metric.alias("metric"), F.concat(F.upper("dataset"), F.lit("_V1")).alias("schema_version")),
        metric_group="政策性贷款", measure_type="balance", unit="亿元", unit_raw="亿元", scope="监管公布口径", scope_version="PUBLISHED_SCOPE", period_basis="quarter_end",
    )
    return assemble(_body(lines, columns, g, ["header_row"]), about)


def _regulatory(key: Column) -> Column:
    return dims.lookup(dims.REGULATORY_METRICS, key, *_CODE_NAME)


def _indicator_columns(x: DataFrame, version: str) -> DataFrame:
    """The columns that both indicator tables share; x has metric and year."""
    unit = metric_unit(F.col("metric.code"), F.col("metric.name"))
    return _shared(
        x, unit=unit, unit_raw=unit, measure_type="value", schema_version=F.when(F.col("year") >= 2024, f"{version}_V2").otherwise(f"{version}_V1"), scope="法人", scope_version="LEGAL_ENTITY",
        period_basis=F.when(F.col("metric.code") == "net_profit_ytd", "year_to_date").otherwise("quarter_end"),
        comparability_flag=F.when((F.col("year") >= 2024) & F.col("metric.code").isin(*dims.CAPITAL_METRICS), "CAPITAL_RULES_2024_BREAK").otherwise(""),
    )


def _by_type(cells: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, columns, grid, attributes) of indicators by type of institution; lines keep unknown metrics (null)."""
    g = grid(cells, files, ["commercial_bank_indicators_by_type"])
    about = _attributes(g)
    all_lines = _lines(g, 2)
    columns = g.filter("col >= 2").withColumn("entity", dims.lookup(dims.ENTITIES, F.col("key"), *_CODE_NAME)).filter("entity is not null").select(*SHEET, F.col("row").alias("header_row"), "col", "entity", F.col("value").alias("entity_raw"))
    headers = _first_header(all_lines, columns, "机构")
    x = _before_notes(all_lines.join(headers, SHEET).filter("row > header_row")).join(about.select(*SHEET, "year"), SHEET)
    x = x.withColumn("period", _down(period_from_token(F.col("year"), squeezed(nfkc(F.col("label")))))).filter("period is not null and label2 is not null")
    return x.withColumn("metric", _regulatory(F.col("key2"))).withColumnRenamed("label2", "metric_raw"), columns, g, about


def indicators_by_type(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Main indicators: institutions across, quarters (filled down) and metrics down."""
    x, columns, g, about = _by_type(cells, files)
    lines = _indicator_columns(x.filter("metric is not null"), "BANK_INDICATORS_BY_TYPE").withColumn("metric_group", F.lit("主要指标"))
    return assemble(_body(lines, columns, g, ["header_row"]), about)


def _groups(cells: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same for regulatory indicators, whose metrics stand under group rows."""
    g = grid(cells, files, ["commercial_bank_regulatory_indicators"])
    about = _attributes(g)
    columns = _period_cells(g, F.lit("quarter"))
    all_lines = _lines(g)
    headers = _first_header(all_lines, columns, "时间")
    x = _before_notes(all_lines.join(headers, SHEET).filter("row > header_row")).join(about.select(*SHEET, "year"), SHEET)
    plain = squeezed(nfkc(F.col("label")))
    is_group = plain.rlike(r"^\([一二三四五]\)")
    x = x.withColumns({"is_group": is_group, "metric_group": F.coalesce(_down(F.when(is_group, F.regexp_replace(F.regexp_replace(plain, r"^\([一二三四五]\)", ""), r"\*", ""))), F.lit(""))})
    return x.filter("not coalesce(is_group, false) and label is not null").withColumn("metric", _regulatory(F.col("label_key"))).withColumnRenamed("label", "metric_raw"), columns, g, about


def regulatory_indicators(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Regulatory indicators of all commercial banks: quarters across, metrics down, in groups."""
    x, columns, g, about = _groups(cells, files)
    lines = _indicator_columns(x.filter("metric is not null"), "BANK_REGULATORY_INDICATORS").withColumns({"entity": dims.lookup(dims.ENTITIES, F.lit("商业银行"), *_CODE_NAME), "entity_raw": F.lit("商业银行")})
    return assemble(_body(lines, columns, g, ["header_row"]), about)


def unknown_metrics(cells: DataFrame, files: DataFrame) -> DataFrame:
    """(file, sheet, row, label): lines of both indicator tables with values and a metric that isn't known."""
    out = None
    for part in (_by_type, _groups):
        x, columns, g, _ = part(cells, files)
        found = _body(x.filter("metric is null"), columns, g, ["header_row"]).select(*SHEET, "row", F.col("metric_raw").alias("label")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def solvency(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Solvency and risk ratings: a header of exactly four quarters, metrics filled down, entities in the second column."""
    g = grid(cells, files, ["insurance_solvency"])
    about = _attributes(g)
    columns = _period_cells(g, F.lit("quarter"))
    all_lines = _lines(g, 2)
    headers = _first_header(all_lines, columns, None, 4)
    x = _before_notes(all_lines.join(headers, SHEET).filter("row > header_row")).join(about.select(*SHEET, "year"), SHEET)
    told = F.coalesce(*(F.when(F.contains("label_key", F.lit(w)), F.struct(F.struct(F.lit(c).alias("code"), F.lit(n).alias("name")).alias("metric"), F.lit(grp).alias("grp"), F.lit(u).alias("unit"), F.lit(m).alias("measure"))) for w, c, n, grp, u, m in SOLVENCY))
    x = x.withColumns({"m": _down(told), "entity": dims.lookup(dims.ENTITIES, F.col("key2"), *_CODE_NAME)}).filter("m is not null and entity is not null")
    lines = _shared(
        x.select(*SHEET, "row", "year", "header_row", "entity", F.col("label2").alias("entity_raw"), F.col("label").alias("metric_raw"), "m.metric", F.col("m.grp").alias("metric_group"), "m.unit", F.col("m.unit").alias("unit_raw"), F.col("m.measure").alias("measure_type")),
        schema_version=F.when(F.col("year") >= 2025, "INSURANCE_SOLVENCY_V2").otherwise("INSURANCE_SOLVENCY_V1"), scope=F.when(F.col("year") <= 2022, "法人").otherwise("监管公布口径"), scope_version="PUBLISHED_AGGREGATE",
        period_basis="quarter_end", comparability_flag=F.when(F.col("year") >= 2025, "RISK_RATING_NOT_PUBLISHED_2025").otherwise(""),
    )
    return assemble(_body(lines, columns, g, ["header_row"]), about)


def funds(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Placement of insurance funds in one quarter, told by the file name: balance, share and growth columns, and yields.

    The newer layout, told by its header, has entities in the first and metrics in the second column; the older one has
    both in the first, life and property insurers heading their blocks. One quarter's balances are in 万元.
    """
    g = grid(cells, files, ["insurance_funds_investment"])
    about = _attributes(g)
    x = _before_notes(_lines(g, 2)).join(about.select(*SHEET, "year", "footnotes"), SHEET)
    newer = x.filter((F.col("label_key") == "机构类别/指标") & (F.col("row") < 10)).select(*SHEET).distinct().withColumn("new", F.lit(True))
    x = x.join(newer, SHEET, "left").withColumn("new", F.coalesce("new", F.lit(False)))
    entity = dims.lookup(dims.ENTITIES, F.col("label_key"), *_CODE_NAME)
    heads = entity.isNotNull() & (F.col("new") | F.col("label_key").isin("人身险公司", "财产险公司", "财产保险公司"))
    all_ = F.struct(dims.lookup(dims.ENTITIES, F.lit("保险公司"), *_CODE_NAME).alias("e"), F.lit("保险公司").alias("raw"))
    x = x.withColumns({"now": F.coalesce(_down(F.when(heads, F.struct(entity.alias("e"), F.col("label").alias("raw")))), all_), "heads": heads})
    x = x.filter("new or not heads").withColumns({"metric_raw": F.when(F.col("new"), F.col("label2")).otherwise(F.col("label")), "mk": F.when(F.col("new"), F.col("key2")).otherwise(F.col("label_key"))})
    x = x.withColumns({"base": dims.lookup(dims.FUND_BASES, F.col("mk"), *_CODE_NAME), "yields": dims.lookup(dims.FUND_YIELDS, F.col("mk"), *_CODE_NAME), "q": quarter_from_filename(F.col("year"), nfkc(F.col("file")))}).filter("q is not null")
    wan = (F.col("year") == 2023) & (F.col("q.quarter") == 1)
    first = F.when(F.col("new"), 3).otherwise(2)
    kind = lambda at, code, name, unit, raw, measure, divisor: F.struct(at.alias("col"), F.struct(F.concat("base.code", F.lit(code)).alias("code"), F.concat("base.name", F.lit(name)).alias("name")).alias("metric"), F.lit("资金运用").alias("metric_group"), F.lit(unit).alias("unit"), raw.alias("unit_raw"), F.lit(measure).alias("measure_type"), F.lit("quarter_end").alias("period_basis"), divisor.alias("divisor"))
    none = F.lit(None).cast("decimal(10,0)")
    wanted = F.when(F.col("yields").isNotNull(), F.array(F.struct(first.alias("col"), F.col("yields").alias("metric"), F.lit("资金运用收益").alias("metric_group"), F.lit("%").alias("unit"), F.lit("%").alias("unit_raw"), F.lit("annualized_rate").alias("measure_type"), F.lit("year_to_date_annualized").alias("period_basis"), none.alias("divisor")))).when(
        F.col("base").isNotNull(),
        F.array(kind(first, "_balance", "余额", "亿元", F.when(wan, "万元").otherwise("亿元"), "balance", F.when(wan, F.lit(10000).cast("decimal(10,0)"))), kind(first + 1, "_share", "占比", "%", F.lit("%"), "share", none), kind(first + 2, "_yoy", "同比增长", "%", F.lit("%"), "yoy", none)),
    )
    notes = F.col("footnotes")
    flags = F.array_compact(F.array(F.when(notes.rlike("风险处置|不含明天系"), "RISK_DISPOSAL_SCOPE_EXCLUSION"), F.when(F.col("year") >= 2025, "YOY_AND_YIELDS_NOT_PUBLISHED_2025"), F.when(F.contains(notes, F.lit("口径不可比")), "ACCOUNTING_ADJUSTMENT_NOT_COMPARABLE")))
    x = x.select(
        *SHEET, "row", F.explode(wanted).alias("w"), F.struct(F.col("q.start").alias("start"), F.col("q.end").alias("end"), F.lit("quarter").alias("frequency")).alias("period"), F.col("now.e").alias("entity"), F.col("now.raw").alias("entity_raw"), "metric_raw", F.array_join(flags, "|").alias("comparability_flag"),
        F.when(F.col("year") >= 2025, "INSURANCE_FUNDS_V3").when(F.col("new"), "INSURANCE_FUNDS_V2").otherwise("INSURANCE_FUNDS_V1").alias("schema_version"), F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("q.quarter").cast("string")).alias("release_id"),
    ).select("*", "w.*").drop("w").withColumns({"scope": F.lit("境内"), "scope_version": F.lit("PUBLISHED_SCOPE")})
    at = g.filter(_filled(F.col("value"))).select(*SHEET, "row", "col", "value", "formula", "format")
    return assemble(x.join(at, [*SHEET, "row", "col"]), about)


# Header labels of the three dictionary tables.
DICTIONARIES = {
    "schedule": ["频度", "信息发布时间", "机构范围", "数据范围", "指标名称"],
    "definitions": ["序号", "指标名称", "指标范围及计算公式"],
    "scopes": ["序号", "机构类", "机构范围"],
}


def dictionary(cells: DataFrame, files: DataFrame, table: str) -> DataFrame:
    """One of the tables of a release schedule: the first row of a file that holds all labels is the header, wherever
    each label stands. schedule fills frequency and timing down to the first note; definitions end where the next table
    begins; both numbered tables keep rows with a whole number."""
    need = DICTIONARIES[table]
    mine = files.filter(F.col("dataset") == "regulatory_release_schedule").select("file", "year", "source_file_hash")
    x = cut(cells.filter(_filled(F.col("value"))).join(mine, "file").withColumn("plain", squeezed(nfkc(F.col("value")))))
    at = [F.min(F.when(F.col("plain") == n, F.col("col"))).alias(f"c{i}") for i, n in enumerate(need)]
    heads = x.groupBy("file", "sheet", "row").agg(*at)
    for i in range(len(need)):
        heads = heads.filter(f"c{i} is not null")
    heads = heads.groupBy("file").agg(F.min(F.struct("sheet", F.col("row").alias("header_row"), *(f"c{i}" for i in range(len(need))))).alias("h")).select("file", "h.*")
    under = x.join(heads, SHEET).filter("row > header_row")
    cell = lambda i: F.max(F.when(F.col("col") == F.col(f"c{i}"), F.trim("value")))
    lines = under.groupBy(*SHEET, "row", "header_row", "year", "source_file_hash", *(f"c{i}" for i in range(len(need)))).agg(*(cell(i).alias(f"v{i}") for i in range(len(need))), (F.bool_or(F.col("plain") == "机构类") & F.bool_or(F.col("plain") == "机构范围")).alias("next_table"))
    source = [F.col("file").alias("source_file"), "source_file_hash", F.col("sheet").alias("source_sheet")]
    if table == "schedule":
        ended = F.max(F.coalesce(squeezed(F.col("v0")).rlike("^(?:注|备注)"), F.lit(False))).over(_so_far())
        notes = footnotes(x.filter("col <= 10"), marks=("注", "备注", "说明"))
        y = lines.withColumn("ended", ended).filter("not ended").withColumns({"frequency": _down(F.col("v0")), "release_timing": _down(F.col("v1"))}).filter("v4 is not null").join(notes, SHEET, "left")
        blank = lambda c: F.coalesce(c, F.lit(""))
        return y.select(F.col("year").alias("release_year"), (F.col("row") - F.col("header_row")).alias("row_order"), blank("frequency").alias("frequency"), blank("release_timing").alias("release_timing"), blank("v2").alias("institution_scope"), blank("v3").alias("data_scope"), F.col("v4").alias("indicator_names"), blank("footnotes").alias("notes"), *source, address(F.col("row"), F.col("c4")).alias("source_cell"))
    y = lines
    if table == "definitions":
        y = y.withColumn("ended", F.max("next_table").over(_so_far())).filter("not ended")
    y = y.withColumn("sequence", F.regexp_replace("v0", r"\.0+$", "").try_cast("int")).filter("sequence is not null and v1 is not null and v2 is not null")
    names = ("metric_name", "definition") if table == "definitions" else ("institution_type", "scope_definition")
    return y.select(F.col("year").alias("release_year"), "sequence", F.col("v1").alias(names[0]), F.col("v2").alias(names[1]), *source, address(F.col("row"), F.col("c1")).alias("source_cell"))


# Monthly tables of the industry, dataset -> (entity code, entity name, metrics, product lines).
MONTHLY = {
    "life_insurance_monthly": ("CN_LIFE_INSURANCE_INDUSTRY_TOTAL", "全国人身险行业汇总", dims.LIFE_METRICS, dims.LIFE_PRODUCTS),
    "property_insurance_monthly": ("CN_PROPERTY_INSURANCE_INDUSTRY_TOTAL", "全国财产险行业汇总", dims.PROPERTY_METRICS, dims.PROPERTY_PRODUCTS),
    "insurance_industry_monthly": ("CN_INSURANCE_INDUSTRY_TOTAL", "全国保险业汇总", dims.INDUSTRY_METRICS, dims.INDUSTRY_PRODUCTS),
}


def _monthly_lines(cells: DataFrame, files: DataFrame, dataset: str) -> DataFrame:
    """Per row of a monthly table up to its notes: the first known label (a metric before a product line), the first
    number or formula to its right, how many numbers the row has, and the metric that it stands under."""
    _, _, metrics, products = MONTHLY[dataset]
    mine = files.filter(F.col("dataset") == dataset).select("file", "year", "month", "source_format", "source_file_hash")
    x = cells.filter(_filled(F.col("value")) | F.col("formula").isNotNull()).join(mine, "file").withColumn("key", full_label_key(F.coalesce("value", F.lit(""))))
    number = premium_decimal(nfkc(F.col("value")))
    metric = dims.lookup(metrics, F.col("key"), (0, "code"), (1, "name"), (2, "unit"), (3, "basis"), (4, "order"))
    product = dims.lookup(products, F.col("key"), (0, "code"), (1, "name"), (2, "order"))
    x = cut(x.withColumns({"n": number, "metric": metric, "product": product, "is_note": F.col("key").startswith("注")}))
    entry = F.struct("col", F.col("metric").alias("metric"), F.when(F.col("metric").isNull(), F.col("product")).alias("product"), F.col("value").alias("label"))
    label = F.min_by(F.when(F.col("metric").isNotNull() | F.col("product").isNotNull(), entry), F.when(F.col("metric").isNotNull() | F.col("product").isNotNull(), F.col("col")))
    told = F.collect_list(F.when(F.col("n.value").isNotNull() | F.col("formula").isNotNull(), F.struct("col", F.col("n.value").alias("value"), F.col("n.flag").alias("flag"), "formula", "format")))
    rows = x.groupBy(*SHEET, "row", "year", "month", "source_format", "source_file_hash").agg(label.alias("l"), F.array_sort(told).alias("v"), F.bool_or("is_note").alias("note"), F.count("n.value").alias("n_numbers"))
    known = rows.filter("l.metric is not null").groupBy(*SHEET).agg(F.min("row").alias("first_row"))
    rows = rows.join(known, SHEET).filter("row >= first_row").withColumn("ended", F.max("note").over(_so_far())).filter("not ended")
    rows = rows.withColumn("v", F.try_element_at(F.filter("v", lambda c: c["col"] > F.col("l.col")), F.lit(1)))
    return rows.withColumn("parent", _down(F.when(F.col("l.metric").isNotNull(), F.struct(F.col("l.metric").alias("metric"), F.col("l.label").alias("label"), F.col("row").alias("at")))))


def monthly(cells: DataFrame, files: DataFrame, dataset: str) -> DataFrame:
    """Facts of a monthly table: each metric, and its product lines below it; the first number right of a label is its
    value. A product line without a metric above it gives none (unknown_lines lists it)."""
    code, name, _, _ = MONTHLY[dataset]
    x = _monthly_lines(cells, files, dataset).filter("l is not null and parent is not null")
    end = F.last_day(F.make_date(F.col("year"), F.col("month"), F.lit(1)))
    m, p, is_all = F.col("parent.metric"), F.col("l.product"), F.col("l.metric").isNotNull()
    missing = F.col("v.formula").isNotNull() & F.col("v.value").isNull()
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("v").isNull(), "NON_NUMERIC_VALUE").otherwise(F.when(F.col("v.flag") != "PRECISION_ROUNDED_6DP", F.col("v.flag"))), F.when(missing, "FORMULA_CACHE_MISSING"))), "|")
    line = F.when(is_all, "all").otherwise(p["code"])
    return x.select(
        F.date_format(end, "yyyy-MM").alias("release_id"), F.when(m["basis"] == "POINT_IN_TIME", end).otherwise(F.make_date(F.col("year"), F.lit(1), F.lit(1))).alias("period_start"), end.alias("period_end"), m["basis"].alias("period_basis"),
        F.lit(code).alias("entity_code"), F.lit(name).alias("entity_name"), F.lit("industry_aggregate").alias("entity_type"), m["code"].alias("metric_code"), m["name"].alias("metric_name"), F.col("parent.label").alias("metric_name_raw"), m["order"].alias("metric_order"),
        F.when(~is_all, m["code"]).alias("parent_metric_code"), line.alias("product_line"), F.when(is_all, "合计").otherwise(p["name"]).alias("product_line_name"), F.when(is_all, "").otherwise(F.col("l.label")).alias("product_line_raw"), F.when(is_all, 0).otherwise(p["order"]).alias("product_order"),
        F.concat(m["code"], F.lit("."), line).alias("metric_path"), F.col("v.value").alias("value"), F.when(F.col("v.value").isNull(), "missing").when(F.col("v.value") == 0, "reported_zero").otherwise("reported").alias("value_status"), m["unit"].alias("unit"),
        F.col("file").alias("source_file"), "source_file_hash", "source_format", F.col("sheet").alias("source_sheet"), address(F.col("row"), F.coalesce("v.col", F.col("l.col") + 1)).alias("source_cell"), F.col("v.formula").alias("formula_raw"), F.col("v.format").alias("number_format"), flags.alias("quality_flags"),
    )


def unknown_lines(cells: DataFrame, files: DataFrame, dataset: str) -> DataFrame:
    """(file, sheet, row, problem): numbers without a known label, and product lines without a metric above them."""
    x = _monthly_lines(cells, files, dataset)
    problem = F.when(F.col("l").isNull() & (F.col("n_numbers") > 0), "unknown_label").when(F.col("l").isNotNull() & F.col("parent").isNull(), "no_parent_metric")
    return x.select(*SHEET, "row", problem.alias("problem")).filter("problem is not null")


def versions(facts: DataFrame, dataset: str) -> DataFrame:
    """(source_file, schema_version): the version of a monthly table by the labels, metrics and lines that it holds; the
    first rule that holds."""
    has = lambda c, v: F.bool_or(F.col(c) == v)
    raw = lambda v: F.bool_or((F.col("product_line") == "all") & (F.regexp_replace("metric_name_raw", r"\s", "") == v))
    old = raw("资产总额") | raw("原保险赔款支出" if dataset == "property_insurance_monthly" else "原保险赔付支出")
    rules = {
        "life_insurance_monthly": F.when(raw("赔款与给付支出"), "S5_2026_ACCOUNTING").when(has("metric_code", "new_policy_count"), "S3_2023_AGGREGATED").when(has("metric_code", "new_sum_insured"), "S4_2024_2025_NO_POLICY_COUNT").when(old, "S1_LEGACY_LABELS").otherwise("S2_MODERN_LABELS"),
        "property_insurance_monthly": F.when(F.max("release_id") >= "2026-01", "S5_2026_ACCOUNTING").when(~has("metric_code", "policy_count"), "S4_NO_POLICY_COUNT").when(~F.bool_or(F.col("product_line").isin("enterprise_property", "household_property", "engineering")), "S3_REDUCED_BREAKDOWNS").when(old, "S1_LEGACY_LABELS").otherwise("S2_MODERN_LABELS"),
        "insurance_industry_monthly": F.when(F.bool_or((F.col("metric_code") == "claims_paid") & (F.col("product_line") == "all") & (F.regexp_replace("metric_name_raw", r"\s", "") == "赔款与给付支出")), "S5_2026_ACCOUNTING").when(has("product_line", "property_insurance_company") & has("product_line", "personal_insurance_company"), "S4_2025_ASSET_BREAKDOWN").when(~has("metric_code", "funds_employed_balance"), "S3_2024_NO_INVESTMENTS").when(~has("metric_code", "sum_insured"), "S2_2023_REDUCED").otherwise("S1_FULL_DETAILS"),
    }
    return facts.groupBy("source_file").agg(rules[dataset].alias("schema_version"))


def stated_scope(year: Column, month: Column, notes: Column, binary: Column | None = None) -> Column:
    """The scope version of a life table: before June 2021, with or without a stated exclusion of companies under risk
    disposal, in the notes or in any usual encoding within the file's bytes."""
    words = ["不包含", "暂不包含", "不包括", "暂不包括"]
    says = lambda w: F.contains(F.coalesce(notes, F.lit("")), F.lit(w))
    told = says("风险处置") & F.array_contains(F.array(*(says(w) for w in words)), True)
    if binary is not None:
        inside = lambda w: binary_contains(binary, w)
        told = told | (inside("风险处置") & F.array_contains(F.array(*(inside(w) for w in words)), True))
    return F.when((year < 2021) | ((year == 2021) & (month < 6)), "PRE_2021_06").when(told, "DISCLOSED_RISK_DISPOSAL_EXCLUSION").otherwise("UNSTATED")


def binary_contains(data: Column, phrase: str) -> Column:
    """Whether bytes hold a phrase in UTF-16 of either order, UTF-8 or GB18030; null bytes hold none."""
    found = [F.contains(data, F.lit(phrase.encode(e))) for e in ("utf-16le", "utf-16be", "utf-8", "gb18030")]
    return F.coalesce(found[0] | found[1] | found[2] | found[3], F.lit(False))


def accounting_basis(notes: Column, schema_version: Column) -> Column:
    """2026 where the notes name the accounting standard of financial instruments or the schema is that of 2026."""
    return F.when(F.contains(F.coalesce(notes, F.lit("")), F.lit("金融工具会计准则")) | (schema_version == "S5_2026_ACCOUNTING"), "2026_FINANCIAL_INSTRUMENTS").otherwise("2009_INSURANCE_ACCOUNTING")


#: Which parser reads a dataset; those in NO_FACTS have none by design.
PARSERS = {
    "bank_balance_monthly": balances, "bank_balance_quarterly": balances, **dict.fromkeys(LOANS, loans), "commercial_bank_indicators_by_type": indicators_by_type,
    "commercial_bank_regulatory_indicators": regulatory_indicators, "insurance_solvency": solvency, "insurance_funds_investment": funds,
}
NO_FACTS = {"regulatory_release_schedule", "excel_template_library", "excel_reference_documents"}


def extract(cells: DataFrame, files: DataFrame, datasets: list[str]) -> DataFrame:
    """The regulatory facts of some datasets, each by its parser; a dataset without a parser is an error, one that
    yields no facts by design gives none."""
    unknown = set(datasets) - set(PARSERS) - NO_FACTS
    if unknown:
        raise ValueError(f"no parser for {sorted(unknown)}")
    parsers = list(dict.fromkeys(PARSERS[d] for d in datasets if d in PARSERS))
    mine = files.filter(F.col("dataset").isin(*datasets))
    out = None
    for parse in parsers:
        part = parse(cells, mine)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else cells.sparkSession.createDataFrame([], "source_file string")


def unified(facts: DataFrame, schema_version: str = "1") -> DataFrame:
    """Cleaner facts as facts of the store: raw value by preference (value_raw, value_display, value), the product line
    appended to entity code and name, flags as a list, review where a value or its formula's cache is missing."""
    have = set(facts.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    some = lambda *c: F.coalesce(*(F.nullif(F.trim(col(x)), F.lit("")) for x in c))
    line = F.nullif(col("product_line"), F.lit("all"))
    joined = lambda base, sep, more: F.when(line.isNotNull() & more.isNotNull(), F.concat(base, F.lit(sep), more)).otherwise(base)
    flags = F.filter(F.split(F.coalesce(col("quality_flags"), F.lit("")), r"\|"), lambda f: f != "")
    missing = F.array_contains(flags, "FORMULA_CACHE_MISSING")
    review = missing | col("value").isNull()
    return facts.select(
        F.lit(schema_version).alias("schema_version"), col("source_file_hash").alias("source_id"), col("dataset_id").alias("table_id"), col("metric_code").alias("metric_code"), col("metric_name").alias("metric_name"),
        joined(col("entity_code"), ":", line).alias("entity_code"), joined(col("entity_name"), "/", some("product_line_name")).alias("entity_name"), F.col("period_start"), F.col("period_end"), col("period_basis").alias("period_basis"),
        some("value_raw", "value_display", "value").alias("raw_value"), F.regexp_replace(F.regexp_replace(col("value"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "").alias("normalized_value"), col("unit").alias("unit"), col("scope").alias("statistical_scope"),
        col("formula_raw").isNotNull().alias("is_formula"), col("formula_raw").alias("formula"), F.when(col("formula_raw").isNull(), "not_formula").when(missing, "missing").otherwise("cached").alias("formula_cache_status"),
        col("source_sheet").alias("sheet_name"), col("source_cell").alias("cell_range"), F.when(review, "needs_review").when(F.size(flags) > 0, "warning").otherwise("passed").alias("quality_status"), flags.alias("quality_flags"), review.alias("requires_manual_review"),
    )
