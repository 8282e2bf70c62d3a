"""Queries of the workbook parsers. The test folders hold no workbooks, so each query lays out the sums of orders as the
sheets of yearly or monthly files, parses the sheets, and must give the sums back; its SQL takes them from the orders.

Five order priorities stand for entities or lines, quarters or months for the header of periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.catalog import query
from veriloom.operators import dims, quality, workbooks
from veriloom.operators.tables import premium_facts
from veriloom.session import cut, table

_K = "cast(substr(o_orderpriority, 1, 1) as integer)"
_SUMS = f"s as (select cast(year(o_orderdate) as integer) y, cast(quarter(o_orderdate) as integer) q, {_K} k, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,6)) v from orders group by 1, 2, 3)"
_END = "cast(last_day(make_date(y, q * 3, 1)) as date)"
_NAMES = ["商业银行合计", "大型商业银行", "股份制商业银行", "城市商业银行", "农村金融机构"]
_CODES = ["commercial_banks", "large_commercial_banks", "joint_stock_commercial_banks", "city_commercial_banks", "rural_financial_institutions"]


def _sums(spark: SparkSession, d: str) -> DataFrame:
    """(y, q, k, v): sums of orders by year, quarter and priority."""
    o = table(spark, d, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    return cut(o.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.substring("o_orderpriority", 1, 1).cast("int").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v")))


def _one_of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int"))


def _quarter(q: Column) -> Column:
    return _one_of(["一季度", "二季度", "三季度", "四季度"], q)


def _sheet(*parts: DataFrame) -> DataFrame:
    """Cells out of parts (y, row, col, value)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    none = F.lit(None).cast("string")
    return out.select(F.col("y").cast("string").alias("file"), F.lit("S").alias("sheet"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("string").alias("value"), none.alias("formula"), none.alias("format"))


def _files(sums: DataFrame, dataset: str, month: int = 12) -> DataFrame:
    return sums.select("y").distinct().select(F.col("y").cast("string").alias("file"), F.lit(dataset).alias("dataset"), F.col("y").alias("year"), F.lit(month).alias("month"), F.lit("xls").alias("source_format"), F.sha2(F.col("y").cast("string"), 256).alias("source_file_hash"))


def _at(sums: DataFrame, row: Column | int, col: Column | int, value: Column | str, keys: list[str] = ["y"]) -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return sums.select(*keys).distinct().select("y", c(row).cast("int").alias("row"), c(col).cast("int").alias("col"), c(value).cast("string").alias("value"))


def _body(s: DataFrame, row: Column, col: Column, value: Column | None = None) -> DataFrame:
    return s.select("y", row.cast("int").alias("row"), col.cast("int").alias("col"), (F.col("v") if value is None else value).cast("string").alias("value"))


_SHOWN = ["period_end", "entity_code", "metric_code", "value", "unit", "schema_version", "period_basis", "source_cell"]
_LETTER = "chr(cast(65 + {} as integer))"
_CODE_SQL = f"[{', '.join(repr(c) for c in _CODES)}][k]"


@query(f"with {_SUMS} select {_END} period_end, {_CODE_SQL} entity_code, 'total_assets' metric_code, v \"value\", '亿元' unit, 'BANK_BALANCE_QUARTERLY_V1' schema_version, 'quarter_end' period_basis, {_LETTER.format('q')} || (k * 10 + 2) source_cell from s union all select {_END}, {_CODE_SQL}, 'total_assets_yoy', k, '%', 'BANK_BALANCE_QUARTERLY_V1', 'quarter_end', {_LETTER.format('q')} || (k * 10 + 3) from s")
def tab_balances(spark, d):
    s = _sums(spark, d)
    k, q = F.col("k"), F.col("q")
    cells = _sheet(
        _at(s, 1, 1, "总资产、总负债"), _at(s, k * 10, 1, _one_of(_NAMES, k), ["y", "k"]), _at(s, k * 10 + 1, 1, "项 目", ["y", "k"]), _at(s, k * 10 + 1, q + 1, _quarter(q), ["y", "k", "q"]),
        _at(s, k * 10 + 2, 1, "其中：总资产*", ["y", "k"]), _at(s, k * 10 + 3, 1, "比上年同期增长率", ["y", "k"]), _body(s, k * 10 + 2, q + 1), _body(s, k * 10 + 3, q + 1, k.cast("decimal(18,2)")),
    )
    return workbooks.balances(cells, _files(s, "bank_balance_quarterly")).select(*_SHOWN)


@query(f"with {_SUMS} select {_END} period_end, {_CODE_SQL} entity_code, 'affordable_housing_loan_balance' metric_code, v \"value\", '亿元' unit, 'AFFORDABLE_HOUSING_LOANS_V1' schema_version, 'quarter_end' period_basis, {_LETTER.format('q')} || (k + 2) source_cell from s")
def tab_loans(spark, d):
    s = _sums(spark, d)
    k, q = F.col("k"), F.col("q")
    cells = _sheet(_at(s, 1, 1, "保障性安居工程贷款情况"), _at(s, 2, 1, "项目"), _at(s, 2, q + 1, F.concat(_quarter(q), F.lit("末")), ["y", "q"]), _at(s, k + 2, 1, _one_of(_NAMES, k), ["y", "k"]), _body(s, k + 2, q + 1), _at(s, 8, 1, "注：大型商业银行"), _at(s, 9, 1, "大型商业银行"), _at(s, 9, 2, "1"))
    return workbooks.loans(cells, _files(s, "affordable_housing_loans")).select(*_SHOWN)


@query(f"with {_SUMS} select {_END} period_end, {_CODE_SQL} entity_code, 'nonperforming_loan_balance' metric_code, v \"value\", '亿元' unit, 'BANK_INDICATORS_BY_TYPE_V1' schema_version, 'quarter_end' period_basis, {_LETTER.format('k + 1')} || (q * 2 + 2) source_cell from s union all select {_END}, {_CODE_SQL}, 'net_profit_ytd', k, '亿元', 'BANK_INDICATORS_BY_TYPE_V1', 'year_to_date', {_LETTER.format('k + 1')} || (q * 2 + 3) from s")
def tab_indicators_by_type(spark, d):
    s = _sums(spark, d)
    k, q = F.col("k"), F.col("q")
    cells = _sheet(
        _at(s, 1, 1, "时间/指标"), _at(s, 2, 1, "机构"), _at(s, 2, k + 2, _one_of(_NAMES, k), ["y", "k"]), _at(s, q * 2 + 2, 1, _quarter(q), ["y", "q"]), _at(s, q * 2 + 2, 2, "不良贷款余额", ["y", "q"]), _at(s, q * 2 + 3, 2, "净利润", ["y", "q"]),
        _body(s, q * 2 + 2, k + 2), _body(s, q * 2 + 3, k + 2, k.cast("decimal(18,2)")),
    )
    return workbooks.indicators_by_type(cells, _files(s, "commercial_bank_indicators_by_type")).select(*_SHOWN)


_METRICS5 = [("不良贷款余额", "nonperforming_loan_balance"), ("次级类贷款", "substandard_loan_balance"), ("可疑类贷款", "doubtful_loan_balance"), ("损失类贷款", "loss_loan_balance"), ("资本充足率", "capital_adequacy_ratio")]


def _regulatory(spark, d):
    s = _sums(spark, d)
    k, q = F.col("k"), F.col("q")
    cells = _sheet(
        _at(s, 1, 1, "时间"), _at(s, 1, q + 1, _quarter(q), ["y", "q"]), _at(s, 2, 1, "（一）信用风险指标"), _at(s, 2 + k, 1, _one_of([m for m, _ in _METRICS5], k), ["y", "k"]), _body(s, 2 + k, q + 1),
    )
    return workbooks.regulatory_indicators(cells, _files(s, "commercial_bank_regulatory_indicators"))


_M5 = f"[{', '.join(repr(c) for _, c in _METRICS5)}][k]"


@query(f"with {_SUMS} select {_END} period_end, 'commercial_banks' entity_code, {_M5} metric_code, v \"value\", case when k = 5 then '%' else '亿元' end unit, 'BANK_REGULATORY_INDICATORS_V1' schema_version, 'quarter_end' period_basis, {_LETTER.format('q')} || (k + 2) source_cell, '信用风险指标' metric_group from s")
def tab_regulatory_indicators(spark, d):
    return _regulatory(spark, d).select(*_SHOWN, "metric_group")


@query(f"with {_SUMS}, w as (select y, q, max(case when k = 1 then v end) npl, sum(case when k in (2, 3, 4) then v end) parts, count(case when k between 1 and 4 then 1 end) n from s group by 1, 2) select {_END} period_end, 'commercial_banks' entity_code, npl, parts, abs(npl - parts) gap from w where n = 4 and abs(npl - parts) > 0.02")
def dq_npl_identity(spark, d):
    x = quality.npl_identity(cut(_regulatory(spark, d)))
    return x.select("period_end", "entity_code", *(F.col(c).cast("decimal(38,6)").alias(c) for c in ("npl", "parts", "gap")))


_SOLVENT = ["保险公司", "财产险公司", "人身险公司", "再保险公司"]
_SOLVENT_CODES = "['insurance_companies', 'property_insurers', 'life_insurers', 'reinsurers'][k]"


def _solvency(spark, d):
    s = _sums(spark, d).filter("k <= 4")
    k, q = F.col("k"), F.col("q")
    cells = _sheet(
        _at(s, 1, 1, "指标"), _at(s, 1, q + 2, _quarter(q), ["y", "q"]), _at(s, 2, 1, "综合偿付能力充足率"), _at(s, 6, 1, "核心偿付能力充足率"), _at(s, k + 1, 2, _one_of(_SOLVENT, k), ["y", "k"]), _at(s, k + 5, 2, _one_of(_SOLVENT, k), ["y", "k"]),
        _body(s, k + 1, q + 2), _body(s, k + 5, q + 2, F.col("v") + (k - 2)),
    )
    return workbooks.solvency(cells, _files(s, "insurance_solvency"))


_FULL = "full_years as (select y from s group by 1 having count(distinct q) = 4)"


@query(f"with {_SUMS}, {_FULL}, x as (select * from s where k <= 4 and y in (select y from full_years)) select {_END} period_end, {_SOLVENT_CODES} entity_code, 'comprehensive_solvency_adequacy_ratio' metric_code, v \"value\", '%' unit, 'INSURANCE_SOLVENCY_V1' schema_version, 'quarter_end' period_basis, {_LETTER.format('q + 1')} || (k + 1) source_cell from x union all select {_END}, {_SOLVENT_CODES}, 'core_solvency_adequacy_ratio', v + (k - 2), '%', 'INSURANCE_SOLVENCY_V1', 'quarter_end', {_LETTER.format('q + 1')} || (k + 5) from x")
def tab_solvency(spark, d):
    return _solvency(spark, d).select(*_SHOWN)


@query(f"with {_SUMS}, {_FULL} select {_END} period_end, {_SOLVENT_CODES} entity_code, cast(v + (k - 2) as decimal(38,6)) small_value, v large_value from s where k in (3, 4) and y in (select y from full_years)")
def dq_solvency_order(spark, d):
    x = _solvency(spark, d)
    return quality.part_exceeds(x, ["period_end", "entity_code"], "metric_code", "core_solvency_adequacy_ratio", "comprehensive_solvency_adequacy_ratio", "value")


@query(f"with {_SUMS}, w as (select y, k, sum(v) v from s group by 1, 2) select cast(make_date(y, 3, 31) as date) period_end, ['insurance_companies', 'insurance_companies', 'life_insurers', 'life_insurers', 'life_insurers'][k] entity_code, ['funds_investment_balance', 'annualized_financial_investment_yield', 'bank_deposit_balance', 'bonds_balance', 'stocks_balance'][k] metric_code, v \"value\", case when k = 2 then '%' else '亿元' end unit, 'INSURANCE_FUNDS_V1' schema_version, case when k = 2 then 'year_to_date_annualized' else 'quarter_end' end period_basis, 'B' || (case when k <= 2 then k + 1 else k + 2 end) source_cell from w")
def tab_funds(spark, d):
    s = _sums(spark, d).groupBy("y", "k").agg(F.sum("v").alias("v"))
    k = F.col("k")
    row = F.when(k <= 2, k + 1).otherwise(k + 2)
    cells = _sheet(_at(s, 1, 1, "资金运用余额表"), _at(s, row, 1, _one_of(["资金运用余额", "年化财务收益率", "银行存款", "债券", "股票"], k), ["y", "k"]), _at(s, 4, 1, "人身险公司"), _body(s, row, F.lit(2)))
    name = F.concat("file", F.lit("_一季度"))
    return workbooks.funds(cells.withColumn("file", name), _files(s, "insurance_funds_investment").withColumn("file", name)).select(*_SHOWN)


def _monthly(spark, d, dataset, labels):
    """Files of one month each: the sums of a year by priority, in labelled rows."""
    s = _sums(spark, d).groupBy("y", "k").agg(F.sum("v").alias("v"))
    k = F.col("k")
    cells = _sheet(_at(s, 1, 1, "单位：亿元"), _at(s, k + 2, 1, _one_of(labels, k), ["y", "k"]), _body(s, k + 2, F.lit(3)), _at(s, 8, 2, "注：说明"), _at(s, 9, 1, "总资产"), _at(s, 9, 2, "5"))
    return cells, _files(s, dataset)


def _monthly_sql(dataset, labels, paths):
    bases = ", ".join("'POINT_IN_TIME'" if p.startswith(("total_assets", "net_assets", "funds")) else "'YTD'" for p in paths)
    code = workbooks.MONTHLY[dataset][0]
    return f"with {_SUMS}, w as (select y, k, sum(v) v from s group by 1, 2) select y || '-12' release_id, case when [{bases}][k] = 'YTD' then make_date(y, 1, 1) else make_date(y, 12, 31) end period_start, make_date(y, 12, 31) period_end, '{code}' entity_code, [{', '.join(map(repr, paths))}][k] metric_path, v \"value\", 'reported' value_status, 'C' || (k + 2) source_cell from w"


_MONTHLY_SHOWN = ["release_id", "period_start", "period_end", "entity_code", "metric_path", "value", "value_status", "source_cell"]
_LIFE = (["原保险保费收入", "其中：寿险", "健康险", "原保险赔付支出", "总资产"], ["original_premium_income.all", "original_premium_income.life", "original_premium_income.health", "claims_paid.all", "total_assets.all"])
_PROPERTY = (["原保险保费收入", "其中：机动车辆保险", "其中：责任保险", "赔款支出", "资产总额"], ["original_premium_income.all", "original_premium_income.motor_vehicle", "original_premium_income.liability", "claims_paid.all", "total_assets.all"])
_INDUSTRY = (["原保险保费收入", "1、财产险", "2、人身险", "资金运用余额", "其中：银行存款"], ["original_premium_income.all", "original_premium_income.property_insurance", "original_premium_income.personal_insurance", "funds_employed_balance.all", "funds_employed_balance.bank_deposits"])


@query(_monthly_sql("life_insurance_monthly", *_LIFE))
def tab_life_monthly(spark, d):
    return workbooks.monthly(*_monthly(spark, d, "life_insurance_monthly", _LIFE[0]), "life_insurance_monthly").select(*_MONTHLY_SHOWN)


@query(_monthly_sql("property_insurance_monthly", *_PROPERTY))
def tab_property_monthly(spark, d):
    return workbooks.monthly(*_monthly(spark, d, "property_insurance_monthly", _PROPERTY[0]), "property_insurance_monthly").select(*_MONTHLY_SHOWN)


@query(_monthly_sql("insurance_industry_monthly", *_INDUSTRY))
def tab_industry_monthly(spark, d):
    return workbooks.monthly(*_monthly(spark, d, "insurance_industry_monthly", _INDUSTRY[0]), "insurance_industry_monthly").select(*_MONTHLY_SHOWN)


@query(f"with {_SUMS}, w as (select y, k, sum(v) v from s group by 1, 2), t as (select y, max(case when k = 1 then v end) total_value, max(case when k = 2 then v end) + max(case when k = 3 then v end) parts_value from w group by 1) select cast(y as varchar) source_file, 'original_premium_income' metric_code, 'property_insurance+personal_insurance' parts, total_value, parts_value, abs(total_value - parts_value) gap from t where abs(total_value - parts_value) > 0.02")
def dq_product_identities(spark, d):
    f = workbooks.monthly(*_monthly(spark, d, "insurance_industry_monthly", _INDUSTRY[0]), "insurance_industry_monthly")
    x = quality.product_identities(f, "insurance_industry_monthly")
    return x.select("source_file", "metric_code", "parts", *(F.col(c).cast("decimal(38,6)").alias(c) for c in ("total_value", "parts_value", "gap")))


@query(f"with {_SUMS}, w as (select distinct y from s), e as (select unnest([['original_premium_income', 'all'], ['original_premium_income', 'property_insurance'], ['original_premium_income', 'personal_insurance'], ['claims_paid', 'all'], ['claims_paid', 'property_insurance'], ['claims_paid', 'personal_insurance'], ['funds_employed_balance', 'all'], ['funds_employed_balance', 'bank_deposits'], ['funds_employed_balance', 'bonds'], ['funds_employed_balance', 'stocks_and_securities_funds'], ['total_assets', 'all'], ['total_assets', 'reinsurance_company'], ['total_assets', 'insurance_asset_management_company'], ['net_assets', 'all']]) p) select cast(y as varchar) source_file, 'S2_2023_REDUCED' schema_version, p[1] metric_code, p[2] product_line, 'missing' side from w, e where p[1] || p[2] not in ('original_premium_incomeall', 'original_premium_incomeproperty_insurance', 'original_premium_incomepersonal_insurance', 'funds_employed_balanceall', 'funds_employed_balancebank_deposits')")
def dq_expected_keys(spark, d):
    f = workbooks.monthly(*_monthly(spark, d, "insurance_industry_monthly", _INDUSTRY[0]), "insurance_industry_monthly")
    return quality.expected_keys(f, workbooks.versions(f, "insurance_industry_monthly"), "insurance_industry_monthly")


@query(f"with {_SUMS}, w as (select cast(y as varchar) f, count(*) n, count(distinct q) p from s where k <= 5 group by 1) select f source_file, 'commercial_bank_regulatory_indicators' dataset_id, n n_facts, cast(148 as bigint) n_expected from w where n <> 148")
def dq_fact_counts(spark, d):
    return quality.unexpected_counts(_regulatory(spark, d))


@query(f"with {_SUMS} select cast(y as varchar) f, make_date(y, 12, 31) period_end, ['CN', '110000', '120000', '130000', '210200'][k] region_code, ['premium_total', 'premium_life'][i] metric_code, case when i = 1 then sum(v) else sum(v) / 2 end \"value\" from s, (select unnest([1, 2]) i) group by y, k, i")
def tab_region_premium(spark, d):
    """The regional table over the shipped dimension of regions."""
    s = _sums(spark, d).groupBy("y", "k").agg(F.sum("v").alias("v"))
    k = F.col("k")
    cells = _sheet(*(_at(s, 2, c, n) for c, n in enumerate(["地 区", "合计", "财产保险", "寿险", "意外险", "健康险"], 1)), _at(s, k + 2, 1, _one_of(["全国合计", "北 京", "天津", "河北", "大连"], k), ["y", "k"]), _body(s, k + 2, F.lit(2)), _body(s, k + 2, F.lit(4), (F.col("v") / 2).cast("decimal(38,6)")))
    f = premium_facts(cells, s.select(F.col("y").cast("string").alias("file"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end")).distinct(), dims.aliases(spark, [(r[0], r[1], r[5]) for r in dims.REGIONS], ["region_code", "region_name"]))
    return f.select(F.col("file").alias("f"), "period_end", "region_code", "metric_code", "value")


@query(f"with {_SUMS}, w as (select y, k, sum(v) v from s group by 1, 2), t as (select y, max(case when k = 1 then v end) n, sum(case when k > 1 then v end) r, count(*) c from w group by 1) select cast(y as varchar) source_file, 'premium_total' metric_code, n national, r regions, n - r gap from t where abs(n - r) > 0.005 * c and (abs(n - r) > 1 or abs(n - r) > 0.0005 * abs(n))")
def dq_national_against_regions(spark, d):
    s = _sums(spark, d).groupBy("y", "k").agg(F.sum("v").alias("v"))
    f = s.select(F.col("y").cast("string").alias("source_file"), F.lit("premium_total").alias("metric_code"), F.when(F.col("k") == 1, "CN").otherwise(F.col("k").cast("string")).alias("region_code"), F.when(F.col("k") == 1, "national").otherwise("province").alias("region_type"), F.col("v").alias("value"))
    x = quality.national_gap(f, ["source_file", "metric_code"])
    return x.select("source_file", "metric_code", *(F.col(c).cast("decimal(38,6)").alias(c) for c in ("national", "regions", "gap")))
