from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from veriloom.operators import dims, tables, workbooks as W

CELLS = "file string, sheet string, row int, col int, value string, formula string, format string"
FILES = "file string, dataset string, year int, month int, source_format string, source_file_hash string"


def book(spark, files, rows, formulas=None, formats=None):
    """files: name -> (dataset, year, month, format, rows of values)."""
    cells, about = [], []
    for name, (dataset, year, month, kind, grid) in files.items():
        about.append((name, dataset, year, month, kind, f"hash-{name}"))
        for r, line in enumerate(grid, 1):
            for c, v in enumerate(line, 1):
                f = (formulas or {}).get((name, r, c))
                if v is not None or f:
                    cells.append((name, "Sheet1", r, c, None if v is None else str(v), f, (formats or {}).get((name, r, c))))
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame(about, FILES)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_balances(spark):
    grid = [["2023年银行业总资产、总负债（季度）"], ["银行业金融机构"], ["项 目", "一季度", "二季度", "3月"], ["总资产", "1,000.5", "1100", "7"], ["比上年同期增长率", "5.1%", "6"], ["其中：总负债*", "900", None], ["占银行业金融机构比例", "1", "2"], ["大型商业银行"], ["比上年同期增长率", "3", "3"], ["项目", "三季度"], ["总资产", "50"], ["注：口径"], ["另注"]]
    cells, files = book(spark, {"q": ("bank_balance_quarterly", 2023, None, "xls", grid)}, None)
    f = W.extract(cells, files, ["bank_balance_quarterly", "excel_template_library"])
    assert f.columns == W.FACT
    assert got(f, "entity_code", "metric_code", "source_cell", "value", "unit") == [
        ("banking_financial_institutions", "total_assets", "B4", D("1000.500000"), "亿元"), ("banking_financial_institutions", "total_assets", "C4", D("1100.000000"), "亿元"),
        ("banking_financial_institutions", "total_assets_yoy", "B5", D("5.100000"), "%"), ("banking_financial_institutions", "total_assets_yoy", "C5", D("6.000000"), "%"),
        ("banking_financial_institutions", "total_liabilities", "B6", D("900.000000"), "亿元"),
        ("banking_financial_institutions", "total_liabilities_industry_share", "B7", D("1.000000"), "%"), ("banking_financial_institutions", "total_liabilities_industry_share", "C7", D("2.000000"), "%"),
        ("large_commercial_banks", "total_assets", "B11", D("50.000000"), "亿元"),
    ]
    r = f.filter("source_cell = 'B4'").first()
    assert str(r["period_end"]) == "2023-03-31" and r["comparability_flag"].startswith("SCOPE_CHANGE") and r["footnotes"] == "注：口径\n另注" and r["metric_name_raw"] == "总资产"
    with pytest.raises(ValueError):
        W.extract(cells, files, ["nothing"])


def test_loans_and_types(spark):
    loan = [["普惠型小微企业贷款情况"], ["项目", "一季度", "二季度末"], ["商业银行合计", 10, "--"], ["未知机构", 5, 5], ["民营银行", "(3)", "x"], ["注：民营银行"], ["民营银行", 9, 9]]
    kinds = [["时间/指标"], ["机构", None, "大型商业银行", "外资银行"], ["一季度", "不良贷款余额", 1, 2], [None, "资本充足率", "12.5", None], ["二季度", "净利润", 3, None], [None, "怪指标", 4, None], [None, "空指标", None, None]]
    cells, files = book(spark, {"l": ("inclusive_small_business_loans", 2022, None, "xls", loan), "t": ("commercial_bank_indicators_by_type", 2024, None, "xls", kinds)}, None)
    assert got(W.loans(cells, files), "entity_code", "source_cell", "value", "value_status") == [
        ("commercial_banks", "B3", D("10.000000"), "reported"), ("commercial_banks", "C3", None, "not_reported"), ("private_banks", "B5", D("-3.000000"), "reported"), ("private_banks", "C5", None, "parse_error")]
    t = W.indicators_by_type(cells, files)
    assert got(t, "metric_code", "entity_code", "period_basis", "unit", "value", "comparability_flag") == [
        ("capital_adequacy_ratio", "large_commercial_banks", "quarter_end", "%", D("12.500000"), "CAPITAL_RULES_2024_BREAK"), ("net_profit_ytd", "large_commercial_banks", "year_to_date", "亿元", D("3.000000"), ""),
        ("nonperforming_loan_balance", "foreign_banks", "quarter_end", "亿元", D("2.000000"), ""), ("nonperforming_loan_balance", "large_commercial_banks", "quarter_end", "亿元", D("1.000000"), "")]
    assert {str(r["period_end"]) for r in t.filter("metric_code = 'net_profit_ytd'").collect()} == {"2024-06-30"}
    assert got(W.unknown_metrics(cells, files), "file", "row", "label") == [("t", 6, "怪指标")]


def test_regulatory_indicators_and_stored_numbers(spark):
    grid = [["时间", "一季度"], ["（一）信用风险指标*"], ["不良贷款余额", "31170.1234567"], ["不良贷款率", "0.0162"], ["（二）资本", None], ["资本充足率", "15.2"], ["注"], ["杠杆率", "7"]]
    cells, files = book(spark, {"r": ("commercial_bank_regulatory_indicators", 2023, None, "xlsx", grid)}, None, formats={("r", 4, 2): "0.00%", ("r", 3, 2): "#,##0.00"})
    assert got(W.regulatory_indicators(cells, files), "metric_code", "metric_group", "value", "value_display", "quality_flags", "calculation_basis") == [
        ("capital_adequacy_ratio", "资本", D("15.200000"), "15.2", "", "STORAGE"), ("nonperforming_loan_balance", "信用风险指标", D("31170.123457"), "31,170.12", "PRECISION_ROUNDED_6DP", "STORAGE"), ("nonperforming_loan_ratio", "信用风险指标", D("1.620000"), "1.62%", "", "STORAGE")]


def test_solvency_and_funds(spark):
    sol = [["指标", "机构", "一季度", "二季度"], [None, None, "一季度末", "二季度末", "三季度末", "四季度末"], ["综合偿付能力充足率", "保险公司", 190, 191, 192, 193], [None, "再保险公司", 1, None, None, None], ["核心偿付能力充足率", "保险公司", 100, None, None, None], ["风险综合评级", "A类公司", 50, None, None, None], ["注", "B类公司", 1, 1, 1, 1]]
    old = [["资金运用余额情况"], ["资金运用余额", "10000", "100", "5"], ["银行存款", "5000", None, None], ["年化财务收益率", "3.2", None, None], ["人身险公司", None], ["债券", "7", None, None]]
    new = [["资金运用余额"], ["机构类别/指标"], ["人身险公司", "资金运用余额", 8, 9, 10], [None, "股票", 1, None, None], ["注：风险处置"]]
    cells, files = book(spark, {"s": ("insurance_solvency", 2022, None, "xls", sol), "1_2023年一季度": ("insurance_funds_investment", 2023, None, "xls", old), "2_2025年2季度": ("insurance_funds_investment", 2025, None, "xls", new)}, None)
    s = W.solvency(cells, files)
    assert s.count() == 7 and got(s.filter("value < 101"), "metric_code", "entity_code", "unit") == [("comprehensive_solvency_adequacy_ratio", "reinsurers", "%"), ("core_solvency_adequacy_ratio", "insurance_companies", "%"), ("risk_comprehensive_rating_company_count", "risk_rating_a", "家")]
    f = W.funds(cells, files)
    assert got(f.filter("source_file like '1%'"), "metric_code", "entity_code", "value", "unit_raw") == [
        ("annualized_financial_investment_yield", "insurance_companies", D("3.200000"), "%"), ("bank_deposit_balance", "insurance_companies", D("0.500000"), "万元"), ("bonds_balance", "life_insurers", D("0.000700"), "万元"),
        ("funds_investment_balance", "insurance_companies", D("1.000000"), "万元"), ("funds_investment_share", "insurance_companies", D("100.000000"), "%"), ("funds_investment_yoy", "insurance_companies", D("5.000000"), "%")]
    assert got(f.filter("source_file like '2%'"), "metric_code", "value", "schema_version", "release_id", "comparability_flag") == [
        (c, D(f"{v}.000000"), "INSURANCE_FUNDS_V3", "2025-Q2", "RISK_DISPOSAL_SCOPE_EXCLUSION|YOY_AND_YIELDS_NOT_PUBLISHED_2025") for c, v in (("funds_investment_balance", 8), ("funds_investment_share", 9), ("funds_investment_yoy", 10), ("stocks_balance", 1))]


def test_dictionaries(spark):
    grid = [["频度", "信息发布时间", "机构范围", "数据范围", "指标名称"], ["月度", "次月", "银行", "全国", "总资产"], [None, None, None, None, "总负债"], ["季度", None, None, None, "利润"], ["注：x"], ["序号", "指标名称", "指标范围及计算公式"], ["1", "总资产", "定义"], ["2.0", "总负债", "定义二"], ["a", "b", "c"], ["序号", "机构类", "机构范围"], ["1", "银行", "全部"]]
    cells, files = book(spark, {"d": ("regulatory_release_schedule", 2024, None, "xls", grid)}, None)
    assert got(W.dictionary(cells, files, "schedule"), "row_order", "frequency", "release_timing", "indicator_names") == [(1, "月度", "次月", "总资产"), (2, "月度", "次月", "总负债"), (3, "季度", "次月", "利润")]
    assert got(W.dictionary(cells, files, "definitions"), "sequence", "metric_name", "definition", "source_cell") == [(1, "总资产", "定义", "B7"), (2, "总负债", "定义二", "B8")]
    assert got(W.dictionary(cells, files, "scopes"), "sequence", "institution_type") == [(1, "银行")]


def test_monthly(spark):
    grid = [["人身险公司经营情况表", "单位：亿元、万件"], ["其中：寿险", "1"], ["原保险保费收入", None, "100", "7"], ["其中：寿险", "60"], ["健康险", "x", "40"], ["怪", "5"], ["总资产", None, None], ["注：风险处置 暂不包括"], ["总资产", "9"]]
    cells, files = book(spark, {"m": ("life_insurance_monthly", 2022, 5, "xls", grid)}, None, formulas={("m", 7, 3): "=A1"})
    f = W.monthly(cells, files, "life_insurance_monthly")
    assert got(f, "metric_path", "value", "source_cell", "value_status", "quality_flags") == [
        ("original_premium_income.all", D("100.000000"), "C3", "reported", ""), ("original_premium_income.health", D("40.000000"), "C5", "reported", ""), ("original_premium_income.life", D("60.000000"), "B4", "reported", ""), ("total_assets.all", None, "C7", "missing", "FORMULA_CACHE_MISSING")]
    assert {(str(r["period_start"]), r["period_basis"]) for r in f.collect()} == {("2022-01-01", "YTD"), ("2022-05-31", "POINT_IN_TIME")}
    assert got(W.unknown_lines(cells, files, "life_insurance_monthly"), "row", "problem") == [(6, "unknown_label")]
    assert W.versions(f, "life_insurance_monthly").first()["schema_version"] == "S2_MODERN_LABELS"
    u = W.unified(f)
    assert got(u.filter("normalized_value is null"), "entity_code", "formula_cache_status", "quality_status") == [("CN_LIFE_INSURANCE_INDUSTRY_TOTAL", "missing", "needs_review")]
    assert ("CN_LIFE_INSURANCE_INDUSTRY_TOTAL:life", "全国人身险行业汇总/寿险", "60") in {r[:3] for r in got(u.filter("normalized_value is not null"), "entity_code", "entity_name", "normalized_value")}


def test_property_and_industry(spark):
    prop = [["财产"], ["原保险保费收入", "10"], ["其中：机动车辆保险", "4"], ["责任险", "2"], ["资产总额", "8"]]
    ind = [["保险业"], ["原保险保费收入", "10"], ["1、财产险", "4"], ["2、人身险", "6"], ["（1）寿险", "5"], ["赔款与给付支出", "3"], ["总资产", "9"], ["其中：再保险公司", "1"]]
    cells, files = book(spark, {"p": ("property_insurance_monthly", 2022, 1, "xls", prop), "i": ("insurance_industry_monthly", 2026, 2, "xls", ind)}, None)
    p, i = W.monthly(cells, files, "property_insurance_monthly"), W.monthly(cells, files, "insurance_industry_monthly")
    assert [x[0] for x in got(p, "metric_path")] == ["original_premium_income.all", "original_premium_income.liability", "original_premium_income.motor_vehicle", "total_assets.all"]
    assert [x[0] for x in got(i, "metric_path")] == ["claims_paid.all", "original_premium_income.all", "original_premium_income.life_insurance", "original_premium_income.personal_insurance", "original_premium_income.property_insurance", "total_assets.all", "total_assets.reinsurance_company"]
    assert W.versions(p, "property_insurance_monthly").first()[1] == "S4_NO_POLICY_COUNT" and W.versions(i, "insurance_industry_monthly").first()[1] == "S5_2026_ACCOUNTING"


def test_scopes_bytes_and_addresses(spark):
    df = spark.createDataFrame([(2021, 5, None, None), (2022, 1, "风险处置机构暂不包括", None), (2022, 1, "无", "风险处置 不包含".encode("gb18030")), (2022, 1, "无", b"x")], "y int, m int, n string, b binary")
    assert [r[0] for r in df.select(W.stated_scope(F.col("y"), F.col("m"), F.col("n"), F.col("b"))).collect()] == ["PRE_2021_06", "DISCLOSED_RISK_DISPOSAL_EXCLUSION", "DISCLOSED_RISK_DISPOSAL_EXCLUSION", "UNSTATED"]
    at = spark.createDataFrame([(1,), (26,), (27,), (52,), (53,), (702,), (703,), (16384,)], "c int").select(tables.address(F.lit(7), F.col("c")))
    assert [r[0] for r in at.collect()] == ["A7", "Z7", "AA7", "AZ7", "BA7", "ZZ7", "AAA7", "XFD7"]
    assert len(dims.REGIONS) == 38 and len(dims.REGULATORY_METRICS) == 38 and len(dims.INDUSTRY_PRODUCTS) == 12


def test_empty(spark):
    cells, files = book(spark, {"x": ("insurance_solvency", 2022, None, "xls", [["nothing"]])}, None)
    none = cells.limit(0)
    assert W.solvency(cells, files).count() == 0 and W.extract(none, files, list(W.PARSERS)).count() == 0 and W.monthly(none, files, "life_insurance_monthly").count() == 0
