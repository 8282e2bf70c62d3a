"""Dimension tables of the statistics: small, fixed, given as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.text import label_key

# Kinds of institutions, (code, name, aliases).
ENTITIES = [
    ("banking_financial_institutions", "银行业金融机构", ["银行业金融机构", "银行业金融机构合计"]),
    ("commercial_banks", "商业银行合计", ["商业银行", "商业银行合计"]),
    ("large_commercial_banks", "大型商业银行", ["大型商业银行"]),
    ("joint_stock_commercial_banks", "股份制商业银行", ["股份制商业银行"]),
    ("city_commercial_banks", "城市商业银行", ["城市商业银行"]),
    ("private_banks", "民营银行", ["民营银行"]),
    ("rural_financial_institutions", "农村金融机构", ["农村金融机构"]),
    ("rural_commercial_banks", "农村商业银行", ["农村商业银行"]),
    ("foreign_banks", "外资银行", ["外资银行"]),
    ("other_financial_institutions", "其他类金融机构", ["其他类金融机构", "其他类银行业金融机构"]),
    ("insurance_companies", "保险公司", ["保险公司", "保险机构"]),
    ("property_insurers", "财产险公司", ["财产险公司", "财产保险公司"]),
    ("life_insurers", "人身险公司", ["人身险公司", "人身保险公司"]),
    ("reinsurers", "再保险公司", ["再保险公司"]),
    ("risk_rating_a", "A类公司", ["A类公司"]),
    ("risk_rating_b", "B类公司", ["B类公司"]),
    ("risk_rating_c", "C类公司", ["C类公司"]),
    ("risk_rating_d", "D类公司", ["D类公司"]),
]
# Regional premium metrics, (code, column labels, name).
PREMIUM_METRICS = [
    ("premium_total", ["合计"], "原保险保费收入合计"),
    ("premium_property", ["财产保险", "财产险"], "财产险"),
    ("premium_life", ["寿险"], "寿险"),
    ("premium_accident", ["意外险"], "意外险"),
    ("premium_health", ["健康险"], "健康险"),
]
# Life insurance metrics, (code, name, unit, basis, order, aliases).
LIFE_METRICS = [
    ("original_premium_income", "原保险保费收入", "CNY_100M", "YTD", 10, ["原保险保费收入"]),
    ("policyholder_investment_new_contribution", "保户投资款新增交费", "CNY_100M", "YTD", 20, ["保户投资款新增交费"]),
    ("unit_linked_account_new_contribution", "投连险独立账户新增交费", "CNY_100M", "YTD", 30, ["投连险独立账户新增交费"]),
    ("claims_paid", "赔付支出", "CNY_100M", "YTD", 40, ["原保险赔付支出", "赔付支出", "赔款与给付支出"]),
    ("sum_insured", "保险金额", "CNY_100M", "YTD", 50, ["保险金额"]),
    ("new_sum_insured", "新增保险金额", "CNY_100M", "YTD", 60, ["新增保险金额"]),
    ("policy_count", "保单件数", "TEN_THOUSAND_POLICIES", "YTD", 70, ["保单件数"]),
    ("new_policy_count", "新增保单件数", "TEN_THOUSAND_POLICIES", "YTD", 80, ["新增保单件数"]),
    ("total_assets", "总资产", "CNY_100M", "POINT_IN_TIME", 90, ["资产总额", "总资产"]),
]
# Life product lines, (code, name, order, aliases).
LIFE_PRODUCTS = [
    ("life", "寿险", 10, ["其中：寿险", "寿险"]),
    ("ordinary_life", "普通寿险", 11, ["其中：普通寿险", "普通寿险"]),
    ("accident", "意外险", 20, ["其中：意外险", "意外险"]),
    ("health", "健康险", 30, ["其中：健康险", "健康险"]),
]
# Property insurance metrics and product lines, as for life.
PROPERTY_METRICS = [
    ("original_premium_income", "原保险保费收入", "CNY_100M", "YTD", 10, ["原保险保费收入"]),
    ("claims_paid", "赔款支出", "CNY_100M", "YTD", 20, ["原保险赔款支出", "赔款支出", "赔款与给付支出"]),
    ("sum_insured", "保险金额", "CNY_100M", "YTD", 30, ["保险金额"]),
    ("policy_count", "保单件数", "TEN_THOUSAND_POLICIES", "YTD", 40, ["保单件数"]),
    ("total_assets", "总资产", "CNY_100M", "POINT_IN_TIME", 50, ["资产总额", "总资产"]),
]
PROPERTY_PRODUCTS = [
    ("enterprise_property", "企业财产保险", 10, ["企业财产保险"]),
    ("household_property", "家庭财产保险", 20, ["家庭财产保险"]),
    ("motor_vehicle", "机动车辆保险", 30, ["机动车辆保险"]),
    ("engineering", "工程保险", 40, ["工程保险"]),
    ("liability", "责任险", 50, ["责任保险", "责任险"]),
    ("guarantee", "保证保险", 60, ["保证保险"]),
    ("agriculture", "农业保险", 70, ["农业保险"]),
    ("health", "健康险", 80, ["健康险"]),
    ("accident", "意外险", 90, ["意外险"]),
    ("cargo", "货运险", 100, ["货运险", "货物运输保险"]),
]
# Industry metrics and breakdowns, as for life.
INDUSTRY_METRICS = [
    ("original_premium_income", "原保险保费收入", "CNY_100M", "YTD", 10, ["原保险保费收入"]),
    ("sum_insured", "保险金额", "CNY_100M", "YTD", 20, ["保险金额"]),
    ("policy_count", "保单件数", "TEN_THOUSAND_POLICIES", "YTD", 30, ["保单件数"]),
    ("claims_paid", "赔付支出", "CNY_100M", "YTD", 40, ["原保险赔付支出", "赔付支出", "赔款与给付支出"]),
    ("operating_management_expense", "业务及管理费", "CNY_100M", "YTD", 50, ["业务及管理费"]),
    ("funds_employed_balance", "资金运用余额", "CNY_100M", "POINT_IN_TIME", 60, ["资金运用余额"]),
    ("total_assets", "总资产", "CNY_100M", "POINT_IN_TIME", 70, ["资产总额", "总资产"]),
    ("net_assets", "净资产", "CNY_100M", "POINT_IN_TIME", 80, ["净资产"]),
]
INDUSTRY_PRODUCTS = [
    ("property_insurance", "财产险", 10, ["财产险", "财产保险"]),
    ("personal_insurance", "人身险", 20, ["人身险"]),
    ("life_insurance", "寿险", 21, ["(1)寿险", "寿险"]),
    ("health_insurance", "健康险", 22, ["(2)健康险", "健康险"]),
    ("accident_insurance", "人身意外伤害险", 23, ["(3)人身意外伤害险", "人身意外伤害险"]),
    ("bank_deposits", "银行存款", 30, ["银行存款"]),
    ("bonds", "债券", 31, ["债券"]),
    ("stocks_and_securities_funds", "股票和证券投资基金", 32, ["股票和证券投资基金"]),
    ("property_insurance_company", "财产险公司", 40, ["财产险公司"]),
    ("personal_insurance_company", "人身险公司", 41, ["人身险公司"]),
    ("reinsurance_company", "再保险公司", 42, ["再保险公司"]),
    ("insurance_asset_management_company", "保险资产管理公司", 43, ["保险资产管理公司", "资产管理公司"]),
]
# Regulatory metrics, (code, name, aliases).
REGULATORY_METRICS = [
    ("normal_loan_balance", "正常类贷款", ["正常类贷款"]),
    ("special_mention_loan_balance", "关注类贷款", ["关注类贷款"]),
    ("nonperforming_loan_balance", "不良贷款余额", ["不良贷款余额"]),
    ("substandard_loan_balance", "次级类贷款余额", ["次级类贷款", "次级类贷款余额"]),
    ("doubtful_loan_balance", "可疑类贷款余额", ["可疑类贷款", "可疑类贷款余额"]),
    ("loss_loan_balance", "损失类贷款余额", ["损失类贷款", "损失类贷款余额"]),
    ("normal_loan_ratio", "正常类贷款占比", ["正常类贷款占比"]),
    ("special_mention_loan_ratio", "关注类贷款占比", ["关注类贷款占比"]),
    ("nonperforming_loan_ratio", "不良贷款率", ["不良贷款率"]),
    ("substandard_loan_ratio", "次级类贷款率", ["次级类贷款率"]),
    ("doubtful_loan_ratio", "可疑类贷款率", ["可疑类贷款率"]),
    ("loss_loan_ratio", "损失类贷款率", ["损失类贷款率"]),
    ("loan_loss_provision", "贷款损失准备", ["贷款损失准备"]),
    ("provision_coverage_ratio", "拨备覆盖率", ["拨备覆盖率"]),
    ("loan_provision_ratio", "贷款拨备率", ["贷款拨备率"]),
    ("liquidity_ratio", "流动性比例", ["流动性比例"]),
    ("loan_to_deposit_ratio_rmb", "存贷比（人民币）", ["存贷比(人民币)"]),
    ("rmb_excess_reserve_ratio", "人民币超额备付金率", ["人民币超额备付金率"]),
    ("liquidity_coverage_ratio", "流动性覆盖率", ["流动性覆盖率"]),
    ("net_stable_funding_ratio", "净稳定资金比例", ["净稳定资金比例"]),
    ("net_profit_ytd", "净利润（本年累计）", ["净利润", "净利润(本年累计)"]),
    ("return_on_assets", "资产利润率", ["资产利润率"]),
    ("return_on_equity", "资本利润率", ["资本利润率"]),
    ("net_interest_margin", "净息差", ["净息差"]),
    ("non_interest_income_ratio", "非利息收入占比", ["非利息收入占比"]),
    ("cost_income_ratio", "成本收入比", ["成本收入比"]),
    ("core_tier1_capital_net", "核心一级资本净额", ["核心一级资本净额"]),
    ("tier1_capital_net", "一级资本净额", ["一级资本净额"]),
    ("total_capital_net", "资本净额", ["资本净额"]),
    ("credit_rwa", "信用风险加权资产", ["信用风险加权资产"]),
    ("market_rwa", "市场风险加权资产", ["市场风险加权资产"]),
    ("operational_rwa", "操作风险加权资产", ["操作风险加权资产"]),
    ("rwa_after_floor", "应用资本底线后的风险加权资产合计", ["应用资本底线后的风险加权资产合计"]),
    ("core_tier1_capital_adequacy_ratio", "核心一级资本充足率", ["核心一级资本充足率"]),
    ("tier1_capital_adequacy_ratio", "一级资本充足率", ["一级资本充足率"]),
    ("capital_adequacy_ratio", "资本充足率", ["资本充足率"]),
    ("leverage_ratio", "杠杆率", ["杠杆率"]),
    ("cumulative_fx_exposure_ratio", "累计外汇敞口头寸比例", ["累计外汇敞口头寸比例"]),
]
# Metrics whose definition changed with the capital rules of 2024.
CAPITAL_METRICS = [
    "core_tier1_capital_net", "tier1_capital_net", "total_capital_net", "credit_rwa", "market_rwa", "operational_rwa", "rwa_after_floor",
    "core_tier1_capital_adequacy_ratio", "tier1_capital_adequacy_ratio", "capital_adequacy_ratio",
]
# What insurance funds are placed in, and their yields, (code, name, aliases).
FUND_BASES = [
    ("funds_investment", "资金运用", ["资金运用余额"]),
    ("bank_deposit", "银行存款", ["银行存款"]),
    ("bonds", "债券", ["债券"]),
    ("stocks", "股票", ["股票"]),
    ("securities_investment_funds", "证券投资基金", ["证券投资基金"]),
    ("long_term_equity_investment", "长期股权投资", ["长期股权投资"]),
]
FUND_YIELDS = [
    ("annualized_financial_investment_yield", "年化财务投资收益率", ["财务收益率年化", "年化财务收益率", "年化财务投资收益率"]),
    ("annualized_comprehensive_investment_yield", "年化综合投资收益率", ["综合收益率年化", "年化综合收益率", "年化综合投资收益率"]),
]
# Regions, (code, name); the provinces come first, the cities planned separately last, with the province
# that each belongs to told by the first two digits of its code. Other names of a region follow.
PROVINCES = {
    "110000": "北京", "120000": "天津", "130000": "河北", "140000": "山西", "150000": "内蒙古", "210000": "辽宁", "220000": "吉林", "230000": "黑龙江", "310000": "上海", "320000": "江苏",
    "330000": "浙江", "340000": "安徽", "350000": "福建", "360000": "江西", "370000": "山东", "410000": "河南", "420000": "湖北", "430000": "湖南", "440000": "广东", "450000": "广西",
    "460000": "海南", "500000": "重庆", "510000": "四川", "520000": "贵州", "530000": "云南", "540000": "西藏", "610000": "陕西", "620000": "甘肃", "630000": "青海", "640000": "宁夏", "650000": "新疆",
}
PLANNED_CITIES = {"210200": "大连", "330200": "宁波", "350200": "厦门", "370200": "青岛", "440300": "深圳"}
#: (code, name, type, order, province code, aliases) of all regions.
REGIONS = [
    ("CN", "全国", "national", 0, "", ["全国", "全国合计"]),
    ("HQ", "公司本级", "company_head_office", 1, "", ["公司本级", "集团、总公司本级"]),
    *((c, n, "province", 10 * i, "", [n]) for i, (c, n) in enumerate(PROVINCES.items(), 1)),
    *((c, n, "planned_city", 10 * i, c[:2] + "0000", [n]) for i, (c, n) in enumerate(PLANNED_CITIES.items(), len(PROVINCES) + 1)),
]
# Quality states from best to worst.
QUALITY_RANK = ["passed", "warning", "needs_review", "rejected"]


def lookup(rows: list[tuple], key: Column, *parts: tuple[int, str]) -> Column:
    """struct of some parts (place in the row, name) of the dimension row whose alias is the key, else null. The
    dimension is a constant of the plan; label marks are taken off its aliases as they are off the key."""
    found: dict[str, tuple] = {}
    for r in rows:
        for a in r[-1]:
            found.setdefault(a, r)
    entry = lambda r: F.struct(*(F.lit(r[i]).alias(n) for i, n in parts))
    return F.try_element_at(F.create_map(*(x for a, r in found.items() for x in (F.lit(a), entry(r)))), key)


def aliases(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """One row per alias of a dimension given as tuples that end with a list of aliases; `key` is the alias's label key."""
    flat = [(*r[:-1], a) for r in rows for a in r[-1]]
    df = spark.createDataFrame(flat, [*names, "alias"])
    return df.withColumn("key", label_key(F.col("alias"))).dropDuplicates(["key"])


def with_dimension(df: DataFrame, label: str, dimension: DataFrame) -> DataFrame:
    """df left-joined to an alias dimension by label key; unknown labels keep nulls. The dimension's size is that of a
    fixed list, so Spark broadcasts it by its own size check."""
    return df.withColumn("key", label_key(F.col(label))).join(dimension.drop("alias"), "key", "left").drop("key")


def unknown_labels(df: DataFrame, label: str, dimension: DataFrame) -> DataFrame:
    """(label, n): labels that no alias covers."""
    return df.filter(F.col(label).isNotNull()).withColumn("key", label_key(F.col(label))).join(dimension.select("key"), "key", "left_anti").groupBy(label).agg(F.count(F.lit(1)).alias("n"))
