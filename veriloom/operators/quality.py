"""Data-quality checks: each a query that returns the offending rows or one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.numbers import display_precision, precision_unit


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): business keys held by more than one row; null parts are a value."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_set_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys only expected ('missing') or only there ('extra'); null keys are dropped on both sides."""
    e, a = (d.select(*keys).dropna().distinct() for d in (expected, actual))
    return e.join(a, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, keys, "left_anti").withColumn("side", F.lit("extra")))


def cumulative_decrease(df: DataFrame, keys: list[str], period: str, value: str, tolerance: Column | None = None) -> DataFrame:
    """Rows of a year-to-date series that fall below the period before by more than the tolerance, within a year.

    With a tolerance both periods' larger one counts; without one any decrease does. Null values are left out.
    """
    x = df.filter(F.col(value).isNotNull() & F.col(period).isNotNull()).withColumn("_t", tolerance if tolerance is not None else F.lit(0.0))
    w = Window.partitionBy(*keys, F.year(period)).orderBy(period, value)
    x = x.withColumns({"previous_period": F.lag(period).over(w), "previous_value": F.lag(value).over(w), "_p": F.lag("_t").over(w)})
    return x.filter(F.col(value) + F.greatest("_t", "_p") < F.col("previous_value")).drop("_t", "_p")


def row_identity(df: DataFrame, keys: list[str], part: str, total: str, value: str, tolerance: float) -> DataFrame:
    """(keys, total_value, parts_value, gap): where the row of part `total` differs from the sum of the others by more
    than the tolerance; keys without a total or without parts don't show."""
    t = F.sum(F.when(F.col(part) == total, F.col(value)))
    p = F.sum(F.when(F.col(part) != total, F.col(value)))
    x = df.groupBy(*keys).agg(t.alias("total_value"), p.alias("parts_value")).withColumn("gap", F.col("total_value") - F.col("parts_value"))
    return x.filter(F.abs("gap") > tolerance)


def part_exceeds(df: DataFrame, keys: list[str], part: str, small: str, large: str, value: str) -> DataFrame:
    """(keys, small_value, large_value): where a part is more than what contains it."""
    x = df.groupBy(*keys).agg(F.max(F.when(F.col(part) == small, F.col(value))).alias("small_value"), F.max(F.when(F.col(part) == large, F.col(value))).alias("large_value"))
    return x.filter("small_value > large_value")


def repeated_hashes(df: DataFrame, hash_column: str, period: str) -> DataFrame:
    """(hash, n_periods): the same content under more than one period."""
    return df.filter(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.count_distinct(period).alias("n_periods")).filter("n_periods > 1")


def one_file_per_period(df: DataFrame, period: str, file: str) -> DataFrame:
    """(period, n_files): periods that come from more than one file."""
    return df.groupBy(period).agg(F.count_distinct(file).alias("n_files")).filter("n_files > 1")


def record_invariants(facts: DataFrame) -> DataFrame:
    """(fact_id, rule): facts that break a contract rule: a numeric type with a raw but no normalised value; a formula
    flag that disagrees with formula text or cache status."""
    numeric = F.col("value_type").isin("integer", "decimal", "percentage", "currency")
    no_value = numeric & F.col("raw_value").isNotNull() & F.col("normalized_value").isNull()
    formula = F.col("is_formula") != (F.col("formula").isNotNull() & (F.col("formula_cache_status") != "not_formula"))
    found = F.filter(F.array(F.when(no_value, "normalized_value_missing"), F.when(formula, "formula_fields_disagree")), lambda r: r.isNotNull())
    return facts.select("fact_id", F.explode(found).alias("rule"))


def severity(checks: list[tuple[Column, str, str]]) -> Column:
    """struct(status, code) of ordered checks (failed, status, code): a later ERROR replaces what came before, a WARN
    only a PASS."""
    out = F.struct(F.lit("PASS").alias("status"), F.lit("").alias("code"))
    for failed, status, code in checks:
        new = F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
        out = F.when(failed if status == "ERROR" else failed & (out["status"] == "PASS"), new).otherwise(out)
    return out


def may_publish(report: DataFrame) -> bool:
    """False if any row of a report has status ERROR."""
    return report.filter("status = 'ERROR'").limit(1).count() == 0


def npl_identity(facts: DataFrame) -> DataFrame:
    """(period_end, entity_code, npl, parts, gap): where the non-performing balance differs from the sum of its three
    classes by more than half the shown precision of all four; incomplete sets don't show."""
    codes = ["nonperforming_loan_balance", "substandard_loan_balance", "doubtful_loan_balance", "loss_loan_balance"]
    x = facts.filter(F.col("metric_code").isin(*codes) & F.col("value").isNotNull())
    total = F.col("metric_code") == codes[0]
    g = x.groupBy("period_end", "entity_code").agg(
        F.count_distinct("metric_code").alias("n"), F.max(F.when(total, F.col("value"))).alias("npl"), F.sum(F.when(~total, F.col("value"))).alias("parts"), F.sum(display_precision(F.col("value_display")) / 2).alias("tolerance")
    )
    return g.withColumn("gap", F.abs(F.col("npl") - F.col("parts"))).filter("n = 4 and gap > tolerance").select("period_end", "entity_code", "npl", "parts", "gap")


# The sums that monthly tables must keep, dataset -> (metric, total line, parts). Property tables have
# parts that may only be no larger than their total (part_over_total).
IDENTITIES = {
    "life_insurance_monthly": [(m, "all", ["life", "accident", "health"]) for m in ("original_premium_income", "sum_insured", "policy_count")],
    "insurance_industry_monthly": [(m, t, p) for m in ("original_premium_income", "claims_paid") for t, p in (("all", ["property_insurance", "personal_insurance"]), ("personal_insurance", ["life_insurance", "health_insurance", "accident_insurance"]))],
}


def product_identities(facts: DataFrame, dataset: str) -> DataFrame:
    """(source_file, metric_code, parts, total_value, parts_value, gap): where a total differs from the sum of its parts
    by more than 2 in a file of whole numbers, else 0.02; sets with a part missing don't show."""
    tolerance = facts.filter("value is not null").groupBy("source_file").agg(F.when(precision_unit(F.col("value")) == 1, 2.0).otherwise(0.02).alias("tolerance"))
    out = None
    for metric, total, parts in IDENTITIES[dataset]:
        line = F.col("product_line")
        g = facts.filter((F.col("metric_code") == metric) & line.isin(total, *parts)).groupBy("source_file").agg(
            F.max(F.when(line == total, F.col("value"))).alias("total_value"), F.sum(F.when(line.isin(*parts), F.col("value"))).alias("parts_value"), F.count_distinct(F.when(line.isin(*parts) & F.col("value").isNotNull(), line)).alias("n")
        )
        part = g.filter(F.col("n") == len(parts)).select("source_file", F.lit(metric).alias("metric_code"), F.lit("+".join(parts)).alias("parts"), "total_value", "parts_value", F.abs(F.col("total_value") - F.col("parts_value")).alias("gap"))
        out = part if out is None else out.unionByName(part)
    return out.join(tolerance, "source_file").filter("gap > tolerance").drop("tolerance")


def part_over_total(facts: DataFrame) -> DataFrame:
    """(source_file, metric_code, product_line, value, total_value): parts larger than their total by more than 2 in a
    file of whole numbers, else 0.02."""
    whole = F.when(precision_unit(F.col("value")) == 1, 2.0).otherwise(0.02)
    totals = facts.filter("product_line = 'all' and value is not null").groupBy("source_file", "metric_code").agg(F.max("value").alias("total_value"))
    tolerance = facts.filter("value is not null").groupBy("source_file").agg(whole.alias("tolerance"))
    x = facts.filter("product_line <> 'all' and value is not null").join(totals, ["source_file", "metric_code"]).join(tolerance, "source_file")
    return x.filter("value - total_value > tolerance").select("source_file", "metric_code", "product_line", "value", "total_value")


def _keys(**lines: list[str]) -> list[tuple[str, str]]:
    return [(m, p) for m, ps in lines.items() for p in ["all", *ps]]


def _expected() -> dict[str, dict[str, list[tuple[str, str]]]]:
    """Which (metric, line) keys a monthly table of each version holds."""
    life = _keys(original_premium_income=["life", "accident", "health"], policyholder_investment_new_contribution=[], unit_linked_account_new_contribution=[], claims_paid=[], total_assets=[])
    detailed = life + _keys(sum_insured=["life", "accident", "health"], policy_count=["life", "ordinary_life", "accident", "health"])
    new_sum = life + _keys(new_sum_insured=[])
    old = _keys(original_premium_income=["enterprise_property", "household_property", "motor_vehicle", "engineering", "liability", "guarantee", "agriculture", "health", "accident"], claims_paid=[], sum_insured=["motor_vehicle", "liability", "agriculture", "health", "accident"], policy_count=["motor_vehicle", "liability", "cargo", "guarantee", "health", "accident"], total_assets=[])
    no_policy = _keys(original_premium_income=["motor_vehicle", "liability", "agriculture", "health", "accident"], claims_paid=[], sum_insured=["motor_vehicle", "liability", "agriculture"], total_assets=[])
    reduced = no_policy + _keys(policy_count=["motor_vehicle", "liability"])
    all_lines, top = ["property_insurance", "personal_insurance", "life_insurance", "health_insurance", "accident_insurance"], ["property_insurance", "personal_insurance"]
    placed, companies = ["bank_deposits", "bonds", "stocks_and_securities_funds"], ["reinsurance_company", "insurance_asset_management_company"]
    full = _keys(original_premium_income=all_lines, sum_insured=[], policy_count=[], claims_paid=all_lines, operating_management_expense=[], funds_employed_balance=placed, total_assets=companies, net_assets=[])
    in_2023 = _keys(original_premium_income=top, claims_paid=top, funds_employed_balance=placed, total_assets=companies, net_assets=[])
    in_2024 = _keys(original_premium_income=top, claims_paid=top, total_assets=companies, net_assets=[])
    modern = _keys(original_premium_income=top, claims_paid=top, total_assets=[*companies, "property_insurance_company", "personal_insurance_company"], net_assets=[])
    return {
        "life_insurance_monthly": {"S1_LEGACY_LABELS": detailed, "S2_MODERN_LABELS": detailed, "S3_2023_AGGREGATED": new_sum + _keys(new_policy_count=[]), "S4_2024_2025_NO_POLICY_COUNT": new_sum, "S5_2026_ACCOUNTING": new_sum},
        "property_insurance_monthly": {"S1_LEGACY_LABELS": old, "S2_MODERN_LABELS": old, "S3_REDUCED_BREAKDOWNS": reduced, "S4_NO_POLICY_COUNT": no_policy, "S5_2026_ACCOUNTING": no_policy},
        "insurance_industry_monthly": {"S1_FULL_DETAILS": full, "S2_2023_REDUCED": in_2023, "S3_2024_NO_INVESTMENTS": in_2024, "S4_2025_ASSET_BREAKDOWN": modern, "S5_2026_ACCOUNTING": modern},
    }


def expected_keys(facts: DataFrame, versions: DataFrame, dataset: str) -> DataFrame:
    """(source_file, schema_version, metric_code, product_line, side): keys that a file of its version lacks (missing)
    or shouldn't hold (extra)."""
    rows = [(v, m, p) for v, keys in _expected()[dataset].items() for m, p in keys]
    want = facts.sparkSession.createDataFrame(rows, "schema_version string, metric_code string, product_line string")
    key = ["source_file", "schema_version", "metric_code", "product_line"]
    return key_set_difference(versions.join(want, "schema_version"), facts.select("source_file", "metric_code", "product_line").join(versions, "source_file"), key)


# Facts per file, dataset -> (year from, number); the last year reached holds. Balance tables have 40 per period.
FACT_COUNTS = {
    "insurance_funds_investment": [(0, 45), (2025, 26)], "insurance_solvency": [(0, 48), (2025, 32)], "inclusive_small_business_loans": [(0, 20)], "inclusive_agricultural_loans": [(0, 20)],
    "affordable_housing_loans": [(0, 28)], "commercial_bank_indicators_by_type": [(0, 264)], "commercial_bank_regulatory_indicators": [(0, 148), (2024, 152)],
}


def unexpected_counts(facts: DataFrame) -> DataFrame:
    """(source_file, dataset_id, n_facts, n_expected): files whose number of facts isn't the one of their dataset and year."""
    g = facts.groupBy("source_file", "dataset_id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("period_end").alias("periods"), F.max(F.year("period_end")).alias("y"))
    want = F.when(F.col("dataset_id").startswith("bank_balance_"), F.col("periods") * 40)
    for dataset, numbers in FACT_COUNTS.items():
        for year, n in sorted(numbers, reverse=True):
            want = want.when((F.col("dataset_id") == dataset) & (F.col("y") >= year), n)
    return g.select("source_file", "dataset_id", "n_facts", want.cast("long").alias("n_expected")).filter("n_facts <> n_expected")


def comparability(facts: DataFrame) -> DataFrame:
    """(source_file, dataset_id, flags): the comparability caveats of each file, sorted; files without any don't show."""
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("comparability_flag", r"\|")))))
    return facts.groupBy("source_file", "dataset_id").agg(F.filter(flags, lambda f: f != "").alias("flags")).filter("size(flags) > 0")


def national_gap(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, national, regions, gap): where the national value differs from the sum of the regions by more than their
    rounding (half a cent each) and by more than 1 or 0.05 percent."""
    national = F.col("region_type") == "national"
    g = facts.filter("value is not null").groupBy(*keys).agg(F.max(F.when(national, F.col("value"))).alias("national"), F.sum(F.when(~national, F.col("value"))).alias("regions"), F.count(F.lit(1)).alias("n"))
    x = g.withColumn("gap", F.col("national") - F.col("regions"))
    off = F.abs("gap")
    return x.filter((off > 0.005 * F.col("n")) & ((off > 1) | (off > 0.0005 * F.abs("national")))).drop("n")
