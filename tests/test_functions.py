from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veriloom.functions import dates, ids, numbers, text


def one(spark, column, **values):
    cols = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).select(column.alias("x")).first()["x"]


def per(spark, make, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(make(F.col("v"))).collect()]


def test_parsed_decimal(spark):
    got = per(spark, numbers.parsed_decimal, ["3.40%", "—", "(1,234.5)", "2.5000005", "#REF!", "x", "", None, "0"])
    assert [(g["value"], g["status"]) for g in got] == [
        (Decimal("3.400000"), "reported"), (None, "not_reported"), (Decimal("-1234.500000"), "reported"), (Decimal("2.500000"), "reported"),
        (None, "parse_error"), (None, "parse_error"), (None, "missing"), (None, "missing"), (Decimal("0E-6"), "reported_zero"),
    ]
    assert got[3]["flags"] == ["PRECISION_ROUNDED_6DP"] and got[2]["flags"] == ["NEGATIVE_VALUE"] and got[4]["flags"] == ["EXCEL_ERROR"]


def test_premium_decimal_takes_no_percent(spark):
    got = per(spark, numbers.premium_decimal, ["3.40%", "1,000", "(5)", None])
    assert [(g["value"], g["flag"]) for g in got] == [(None, "NON_NUMERIC_VALUE"), (Decimal("1000"), None), (Decimal("-5"), "NEGATIVE_VALUE"), (None, None)]


@pytest.mark.parametrize(
    "value,fmt,want",
    [(12461.058486995, "0_ ", "12461"), (0.0223489054088857, "0.00%", "2.23%"), (-1234.5, "#,##0.0;(#,##0.0)", "(1,234.5)"), (0.5, "0", "1"), (7.0, None, "7.0"), (-2.0, "0", "-2")],
)
def test_shown(spark, value, fmt, want):
    assert one(spark, numbers.shown(F.lit(value), F.lit(fmt).cast("string"))) == want


def test_small_numbers(spark):
    assert per(spark, numbers.plain_decimal, ["1.500", "10", "10.00", None]) == ["1.5", "10", "10", None]
    assert per(spark, numbers.option_number, ["25%", "1,000", "abc"]) == [0.25, 1000.0, None]
    assert per(spark, numbers.display_precision, ["1.25", "7"]) == [0.01, 1.0]
    assert one(spark, numbers.metric_unit(F.lit("x"), F.lit("不良贷款率"))) == "%" and one(spark, numbers.metric_unit(F.lit("net_profit_ytd"), F.lit("净利率"))) == "亿元"


def test_periods(spark):
    got = per(spark, lambda c: dates.period_from_token(F.lit(2025), c), ["四季度末", "2月", "13月", "合计", None])
    assert got[0]["end"] == date(2025, 12, 31) and got[0]["start"] == date(2025, 10, 1) and got[0]["frequency"] == "quarter"
    assert got[1]["end"] == date(2025, 2, 28) and got[2:] == [None, None, None]
    assert one(spark, dates.quarter_from_filename(F.lit(2024), F.lit("1_2024年二季度保险.xlsx")))["end"] == date(2024, 6, 30)


def test_question_periods(spark):
    q = ["2023年10月人身险", "2024年", "2024年3月5日和2024年3月", "2022年第一季度与2022年", "没有", None]
    assert per(spark, dates.question_periods, q) == [["2023-10-31"], ["2024-12-31"], ["2024-03-05"], ["2022-03-31"], [], []]


def test_text(spark):
    assert per(spark, text.label_key, ["其中：财产保险公司", "1.其中：寿险*", "（一）资产 总额", None]) == ["财产保险公司", "寿险", "资产总额", None]
    assert per(spark, text.clause, ["第十二条 内容", "三、其他", "普通", None]) == ["第十二条", "三、", None, None]
    assert per(spark, text.estimate_tokens, ["中文ab 12.5!", "", None]) == [5, 1, 1]
    assert per(spark, text.bigrams, ["资本充足", "资"]) == [["资本", "本充", "充足"], []]
    assert per(spark, text.file_key, ["a/B-1 表.XLSX", "x"]) == ["b1表", "x"]
    assert per(spark, text.attachment_id, ["附件/012_x.pdf", "none"]) == ["012", None]
    assert per(spark, text.redacted, [r"token=abc at C:\secret\x"])[0] == "token=***REDACTED*** at [path hidden]"
    assert per(spark, text.model_json, ['```json\n{"a": 1}\n```', "none"]) == ['{"a": 1}', None]
    assert per(spark, text.numbers_in, ["约1,234.5元，占12％，A5不算", None]) == [["1234.5", "12%"], None]
    assert one(spark, text.substring_coverage(F.lit("abcd"), F.lit("xxbcdyy"))) == 0.75


def test_stable_id_matches_the_json_array_form(spark):
    import hashlib
    import json

    want = "chunk_" + hashlib.sha256(json.dumps(["中\"\n", None, "x"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]
    assert one(spark, ids.stable_id("chunk", F.lit('中"\n'), F.lit(None), F.lit("x"))) == want
