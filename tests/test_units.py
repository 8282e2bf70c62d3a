import pytest
from pyspark.sql import functions as F

from veriloom.operators import units

SCHEMA = "fact_id string, source_id string, metric_name string, raw_value string, normalized_value string, unit string, scale string"


def rows(spark, *data):
    return spark.createDataFrame([(str(i), "s", "m", *x) for i, x in enumerate(data)], SCHEMA)


CASES = [
    # raw, unit, scale, family, common value
    ("36.91", "CNY_100M", "1", "money", 36.91),
    ("3,877,756", "CNY_1K", None, "money", 38.77756),
    ("816.5", "CNY", "亿", "money", 816.5),
    ("(44.49)", "CNY_100M", None, "money", -44.49),
    ("0.03388", "ratio", None, "ratio", 3.388),
    ("7,605 个基点", None, None, "ratio", 76.05),
    ("千分之(15.95)", None, None, "ratio", -1.595),
    ("百分之 155.6 ", None, None, "ratio", 155.6),
    ("CNY (305.72) bn", None, None, "money", -3057.2),
    ("RMB 92.0647 mn", None, None, "money", 0.920647),
    ("3441763万", None, None, "money", 344.1763),
    ("  1593537*m CNY", None, None, "money", 15935.37),
    ("493677 million yuan", None, None, "money", 4936.77),
    (" 0.29982*m items", None, None, "count", 299820.0),
    ("0.845万件", None, None, "count", 8450.0),
    ("12531件", None, None, "count", 12531.0),
    ("７．５％", None, None, "ratio", 7.5),
    ("202388272 万元", "CNY_10K", "1", "money", 20238.8272),
    ("5", "百件", None, "count", 500.0),
    ("1.5", "CNY", "1e6", "money", 0.015),
    ("未披露", "PERCENT", "1", "ratio", None),
    (None, None, None, None, None),
    ("", None, None, None, None),
]


def test_units_and_scales(spark):
    df = rows(spark, *((r, None, u, s) for r, u, s, _, _ in CASES))
    got = {r["fact_id"]: r for r in units.convert(df).collect()}
    assert len(got) == len(CASES)
    for i, (raw, unit, scale, family, value) in enumerate(CASES):
        r = got[str(i)]
        assert r["unit_family"] == family, (raw, unit)
        assert r["common_value"] == (None if value is None else pytest.approx(value)), (raw, unit, scale)


def test_bare_numbers_without_a_unit_go_to_review(spark):
    r = units.convert(rows(spark, ("12.5", "12.5", None, None), ("3", "3", "parsec", None))).collect()
    assert [x["unit_source"] for x in r] == ["review", "review"] and all(x["needs_review"] for x in r)


def test_misscaled_and_repeats(spark):
    df = rows(spark, ("100", "1", "PERCENT", "1"), ("100", "100.05", "PERCENT", "1"), ("0", "0", "bp", None), ("0", "1", "bp", None), ("5%", None, None, None), ("5%", "no", None, None))
    df = df.unionByName(df)
    assert sorted(r[0] for r in units.misscaled(units.convert(df)).collect()) == ["0", "3", "5"]


def test_empty_and_clashing_columns(spark):
    df = rows(spark, ("1", "1", "PERCENT", None)).withColumns({"common_value": F.lit(9), "_value": F.lit(1), "extra": F.lit("e")})
    out = units.convert(df)
    assert out.filter("common_value = 1").count() == 1 and "extra" in out.columns
    assert units.misscaled(units.convert(df.limit(0))).count() == 0


def test_ensemble_is_calibrated_on_held_out_rows(spark, data):
    facts = spark.read.parquet(f"{data}/../sf0.01/table_facts.parquet")
    parsed = units.parsed(facts)
    model = units.UnitModel(units.Bounds(sample=4000)).fit(parsed, "fact_id")
    assert model.accuracy > 0.5
    assert model.sure_accuracy is None or model.sure_accuracy > 0.85
    # Held against the words in raw_value of rows whose unit field is missing.
    told = model.predict(parsed.filter("_field is null and _text is not null")).filter("_chance >= 0.9").agg(F.avg((F.col("_unit.family") == F.col("_text.family")).cast("int"))).first()[0]
    assert told is None or told > 0.85


def test_spellings_beyond_the_local_bound_join_alike(spark):
    df = rows(spark, *((r, None, u, s) for r, u, s, _, _ in CASES))
    a, b = (sorted(map(str, units.parsed(df, most=n).collect())) for n in (5_000, 0))
    assert a == b


def test_ensemble_converts_and_words_check_it(spark):
    df = rows(spark, *((f"{x}{u}", None, None, None) for x in range(1, 40) for u in ("万元", "%", "千件", "亿元")), ("7", None, None, None))
    got = units.convert(df).collect()
    told = [r for r in got if r["raw_value"] != "7"]
    assert all(r["unit_source"] == "predicted" and r["agrees"] and r["unit_chance"] >= 0.9 for r in told)

    class Wrong(units.UnitModel):
        def predict(self, rows):
            return rows.withColumns({"_unit": F.struct(F.lit("money").alias("family"), F.lit(1).alias("power")), "_chance": F.lit(1.0)})

    # A confident prediction that the words contradict is not converted.
    wrong = units.convert(df, model=Wrong())
    assert wrong.filter("raw_value <> '7' and unit_source <> 'review'").count() == 0
    assert {r["fact_id"] for r in units.review_queue(wrong).collect()} == {r["fact_id"] for r in told}
