import json

from pyspark.sql import functions as F

from veriloom import queries
from veriloom.operators import drift


def test_spellings_are_unified(spark):
    said = ["2.0", "v2", "V2", " v2 ", "V2_2022", "V2-2022", "v2.2022", "10.0", "2.1", "draft", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(said)], "i int, v string").orderBy("i").select(drift.unified_version(F.col("v"))).collect()]
    assert got == ["V2"] * 4 + ["V2_2022"] * 3 + ["V10", "2_1", "DRAFT", None, None]


def test_files_tell_their_delivered_versions(spark, tmp_path):
    rows = [("f", 1, "a", None, "d", json.dumps({"rec_key": "r", "x": 1}), v) for v in ("2.0", "v2", None)] + [("f", 2, "b", None, "d", json.dumps({"rec_key": "r", "y": 1}), "V3-2022")]
    spark.createDataFrame(rows, "feed_id string, file_no int, source_file string, period_end date, dataset string, payload string, schema_version string").write.parquet(f"{tmp_path}/raw_records.parquet")
    got = {r["file_no"]: (r["version"], r["delivered_schema_versions"], r["n_no_schema_version"]) for r in queries.p5_schema_versions(spark, str(tmp_path)).collect()}
    assert got == {1: (1, ["V2"], 1), 2: (2, ["V3_2022"], 0)}


def test_facts_tell_their_versions(spark, tmp_path):
    for t, rows in (("region_premium_facts", [("a", "2.0", "S1"), ("a", "v2", None)]), ("life_insurance_facts", [("b", "V3-2022", "s1")])):
        spark.createDataFrame(rows, "source_file string, schema_version string, scope_version string").write.parquet(f"{tmp_path}/{t}.parquet")
    got = sorted(tuple(map(str, r)) for r in queries.p5_fact_versions(spark, str(tmp_path)).collect())
    assert got == [
        ("life_insurance_facts", "b", "schema_version", "V3_2022", "1", "1"), ("life_insurance_facts", "b", "scope_version", "S1", "1", "1"),
        ("region_premium_facts", "a", "schema_version", "V2", "2", "2"), ("region_premium_facts", "a", "scope_version", "None", "0", "1"),
        ("region_premium_facts", "a", "scope_version", "S1", "1", "1"),
    ]
