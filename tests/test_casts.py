import json
from decimal import Decimal

from veriloom.operators import drift


def raw(spark, files):
    rows = [("f", n, f"file{n}", None, json.dumps(rec, ensure_ascii=False)) for n, recs in files.items() for rec in recs]
    return spark.createDataFrame(rows, "feed_id string, file_no int, source_file string, period_end date, payload string")


FILES = {
    1: [{"rec_key": "a", "value": 97723.52, "branch_count": 7865, "note": "1,234"}, {"rec_key": "b", "value": 2, "branch_count": 3}],
    2: [
        {"rec_key": "a", "value": {"num": 97723.52, "dp": 2}, "branch_count": {"num": 7865, "dp": 0}},
        {"rec_key": "c", "value": {"num": "1,292.74"}, "branch_count": None},
    ],
    3: [{"rec_key": "a", "value": "97,723.52", "branch_count": "7,865"}, {"rec_key": "d", "value": "-1,292.74"}],
    4: [{"rec_key": r, "value": v} for r, v in (("e", "n/a"), ("f", "1,29"), ("g", "0.1234567"), ("h", {"x": 1}), ("i", None), ("j", ""))],
}


def test_fields_of_changed_type_are_cast(spark):
    t = drift.consistent(raw(spark, FILES), {"value": "decimal(20,6)", "unit": "string"})
    assert dict(t.dtypes)["value"] == "decimal(20,6)"
    rows = {(r["file_no"], r["rec"]): r for r in t.collect()}
    assert [rows[n, "a"]["value"] for n in (1, 2, 3)] == [Decimal("97723.52")] * 3
    assert rows[2, "c"]["value"] == Decimal("1292.74") and rows[3, "d"]["value"] == Decimal("-1292.74")
    assert [rows[n, "a"]["extra_fields"]["branch_count"] for n in (1, 2, 3)] == ["7865"] * 3
    assert rows[1, "a"]["extra_fields"]["note"] == "1,234"  # no record has a number there


def test_what_fails_to_cast_is_kept_and_reported(spark):
    t = drift.consistent(raw(spark, FILES), {"value": "decimal(20,6)"})
    rows = {r["rec"]: r for r in t.filter("file_no = 4").collect()}
    assert {k: r["uncast_fields"] for k, r in rows.items() if r["uncast_fields"]} == {"e": {"value": "n/a"}, "f": {"value": "1,29"}, "g": {"value": "0.1234567"}, "h": {"value": '{"x":1}'}, "j": {"value": ""}}
    assert all(r["value"] is None for r in rows.values())
    assert [tuple(r) for r in drift.cast_failures(t).collect()] == [("f", 4, "file4", "uncast", "value", 5, "")]
