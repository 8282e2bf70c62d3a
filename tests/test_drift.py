import json

from pyspark.sql import functions as F

from veriloom.operators import drift

SCHEMA = "feed_id string, file_no int, source_file string, period_end date, payload string"


def raw(spark, files, extra=()):
    rows = [("f", n, f"file{n}", None, json.dumps(rec, ensure_ascii=False)) for n, recs in files.items() for rec in recs]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def found(df):
    return sorted((r["source_file"], r["change_kind"], r["field_name"], r["prior_name"]) for r in drift.changes(df).collect())


FILES = {
    1: [{"rec_key": "a", "value": 1.5, "unit": "X", "flag": True, "note": None}, {"rec_key": "b", "value": 2, "unit": "Y", "flag": False}],
    2: [{"rec_key": "b", "amount": 2, "unit": {"code": "Y"}, "flag": False, "Note": "n"}],
    4: [{"rec_key": "b", "amount": 2, "unit": {"code": "Y"}, "Note": "n", "tags": ["t"]}, {"rec_key": "c", "amount": None}],
}
WANT = [
    ("file2", "added", "Note", ""),
    ("file2", "removed", "note", ""),
    ("file2", "renamed", "amount", "value"),
    ("file2", "type_changed", "unit", ""),
    ("file4", "added", "tags", ""),
    ("file4", "removed", "flag", ""),
]


def test_changes(spark):
    df = raw(spark, FILES)
    assert found(df) == WANT
    assert found(df.unionByName(df)) == WANT  # delivered twice


def test_bad_rows_change_nothing(spark):
    bad = [(None, 2, "x", None, '{"z": 1}'), ("f", None, "x", None, '{"z": 1}'), ("f", 3, "file3", None, None)]
    df = raw(spark, FILES, bad[:2])
    assert found(df) == WANT
    assert found(raw(spark, {}, [])) == []
    # A file whose payloads are no objects has no fields: all go, and come back.
    kinds = {(s, k) for s, k, _, _ in found(raw(spark, FILES, bad[2:]))}
    assert ("file3", "removed") in kinds and ("file4", "added") in kinds


def test_same_null_content_is_no_rename(spark):
    df = raw(spark, {1: [{"rec_key": "a", "p": None}], 2: [{"rec_key": "a", "q": None}]})
    assert found(df) == [("file2", "added", "q", ""), ("file2", "removed", "p", "")]


def test_ambiguous_renames_pair_by_name_once(spark):
    df = raw(spark, {1: [{"rec_key": "a", "p": 1, "r": 1}], 2: [{"rec_key": "a", "q": 1, "s": 1}]})
    assert found(df) == [("file2", "renamed", "q", "p"), ("file2", "renamed", "s", "r")]


def test_versions_and_migrations(spark):
    df = raw(spark, FILES | {5: FILES[4]})
    assert [(r["file_no"], r["version"]) for r in drift.schema_versions(df).orderBy("file_no").collect()] == [(1, 1), (2, 2), (4, 3), (5, 3)]
    steps = [(r["step_no"], r["step"]) for r in drift.migrations(df).filter("file_no = 2").orderBy("step_no").collect()]
    assert steps == [(1, "rename"), (2, "default"), (3, "extend"), (4, "cast")]


def test_one_consistent_table(spark):
    rows = {(r["file_no"], r["rec"]): r for r in drift.consistent(raw(spark, FILES), ["value", "unit"]).collect()}
    assert rows[1, "a"]["value"] == "1.5" and rows[2, "b"]["value"] == "2" and rows[4, "c"]["value"] is None
    assert rows[2, "b"]["unit"] == "Y" and rows[1, "b"]["extra_fields"] == {"flag": "false"}
    assert rows[4, "b"]["extra_fields"]["tags"] == "t" and len(rows) == 5



def test_routes_follow_chains_and_ask_other_feeds_only_without_doubt(spark):
    one = [("f", n, f"f{n}", None, json.dumps(r)) for n, r in ((1, {"rec_key": "k", "a": 7}), (2, {"rec_key": "k", "b": 7}), (3, {"rec_key": "k", "unit": 7}), (4, {"rec_key": "k", "c": 7, "d": 1}), (5, {"rec_key": "k", "c": 7, "a": 5}))]
    other = [("g", 1, "g1", None, '{"rec_key": "x", "b": "1", "z": "2"}'), ("h", 1, "h1", None, '{"rec_key": "x", "p": 3}'), ("h", 2, "h2", None, '{"rec_key": "x", "value": 3}'), ("i", 1, "i1", None, '{"rec_key": "x", "p": 4}'), ("i", 2, "i2", None, '{"rec_key": "x", "unit": 4}'), ("j", 1, "j1", None, '{"rec_key": "x", "p": 5}')]
    df = spark.createDataFrame([*one, *other], SCHEMA)
    got = {(r["feed_id"], r["file_no"], r["name"]): (r["to"], r["level"]) for r in drift.routes(df, ["value", "unit"]).filter("name <> 'rec_key'").collect()}
    assert [got["f", n, c] for n, c in ((1, "a"), (2, "b"), (3, "unit"), (4, "c"), (5, "c"))] == [("unit", 0)] * 5
    # A name that comes back is another stretch, and no chain of its feed leads on from it; other chains tell where it leads.
    assert got["f", 5, "a"] == ("unit", 1) and got["g", 1, "b"] == ("unit", 1) and got["g", 1, "z"] == ("z", 2)
    assert got["h", 1, "p"] == ("value", 0) and got["i", 1, "p"] == ("unit", 0) and got["j", 1, "p"] == ("p", 2)
    rows = {(r["feed_id"], r["file_no"]): r for r in drift.consistent(df, ["value", "unit"]).collect()}
    # Both fields of a record lead to one column: the chain's has it, the other stays under its own name.
    assert rows["f", 5]["unit"] == "7" and rows["f", 5]["extra_fields"] == {"a": "5"}
    assert rows["j", 1]["extra_fields"] == {"p": "5"}


def test_records_without_a_key_stay_rows_of_their_own(spark):
    df = raw(spark, {1: [{"value": 1}, {"value": 2}, {"rec_key": None, "value": 3}, {"value": 2}]})
    assert sorted(r["value"] for r in drift.consistent(df, ["value"]).collect()) == ["1", "2", "3"]
    ids = df.withColumn("raw_id", F.monotonically_increasing_id())
    assert drift.consistent(ids, ["value"]).count() == 4
    assert drift.consistent(df.limit(0), ["value"]).count() == 0 and drift.migrations(df.limit(0)).count() == 0
