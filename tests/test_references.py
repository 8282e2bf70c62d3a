from datetime import datetime

from veriloom.operators import references as refs

T = datetime


def frames(spark):
    facts = spark.createDataFrame(
        [("f1", "e1", "d1", T(2024, 1, 5)), ("f2", "e9", None, T(2024, 1, 5)), ("f3", "e2", "d1", T(2024, 2, 1)), ("f4", "e3", "", T(2024, 2, 1)), ("f4", "e3", "", T(2024, 4, 1)), ("f5", "E1", "d1", None)],
        "fact_id string, evidence_id string, document_id string, created_at timestamp",
    )
    parents = spark.createDataFrame([("p1", ["e1", "e9", "e9", None], T(2024, 1, 1)), ("p2", None, T(2024, 1, 1)), ("p3", [], T(2024, 1, 1))], "parent_chunk_id string, evidence_ids array<string>, created_at timestamp")
    evidence = spark.createDataFrame([("e1", T(2024, 1, 2), None), ("e1", T(2024, 1, 2), None), ("e2", T(2020, 1, 1), T(2024, 1, 1)), ("e3", T(2024, 3, 1), None), (None, None, None)], "evidence_id string, created_at timestamp, deleted_at timestamp")
    documents = spark.createDataFrame([("d1", T(2020, 1, 1), None)], "document_id string, created_at timestamp, deleted_at timestamp")
    link = lambda f, t: refs.Link("table_facts", "fact_id", f, t, period="created_at")
    r = refs.references(facts, [link("evidence_id", "evidence"), link("document_id", "documents")]).unionByName(refs.references(parents, [refs.Link("parent_chunks", "parent_chunk_id", "evidence_ids", "evidence", period="created_at")]))
    return r, refs.targets({"evidence": (evidence, "evidence_id"), "documents": (documents, "document_id")})


def test_reasons(spark):
    got = {(r["record_id"], r["field_name"], r["ref_id"], r["reason"]) for r in refs.orphans(*frames(spark)).collect()}
    assert got == {
        ("f2", "evidence_id", "e9", "missing"),
        ("f3", "evidence_id", "e2", "deleted"),
        ("f4", "evidence_id", "e3", "late"),
        ("f4", "document_id", "", "missing"),
        ("f5", "evidence_id", "E1", "missing"),
        ("p1", "evidence_ids", "e1", "late"),
        ("p1", "evidence_ids", "e9", "missing"),
    }


def test_counts_keep_sound_periods(spark):
    c = {(r["table_name"], r["field_name"], r["period"]): r for r in refs.orphan_counts(*frames(spark)).collect()}
    assert c["table_facts", "evidence_id", "2024-04"]["n_refs"] == 1 and c["table_facts", "evidence_id", "2024-04"]["n_late"] == 0
    assert c["parent_chunks", "evidence_ids", "2024-01"]["n_missing"] == 2 and c["parent_chunks", "evidence_ids", "2024-01"]["n_orphan_ids"] == 2


def test_empty(spark):
    r, t = frames(spark)
    assert refs.orphans(r.limit(0), t).count() == 0
    assert refs.orphans(r, t.limit(0)).filter("reason <> 'missing'").count() == 0
