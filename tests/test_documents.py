import json

import pytest
from pyspark.sql import functions as F

from veriloom.functions import arrays
from veriloom.operators import documents as D
from veriloom.operators import gates, jobs, questions, retrieval
from veriloom.plans import planner
from veriloom.session import numbered
from veriloom.sources import corpus, sinks


def test_parsed_documents_are_inspected(spark):
    good = {"schema_name": "Parsed", "name": "n", "version": "1", "texts": [{"text": "a", "label": "formula"}, {"text": " "}], "tables": [{}], "pictures": [{"annotations": [{"kind": "description", "text": "d"}]}, {}], "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/9"}, {"x": [{"$ref": "#/tables/0"}, {"$ref": "#/odd"}]}]}}
    rows = [("good", json.dumps(good)), ("schema", '{"schema_name": "x"}'), ("broken", "{"), ("null", None), ("bare", '{"schema_name": "Parsed", "name": "n", "version": "1"}'), ("noname", '{"schema_name": "Parsed", "version": "1", "texts": [{"text": "t"}]}')]
    got = {r["k"]: r for r in D.inspect_parsed(spark.createDataFrame(rows, "k string, p string"), "k", "p", "Parsed").collect()}
    g = got["good"]
    assert (g["problem"], g["n_texts"], g["n_formulas"], g["n_empty"], g["n_described"], g["n_pictures"]) == (None, 2, 1, 1, 1, 2)
    assert g["unresolved"] == ["#/odd", "#/texts/9"] and g["status"] == "requires_review" and g["flags"] == ["empty_text_elements", "unresolved_body_references", "pictures_without_description"]
    assert {k: r["problem"] for k, r in got.items() if k != "good"} == {"schema": "wrong_schema", "broken": "not_json", "null": "not_json", "bare": "no_elements", "noname": "no_name_or_version"}


def test_elements_tables_and_evidence(spark):
    df = spark.createDataFrame([("#/texts/1", "title"), ("#/texts/2", "other"), ("#/tables/0", None), ("#/pictures/0", None), ("#/x", None)], "r string, l string")
    assert [r[0] for r in df.select(D.element_kind(F.col("r"), F.col("l"))).collect()] == ["heading", "paragraph", "table", "picture", None]
    cells = spark.createDataFrame([("t", 0, 2, 1, " b "), ("t", 0, 1, 0, "a"), ("t", 1, 2, 0, " "), ("t", 2, 2, 0, "z"), ("t", 1, 2, 2, None)], "t string, start_row int, end_row int, start_col int, text string")
    assert sorted((r["row"], r["text"]) for r in D.table_rows(cells, ["t"]).collect()) == [(0, "a | b"), (1, "b")]
    e = spark.createDataFrame([("e1", "table", "x"), ("e2", "heading", "y")], "element_id string, kind string, text string")
    ev = D.evidence_of(e)
    assert {r["element_id"]: r["evidence_type"] for r in ev.collect()} == {"e1": "table", "e2": "text"}
    assert D.with_evidence(e, ev).count() == 2 and D.with_evidence(e, ev).filter("evidence_id is null").count() == 0
    with pytest.raises(Exception, match="one to one"):
        D.with_evidence(e, ev.filter("element_id = 'e1'")).collect()
    q = spark.createDataFrame([("picture", "无法识别"), ("picture", None), ("picture", "ok"), ("formula", None), ("paragraph", None)], "k string, d string")
    assert [(r[0]["flag"], r[0]["model_status"]) for r in q.select(D.element_quality(F.col("k"), F.col("d"))).collect()] == [("model_description_unusable", "rejected"), ("picture_without_description", None), ("picture_description_pending_validation", "pending"), ("formula_requires_review", None), (None, None)]
    place = spark.range(1).select(D.location(F.lit(1), F.lit(0.0), F.lit(9.0), F.lit(1.0), F.lit(2.0), F.lit("#/x"), F.lit("data:abc")).alias("l")).first()["l"]
    assert (place["top"], place["bottom"], place["uri"]) == (2.0, 9.0, None)


def test_row_chunks_and_reading_order(spark):
    rows = spark.createDataFrame([("f", s, i, "x" * 10, f"A{i}:B{i}") for s in ("a", "b") for i in range(1, 6)], "file string, sheet string, row int, row_text string, source_range string")
    got = sorted((r["sheet"], r["start_row"], r["end_row"], r["source_range"], r["text"]) for r in D.row_chunks(rows, 40).collect())
    assert [x[:4] for x in got] == [(s, a, b, f"A{a}:B{b}") for s in ("a", "b") for a, b in ((1, 2), (3, 4), (5, 5))] and got[0][4] == "R1: xxxxxxxxxx\nR2: xxxxxxxxxx"
    nodes = spark.createDataFrame([("d", "root", None, 0), ("d", "b", "root", 2), ("d", "a", "root", 1), ("d", "a1", "a", 1), ("d", "loop", "loop", 1), ("d", "lost", "gone", 1)], "k string, node string, parent string, idx int")
    assert [(r["node"], r["depth"]) for r in D.reading_order(nodes, "k").orderBy("place").collect()] == [("root", 0), ("a", 1), ("a1", 2), ("b", 1)]


def test_lists_and_states(spark):
    df = spark.createDataFrame([("a", ["y", "x", None], "warning"), ("a", None, "rejected"), ("a", ["x"], "odd"), ("b", None, None)], "k string, f array<string>, s string")
    got = {r["k"]: (r["u"], r["w"]) for r in df.groupBy("k").agg(arrays.union_sorted(F.col("f")).alias("u"), arrays.worst(F.col("s")).alias("w")).collect()}
    assert got == {"a": (["x", "y"], "rejected"), "b": ([], None)}
    assert df.select(arrays.split_flags(F.lit("a||b")), arrays.join_flags(F.col("f"))).first()[0] == ["a", "b"]


def test_corpus_is_written_once_and_told(spark, tmp_path):
    a, b = spark.createDataFrame([("1", "x"), ("2", None)], "id string, t string"), spark.createDataFrame([("2", None), ("1", "x")], "id string, t string")
    told = corpus.write_corpus({"chunks": a}, f"{tmp_path}/c", {"chunks": "id"})
    assert told["chunks"]["count"] == 2 and told["chunks"] == corpus.content_hash(b) and spark.read.json(f"{tmp_path}/c/chunks").count() == 2
    with pytest.raises(FileExistsError):
        corpus.write_corpus({"chunks": a}, f"{tmp_path}/c", {})
    with pytest.raises(ValueError):
        corpus.write_corpus({"chunks": a.unionByName(spark.createDataFrame([("1", "y")], "id string, t string"))}, f"{tmp_path}/d", {"chunks": "id"})


def test_index_is_saved_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "id int, text string")
    index = retrieval.bm25_index(docs, "id", "text")
    corpus.save_index(index, f"{tmp_path}/i")
    loaded = corpus.load_index(spark, f"{tmp_path}/i")
    q = spark.createDataFrame([("q", "beta alpha")], "query_id string, text string")
    hits = [sorted((r["id"], r["score"], r["rank"]) for r in h.collect()) for h in (retrieval.bm25_search(q, index, "id"), retrieval.bm25_search(q, loaded, "id"), retrieval.bm25_query(q, docs, "id", "text"), retrieval.bm25_query(q, docs, "id", "text", vocabulary=None))]
    assert hits[0] == hits[1] == hits[2] == hits[3]
    with pytest.raises(ValueError):
        corpus.load_index(spark, f"{tmp_path}/i", "other")


def test_manifests_runs_and_files(spark, tmp_path):
    m = dict.fromkeys(corpus.MANIFEST, 1) | {"embedding_model": "m", "embedding_dimensions": 8, "smoke_passed": True}
    assert corpus.manifest_problems(m, "m", 8, 1) == [] and corpus.manifest_problems({}, "m", 8)[0] == "missing:snapshot_id"
    assert corpus.manifest_problems(m | {"smoke_passed": False, "fact_count": 0, "embedding_dimensions": 9}, "m", 8, 2) == ["smoke_failed", "empty_store", "other_embedding", "point_count_differs"]
    with pytest.raises(ValueError):
        corpus.require_passed(spark.createDataFrame([("r", "failed")], "run_id string, status string"))
    (tmp_path / "a.txt").write_text("sk-" + "a" * 30)
    (tmp_path / "b.yaml").write_text("api_key: 0123456789abc")
    (tmp_path / "c.yaml").write_text("api_key: ${KEY}\nname: x")
    (tmp_path / ".env").write_text("X=1")
    found = {r["path"] for r in corpus.secrets(spark, str(tmp_path)).collect()}
    assert {"a.txt", "b.yaml"} <= found and "c.yaml" not in found
    p = spark.createDataFrame([("1", "p1", b"x"), ("2", "p2", None), ("3", "p3", None)], "m string, path string, content binary")
    f = spark.createDataFrame([("2", "f2", b"y", "a1fce4363854ff888cff4b8e7875d600c2682390412a8cf79b37d0b11148b0fa"), ("3", "f3", b"y", "00")], "m string, path string, content binary, sha256 string")
    assert sorted(tuple(r) for r in corpus.with_fallback(p, f, "m").collect()) == [("1", "p1", "local_attachment"), ("2", "f2", "official_fallback"), ("3", None, "missing")]
    d = spark.createDataFrame([("x/2", "2_2023年2月t"), ("x/1", "1_2023年1月t"), ("x/3", "3_2023年13月t"), ("x/4", "~$2023年1月")], "path string, name string")
    dated = corpus.dated_files(d, "(20[0-9]{2})年([0-9]{1,2})月")
    assert [r["path"] for r in dated.collect()] == ["x/1", "x/2"] and {r["path"] for r in corpus.unclaimed(d, dated).collect()} == {"x/3", "x/4"}
    o = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "e")], "source_id string, converted_from_source_id string")
    assert sorted(tuple(r) for r in corpus.origins(o).collect()) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0), ("e", "e", 0)]
    assert spark.range(1).select(corpus.relative_assets(F.lit("see file:///r/x/a.png and /r/x/b.png"), "/r/x/")).first()[0] == "see a.png and b.png"
    few = corpus.representative(spark.createDataFrame([("p", i) for i in range(5)] + [("q", 1)], "p string, k int"), "p", "k", 2)
    assert sorted(tuple(r) for r in few.collect()) == [("p", 0), ("p", 1), ("q", 1)]
    assert corpus.inspect_facts(spark.createDataFrame([("1",), ("1",)], "fact_id string")) == {"rows": 2, "ids": 1}
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(3), "t", most=2)


def test_models_are_checked(spark):
    t = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, text string").coalesce(1)

    def model(texts):
        if "t4" in texts:
            raise RuntimeError("no")
        return [[1.0, 2.0]] * len(texts), 10

    r = {x["id"]: x for x in retrieval.embedded(t, "id", "text", model, 2, batch=2, tries=2, wait=0.0).collect()}
    assert r[0]["vector"] == [1.0, 2.0] and r[0]["tokens"] == 5.0 and (r[4]["vector"], r[4]["error"], r[4]["attempts"]) == (None, "RuntimeError", 2)
    assert retrieval.embedding_cost(retrieval.embedded(t, "id", "text", model, 2, batch=2, tries=1, wait=0.0), 1e6).first()["cost"] == 20.0
    assert retrieval.embedded(t, "id", "text", lambda x: ([[1.0]] * len(x), 1), 2, tries=1).filter("error = 'ValueError'").count() == 5
    q = spark.createDataFrame([(1, "大概多少"), (2, "2023年12月末银行总资产余额是多少")], "question_id int, question string")
    plans = planner.plan(q, spark.createDataFrame([("metric", "总资产"), ("entity", "银行")], "kind string, term string"))
    assert {r["planner_mode"] for r in planner.patched(plans, None).collect()} == {"rules"}
    unsure = plans.withColumn("confidence", F.lit(0.1))
    assert {r["route"] for r in planner.patched(unsure, lambda q, p: {"route": "reject"}).collect()} == {"reject"}
    for bad in ({"route": "drop table"}, {"sql": "x"}, {"metrics": "x"}, None):
        assert {(r["planner_mode"], r["clarify"]) for r in planner.patched(unsure, lambda q, p, bad=bad: bad).collect()} == {("model_failed", True)}
    e = spark.createDataFrame([(1, "e1", 1, "x")], "question_id int, evidence_id string, position int, excerpt string")
    d = {r["question_id"]: r for r in gates.drafts(q, e).collect()}
    assert d[1]["answer_text"] == "x" and d[1]["cited_ids"] == ["e1"] and d[2]["refusal_reason"] == "no_evidence"
    m = gates.drafts(q, e, lambda q, e: {"answer_text": "a", "cited_ids": [i for i, _ in e]}).collect()
    assert {r["answer_text"] for r in m} == {"a"}
    assert gates.drafts(q, e, lambda q, e: 1 / 0).filter("refusal_reason = 'model_failed:ZeroDivisionError'").count() == 2
    assert planner.document_facets({"source_id": ["s"], "metrics": ["m"]}) == {"source_id": ["s"], "original_file_name": [], "source_format": []}


def test_facets_profiles_and_jobs(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["y"]), (3, None, None)], "id int, s string, l array<string>")
    assert [r["id"] for r in retrieval.facet_filter(df, {"s": ["a", "b"], "l": ["x"]}).collect()] == [1] and retrieval.facet_filter(df, {"s": []}).count() == 3
    hits = lambda *r: spark.createDataFrame(list(r), "query_id int, id int, score double, rank int")
    dense, sparse = hits((1, 5, 0.9, 1), (1, 6, 0.5, 2)), hits((1, 6, 3.0, 1))
    assert [r["id"] for r in retrieval.by_profile(dense, sparse, "id", "dense_bm25").orderBy("rank").collect()] == [6, 5]
    assert [r["score"] for r in retrieval.by_profile(dense, sparse, "id", "dense_only").orderBy("rank").collect()] == [0.9, 0.5]
    with pytest.raises(ValueError):
        retrieval.by_profile(dense, sparse, "id", "none")
    req = spark.createDataFrame([("kb", ["h2", "h1"], "c"), ("kb", ["h1", "h2"], "c")], "kb string, hashes array<string>, config string")
    first = jobs.created(req, spark.createDataFrame([], "job_id string"))
    assert first.count() == 1 and not first.first()["reused"] and jobs.created(req, first.select("job_id")).first()["reused"]
    n = numbered(spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "v int"), "v", "k")
    assert sorted((r["v"], r["k"]) for r in n.collect()) == [(1, 1), (3, 2), (5, 3), (9, 4)] and numbered(n.select("v").limit(0), "v", "k").count() == 0
    with pytest.raises(ValueError):
        questions.normalised(df, "id")
