from datetime import date, datetime
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from veriloom.operators import chunking, dims, evaluation, facts, gates, jobs, quality, retrieval, tables
from veriloom.operators.facts import FactQuery
from veriloom.plans import planner


def facts_df(spark):
    rows = [
        ("f1", "s", "M", "资产", "E", "甲", date(2023, 12, 31), "10", "亿元"), ("f2", "s", "M", "资产", "E", "甲", date(2024, 12, 31), "15", "亿元"),
        ("f3", "s", "M", "资产", "E2", "乙", date(2024, 12, 31), None, "亿元"), ("f4", "s", "N", "负债", "E", "甲", date(2024, 12, 31), "x", "CNY_100M"),
    ]
    return spark.createDataFrame(rows, "fact_id string, source_id string, metric_code string, metric_name string, entity_code string, entity_name string, period_end date, normalized_value string, unit string")


def test_fact_operations(spark):
    df = facts_df(spark)
    run = lambda **k: [tuple(r) for r in facts.run(df, FactQuery(**k)).collect()]
    assert run(operation="sum", metrics=("资产",)) == [(Decimal("25.000000000000"),)]
    assert run(operation="average", entities=("甲",), metrics=("M",)) == [(12.5,)]
    assert run(operation="count", units=("亿元",)) == [(3,)]
    assert run(operation="sum", metrics=("N",)) == []  # no number, no row
    assert run(operation="difference", metrics=("M",))[0][-1] == Decimal("5.000000000000")
    assert run(operation="ratio", metrics=("M",))[0][-1] == 1.5
    assert run(operation="trend") == []  # two metrics
    look = facts.run(df, FactQuery(periods=("2023-12-31",))).collect()
    assert [r["excerpt"] for r in look] == ["甲；资产；2023-12-31：10亿元"]
    assert facts.run(df.limit(0), FactQuery("sum")).count() == 0


def test_latest_takes_the_last_delivery(spark):
    df = spark.createDataFrame([("a", 1, "r1", datetime(2024, 1, 1)), ("a", 2, "r2", datetime(2024, 2, 1)), ("b", 3, None, None)], "fact_id string, v int, run_id string, created_at timestamp")
    assert {r["fact_id"]: r["v"] for r in facts.latest(df).collect()} == {"a": 2, "b": 3}


def test_quality(spark):
    df = spark.createDataFrame([("x", date(2024, 1, 31), 5.0), ("x", date(2024, 2, 29), 4.0), ("x", date(2025, 1, 31), 1.0), ("x", date(2025, 2, 28), None)], "k string, p date, v double")
    assert [(r["p"], r["previous_value"]) for r in quality.cumulative_decrease(df, ["k"], "p", "v").collect()] == [(date(2024, 2, 29), 5.0)]
    assert quality.cumulative_decrease(df, ["k"], "p", "v", F.lit(2.0)).count() == 0
    t = spark.createDataFrame([("a", "total", 10.0), ("a", "x", 4.0), ("a", "y", 3.0)], "k string, part string, v double")
    assert quality.row_identity(t, ["k"], "part", "total", "v", 2.5).first()["gap"] == 3.0
    assert quality.part_exceeds(t, ["k"], "part", "total", "x", "v").count() == 1
    s = spark.range(1).select(quality.severity([(F.lit(True), "WARN", "w"), (F.lit(True), "ERROR", "e1"), (F.lit(True), "ERROR", "e2"), (F.lit(True), "WARN", "w2")]).alias("s")).first()["s"]
    assert (s["status"], s["code"]) == ("ERROR", "e2")
    assert not quality.may_publish(spark.createDataFrame([("ERROR",)], "status string"))


def test_pack_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for doc in range(12):
        chunk = tokens = n = 0
        heading = ""
        for i in range(60):
            t, h, kind = int(rng.integers(1, 400)), "h" + str(i // 25), "table" if rng.random() < 0.1 else "text"
            alone = kind == "table"
            if n and (h != heading or tokens + t > 550 or alone):
                chunk, tokens, n = chunk + 1, 0, 0
            want[doc, i] = chunk
            tokens, n, heading = tokens + t, n + 1, h
            if tokens >= 800 or alone:
                chunk, tokens, n = chunk + 1, 0, 0
            rows.append((doc, i, "x", kind, h, t))
    df = spark.createDataFrame(rows, "doc_id int, idx int, line string, kind string, heading string, tokens int")
    assert {(r["doc_id"], r["idx"]): r["chunk"] for r in chunking.pack(df, "doc_id").collect()} == want


def test_heading_paths(spark):
    rows = [(1, 0, 1, "A"), (1, 1, None, "t"), (1, 2, 2, "B"), (1, 3, 3, "C"), (1, 4, 2, "D"), (1, 5, 1, "E"), (1, 6, None, "t")]
    got = chunking.heading_paths(spark.createDataFrame(rows, "doc int, idx int, level int, text string"), "doc").orderBy("idx").collect()
    assert [r["heading_path"] for r in got] == [["A"], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"], ["E"]]


def test_bm25_prefers_repetition_within_bounds(spark):
    docs = spark.createDataFrame([(1, "capital rules"), (2, "capital capital capital capital rules"), (3, "capital " + "filler " * 40), (4, None), (5, "")], "doc_id int, text string")
    q = spark.createDataFrame([(9, "capital")], "query_id int, text string")
    s = {r["doc_id"]: r["score"] for r in retrieval.bm25_search(q, retrieval.bm25_index(docs, "doc_id", "text"), "doc_id").collect()}
    assert s[1] < s[2] < 2.2 * s[1] and s[3] < s[1] and set(s) == {1, 2, 3}


def test_dense_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [0.0] * 8), (98, None)], "id int, embedding array<float>")
    q = df.filter("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in retrieval.dense_search(q, df, "id", "embedding", k=7, block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(5):
        want = sorted(range(60), key=lambda j: (-round(float(n[i] @ n[j]), 5), j))[:7]
        assert [x for _, x in sorted(got[i])] == want


def test_fusion_rerank_and_evidence(spark):
    a = spark.createDataFrame([(1, "x", 5.0, 1), (1, "y", 4.0, 2)], "query_id int, id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 9.0, 1), (1, "z", 8.0, 2)], "query_id int, id string, score double, rank int")
    f = [(r["id"], r["fused_rank"], r["a_rank"], r["b_rank"]) for r in retrieval.fuse({"a": a, "b": b}, "id").orderBy("fused_rank").collect()]
    assert f == [("y", 1, 2, 1), ("x", 2, 1, None), ("z", 3, None, 2)]
    one = a.select(F.lit(7).alias("question_id"), F.lit(1).alias("query_no"), "id", "score", "rank")
    assert {r["id"]: r["score"] for r in retrieval.merge_queries(one, "id").collect()} == {"x": 5.0, "y": 4.0}
    r = retrieval.rerank(a.withColumnRenamed("rank", "fused_rank").withColumn("t", F.col("id")), "id", F.lit("y"), F.col("t"))
    assert [x["id"] for x in r.orderBy("rerank_rank").collect()] == ["y", "x"]
    kept = retrieval.rerank(a.withColumnRenamed("rank", "fused_rank"), "id", F.lit("q"), F.lit("t"), score=F.lit(None).cast("double"))
    assert [x["id"] for x in kept.orderBy("rerank_rank").collect()] == ["x", "y"]
    own = spark.createDataFrame([("x", ["e2", "e1", "e2"]), ("y", ["e1", None, "e3"])], "id string, evidence_ids array<string>")
    assert [x["evidence_id"] for x in retrieval.expand_evidence(a, own, "id").orderBy("position").collect()] == ["e2", "e1", "e3"]


def test_gates(spark):
    e = spark.createDataFrame([(1, "e1", "资产；2024：5", "5", "亿元", False), (1, "e2", "资产；2024：6", "6", "亿元", False), (2, "e3", "制度要求应当报送10%", None, None, True)], "question_id int, evidence_id string, excerpt string, source_value string, unit string, requires_manual_review boolean")
    q = spark.createDataFrame([(1, "资产"), (2, "金额多少"), (3, "?"), (4, None)], "question_id int, question string")
    g = {r["question_id"]: r["reason"] for r in gates.pre_gate(q, e).collect()}
    assert g == {1: "conflicting_values:资产；2024", 2: "numeric_evidence_requires_manual_review", 3: "no_evidence", 4: "no_evidence"}
    d = spark.createDataFrame(
        [(2, "", "应当报送10%", ["e3"], None), (3, "", "x", [], None), (2, "", "应当报送12%", ["e3"], None), (2, "", "不得10%", ["e3"], None), (2, "", "10%", ["e3", "e3"], None), (2, "", "", ["e3"], "no")],
        "question_id int, question string, answer_text string, cited_ids array<string>, refusal_reason string",
    )
    reasons = [gates.post_gate(d.filter(F.monotonically_increasing_id() >= 0).limit(0).union(spark.createDataFrame([r], d.schema)), e).first()["reason"] for r in d.collect()]
    assert reasons == [None, "answer_or_citations_missing", "unsupported_numbers:12%", "unsupported_normative_strength:不得", "unknown_or_duplicate_citation", "model_refused:no"]


def test_options(spark):
    o = F.create_map(*(F.lit(x) for x in ("A", "10%", "B", "20%", "C", "应当报送", "D", "无")))
    df = spark.createDataFrame([(0, ""), (1, "答案是B"), (2, "约为20%"), (3, "银行应当报送材料"), (4, "不知道"), (5, None), (6, "c")], "i int, a string")
    got = [r["r"] for r in df.orderBy("i").select(evaluation.resolve_option(F.col("a"), o).alias("r")).collect()]
    assert [(g["choice"], g["method"]) if g else None for g in got] == [(None, "empty"), ("B", "explicit_label"), ("B", "numeric"), ("C", "text"), None, (None, "empty"), ("C", "explicit_label")]


def test_source_mapping(spark):
    a = spark.createDataFrame([("s1", "pdf", "012_通知全文.pdf"), ("s2", "pdf", "资本充足率管理办法.pdf"), ("s3", "xls", "资本充足率管理办法.xls")], "source_id string, source_format string, original_file_name string")
    q = spark.createDataFrame([("q1", "pdf", "x/12_a", ""), ("q2", "pdf", "none", "资本充足率管理办法"), ("q3", "pdf", "none", "完全无关的标题文字")], "question_id string, source_format string, evidence_reference string, file_label string")
    assert {r["question_id"]: r["source_ids"] for r in evaluation.map_sources(q, a).collect()} == {"q1": ["s1"], "q2": ["s2"]}


def test_premium_table(spark):
    cells = [("f", "s", 2, c, v, None, None) for c, v in enumerate(["地区", "合计", "财产险", "寿险", "意外险", "健康险"], 1)]
    cells += [("f", "s", 3, c, v, None, None) for c, v in enumerate(["全  国", "100", "20", "50", "10", None], 1)] + [("f", "s", 1, 1, "2024年3月", None, None), ("f", "s", 5, 1, "注：口径", None, None)]
    cells[11] = ("f", "s", 3, 6, None, "=SUM(B3:E3)", None)
    df = spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string, formula string, format string")
    regions = dims.aliases(spark, [("CN", "全国", ["全国", "全  国"])], ["region_code", "region_name"])
    p = spark.createDataFrame([("f", date(2024, 3, 31))], "file string, period_end date")
    got = tables.premium_facts(df, p, regions).orderBy("cell").collect()
    assert [r["cell"] for r in got] == ["B3", "C3", "D3", "E3", "F3"] and got[0]["value"] == Decimal("100") and got[0]["period_start"] == date(2024, 1, 1)
    assert got[4]["requires_manual_review"] and not got[0]["requires_manual_review"] and got[0]["metric_code"] == "premium_total"
    assert tables.footnotes(df).first()["footnotes"] == "注：口径"
    grid = {r["row"]: r for r in tables.grid_rows(df).collect()}
    assert grid[3]["n_missing_cache"] == 1 and grid[3]["source_range"] == "A3:F3"


def test_regions_of_rows(spark):
    df = spark.createDataFrame([(i, v == "") for i, v in enumerate(["", "a", "b", "", "", "c"])], "row int, blank boolean").withColumn("k", F.lit(1))
    assert [(r["start_row"], r["end_row"]) for r in tables.table_regions(df, ["k"], "row", "blank").orderBy("start_row").collect()] == [(1, 2), (5, 5)]


def test_workbook_kinds(spark):
    names = ["12_2024年03月人身险公司经营情况表_x.xlsx", "3_2024年普惠型涉农贷款情况.xls", "394_模板.xls", "9_2024年二季度保险公司资金运用情况表.xls", "8_2023年指标解释.xls", "x.xls"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(tables.workbook_kind(F.col("n"))).collect()]
    assert got == ["life_insurance_monthly", "inclusive_agricultural_loans", "excel_template_library", "insurance_funds_investment", "regulatory_release_schedule", "excel_reference_documents"]


def test_dimensions(spark):
    d = dims.aliases(spark, dims.ENTITIES, ["code", "name"])
    df = spark.createDataFrame([("其中：财产保险公司",), ("不明",), (None,)], "label string")
    assert [r["code"] for r in dims.with_dimension(df, "label", d).orderBy("code").collect()] == [None, None, "property_insurers"]
    assert [r["label"] for r in dims.unknown_labels(df, "label", d).collect()] == ["不明"]


def test_jobs(spark):
    rows = [("j", "a", 1, "registered", "running"), ("j", "a", 2, "indexed", "running"), ("j", "a", 3, "parsed", "running"), ("j", "a", 4, "published", "completed"), ("j", "a", 5, "parsed", "failed"), ("j", "b", 6, "parsed", "failed")]
    e = spark.createDataFrame(rows, "job_id string, file_id string, seq int, stage string, status string")
    f = {r["file_id"]: r for r in jobs.file_states(e).collect()}
    assert f["a"]["status"] == "completed" and f["a"]["stage"] == "published" and f["a"]["n_events"] == 4 and f["b"]["status"] == "failed"
    assert jobs.job_states(jobs.file_states(e)).first()["status"] == "partial"
    assert {(r["seq"], r["problem"]) for r in jobs.illegal_changes(e).collect()} == {(3, "backwards"), (5, "after_final")}
    k = spark.range(1).select(*(jobs.idempotency_key(F.lit("k"), F.array(*map(F.lit, h)), F.lit(c)) for h, c in ((["a", "b"], "1"), (["b", "a"], "1"), (["a", "b"], "2")))).first()
    assert k[0] == k[1] != k[2]


def test_planner(spark):
    q = ["2024年银行甲的资本充足率是多少", "资本充足率管理办法第三条规定", "资本充足率和不良贷款率的对比", "这个是什么", None, "共有多少家机构"]
    terms = spark.createDataFrame([("metric", "资本充足率"), ("metric", "资本"), ("entity", "银行甲"), ("metric", None)], "kind string, term string")
    p = {r["question_id"]: r for r in planner.plan(spark.createDataFrame(list(enumerate(q)), "question_id int, question string"), terms).collect()}
    assert p[0]["metrics"] == ["资本充足率"] and p[0]["entities"] == ["银行甲"] and p[0]["periods"] == ["2024-12-31"] and p[0]["route"] == "structured" and p[0]["intent"] == "statistic_lookup"
    assert p[1]["route"] == "document" and p[1]["intent"] == "clause_lookup" and p[2]["intent"] == "regulation_comparison"
    assert p[3]["clarify"] and p[3]["confidence"] < 0.4 and p[5]["operation"] == "count" and p[4]["route"] == "document"
    c = planner.choice_queries(spark.createDataFrame([(1, "题干 A. 甲 B. 乙 C. 丙 D. 丁"), (2, "没有选项")], "question_id int, question string")).orderBy("question_id", "query_no").collect()
    assert [r["query"] for r in c] == ["题干 甲", "题干 乙", "题干 丙", "题干 丁", "没有选项"]
