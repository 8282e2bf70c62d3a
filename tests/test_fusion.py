from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from veriloom import catalog
from veriloom.operators import retrieval


def ranked(scores):
    """{(query, key): score} -> {(query, key): rank}: the 40 best of each query, ties by key."""
    by = defaultdict(list)
    for (q, k), s in scores.items():
        if s > 0:
            by[q].append((-s, k))
    return {(q, k): i + 1 for q, hits in by.items() for i, (_, k) in enumerate(sorted(hits)[:40])}


def cosines(spark, queries, docs):
    vec = lambda df, key: {r[0]: np.array(r[1], dtype="float64") for r in df.select(key, retrieval.hashing_vector(F.col("text"))).collect()}
    q, v = vec(queries, "query_id"), vec(docs, "doc_id")
    length = lambda x: np.sqrt((x * x).sum())
    return {(i, j): float(np.round(a @ b / (length(a) * length(b)), 6)) if a.any() and b.any() else 0.0 for i, a in q.items() for j, b in v.items()}


def test_ids_of_one_residue_stay_apart(spark, tmp_path):
    # 60 documents of one residue by 500; none of the queries 0, 500 and 1000 shares a word with another.
    texts = {500 * i: f"alpha{i % 3} beta{i % 3} word{i} " + "gamma " * (i % 5) for i in range(60)} | {7: None, 8: "", 9: "。"}
    titles = {0: "alpha0 word3", 500: "alpha1 word4", 1000: "alpha2 word5"}
    spark.createDataFrame([(i, t, titles.get(i)) for i, t in texts.items()], "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["query_id"], r["doc_id"]): r for r in catalog.QUERIES["rrf_fuse_documents"](spark, str(tmp_path)).collect()}
    docs, queries = catalog._docs(spark, str(tmp_path))
    dense = ranked(cosines(spark, queries, docs))
    words = {(r["query_id"], r["doc_id"]): r["rank"] for r in catalog._sparse(spark, str(tmp_path)).collect()}
    assert {k: (r["dense_rank"], r["bm25_rank"]) for k, r in rows.items()} == {k: (dense.get(k), words.get(k)) for k in dense | words}
    assert {q for q, _ in rows} == set(titles) and len({d for _, d in rows}) > 40
    # The best document of each is that which holds the query's own word, in both channels' ids.
    assert all(words[q, 500 * n] == 1 and (q, 500 * n) in rows for q, n in ((0, 3), (500, 4), (1000, 5)))
    assert all(abs(r["rrf"] - sum(1 / (60 + x) for x in (r["dense_rank"], r["bm25_rank"]) if x)) < 1e-8 for r in rows.values())


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 30, 6))) for i in range(150)], "doc_id long, text string")
    queries = docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    want = ranked(cosines(spark, queries, docs))
    for block, query_block in ((4096, 1024), (20, 4)):
        got = retrieval.hashed_search(queries, docs, "doc_id", "text", block=block, query_block=query_block)
        assert {(r["query_id"], r["doc_id"]): r["rank"] for r in got.collect()} == want
