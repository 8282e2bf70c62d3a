import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom import catalog
from veriloom.operators import channels, retrieval
from veriloom.session import cut

HAN = "保险资产管理应当自收到通知之日起明确责任岗位"
ODD = [(7, None), (8, ""), (9, "。\n"), (None, "w1 w2 w3 鹭汀"), (None, "w1 w5"), (10, "w1 w2"), (10, "w2 保险"), (10, None), (11, "W1 ‰‰ Ⅷ 保 险 𠀀保险资"), (12, "w_1 12.5% İ保险"), (-3, "w4 w4 w4")]


def texts(rng, n):
    word = lambda: f"w{rng.integers(0, 25)}" if rng.integers(2) else HAN[(a := int(rng.integers(0, 20))) : a + int(rng.integers(1, 10))]
    return [(100 + i, " ".join(word() for _ in range(rng.integers(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("vocabulary,at_once,documents", [(None, 100, 4096), (15, 3, 64)])
def test_as_the_channels_by_themselves(spark, monkeypatch, vocabulary, at_once, documents):
    rows = texts(np.random.default_rng(5), 300)
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in rows[:90]] + ODD, "doc_id long, text string").repartition(3)
    asked = [(i, t[:25]) for i, t in rows[::20]] + [(1, "w1 保险"), (2, "保险 W1"), (3, "w1"), (3, "保险"), (4, "none"), (5, ""), (6, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    # The workers have the sizes from here: a task goes through more than one block of documents and of queries.
    scored = channels._scored

    def sized(*told):
        def run(batches):
            channels.DOCUMENTS, channels.ASKED, channels.TEXTS = documents, 4, documents // 4
            yield from scored(*told)(batches)

        return run

    monkeypatch.setattr(channels, "_scored", sized)
    got = channels.both(queries, docs, "doc_id", "text", vocabulary=vocabulary, queries_at_once=at_once).collect()
    want = {"dense": retrieval.hashed_search(queries, docs.filter("doc_id is not null"), "doc_id", "text"), "bm25": retrieval.bm25_query(queries, docs, "doc_id", "text", vocabulary=vocabulary)}
    for channel, hits in want.items():
        a = {(r["query_id"], r["doc_id"]): (r["rank"], r["score"]) for r in got if r["channel"] == channel}
        b = {(r["query_id"], r["doc_id"]): (r["rank"], r["score"]) for r in hits.collect()}
        assert len(a) > 400 and {k: r for k, (r, _) in a.items()} == {k: r for k, (r, _) in b.items()}
        assert all(abs(a[k][1] - b[k][1]) < 2e-6 for k in b)


def test_words_are_those_of_the_engine(spark):
    rows = [(i, t.lower()) for i, (_, t) in enumerate(texts(np.random.default_rng(6), 50) + [x for x in ODD if x[1] and "İ" not in x[1]])]
    df = spark.createDataFrame(rows, "i long, text string")
    want = {(r["i"], r["term"]): r["tf"] for r in retrieval.term_counts(df, "i", "text").collect()}
    text, code, n, words = channels.words_of([t for _, t in rows])
    term = [words[c - channels.WORD] if c >= channels.WORD else channels._pair(c) for c in code.tolist()]
    assert dict(zip(zip(text.tolist(), term), n.tolist())) == want
    places = {r["term"]: r["p"] for r in spark.createDataFrame([(t,) for _, t in want], "term string").select("term", retrieval.hashed_place(F.col("term"), 64).alias("p")).collect()}
    assert places == {t: channels.place(t, 64) for _, t in want}


def test_what_is_written_stays_near_the_size_of_the_texts(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 3000, 400)), f"word{i % 7} word{i % 11}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    cut(spark.range(1))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)
    before = size()
    assert catalog.QUERIES["rrf_fuse_documents"](spark, str(tmp_path)).count()
    assert 0 < size() - before < 2 * sum(len(t) for _, t, _ in rows)


def test_other_keys_are_refused(spark):
    x = spark.createDataFrame([("a", "w1")], "doc_id string, text string")
    with pytest.raises(ValueError):
        channels.both(x.withColumnRenamed("doc_id", "query_id"), x, "doc_id", "text")
