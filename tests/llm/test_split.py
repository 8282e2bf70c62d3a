import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.llm.split import child_spans, pieces, split, with_children


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。.\n,́😀", max_size=400), st.integers(12, 60), st.integers(0, 9))
def test_pieces_tile_and_overlap(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in got) == text
    assert all(e - s <= limit for s, _, e in got)
    if len(got) > 1:
        assert all(c - s == min(overlap, c) for s, c, _ in got) and all(c < e for _, c, e in got)


def test_natural_breaks_first():
    text = "一" * 40 + "。" + "二" * 30 + "\n\n" + "三" * 33
    got = pieces(text, 80, 5)
    assert text[: got[0][2]].endswith("\n\n")
    assert pieces("x" * 100, 60, 10) == [(0, 0, 50), (40, 50, 100)]
    assert pieces(None, 10, 2) == [(0, 0, 0)] and pieces("", 10, 2) == [(0, 0, 0)]
    with pytest.raises(ValueError):
        pieces("x", 10, 10)


def test_long_text_is_fast_and_whole():
    text = ("第一句。" * 50 + "\n") * 4000
    got = pieces(text, 1800, 150)
    assert "".join(text[c:e] for _, c, e in got) == text


def test_children():
    assert child_spans("aa\nbb\ncc", [("1", "aa"), ("2", "zz"), ("3", "cc"), ("4", None)]) == [("1", 0, 2), ("2", 2, 6), ("3", 6, 8), ("4", 8, 8)]


def test_rows(spark):
    long = "句子一二三。" * 40
    df = spark.createDataFrame([("p1", long), ("p2", "短"), ("p3", None), ("p4", ""), ("p1", long)], "parent_chunk_id string, display_text string").withColumn("start", F.lit("clash"))
    out = split(df, "display_text", 100, 10)
    assert out.filter("parent_chunk_id = 'p1' and piece_count > 1").count() > 4
    assert out.filter("piece_count = 1").count() == 3
    assert all(r["piece_text"] == long[r["start"] : r["end"]] and len(r["piece_text"]) <= 100 for r in out.filter("parent_chunk_id = 'p1'").collect())
    assert split(df.limit(0), "display_text", 100, 10).count() == 0
    parents = spark.createDataFrame([("p1", long, ["c1", "c2", "gone"]), ("p2", "短", None)], "parent_chunk_id string, display_text string, child_chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "p1", long[:120]), ("c2", "p1", long[120:]), ("c2", "p1", long[120:]), (None, "p1", "x")], "chunk_id string, parent_chunk_id string, display_text string")
    got = with_children(split(parents.drop("child_chunk_ids"), "display_text", 100, 10), parents, chunks).filter("parent_chunk_id = 'p1'").orderBy("piece_no").collect()
    assert got[0]["child_chunk_ids"] == ["c1"] and "c2" in got[-1]["child_chunk_ids"]
    assert {c for r in got for c in r["child_chunk_ids"]} >= {"c1", "c2"}
