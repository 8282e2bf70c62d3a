"""Queries of the text operators: (spark, folder) -> DataFrame, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import bpe, names, pack, split, stuffed
from veriloom.session import cut, table

#: Where the public vocabularies are; a parameter of every query that encodes.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
KINDS = {
    ("table_facts", "entity_name"): "entity",
    ("table_facts", "metric_name"): "metric",
    ("region_premium_facts", "region_name_raw"): "region",
    ("region_premium_facts", "metric_name_raw"): "premium_line",
}


def _names(spark: SparkSession, d: str, kinds: dict) -> DataFrame:
    out = None
    for t, key in (("table_facts", "fact_id"), ("region_premium_facts", "row_id")):
        fields = [f for (x, f) in kinds if x == t]
        part = names.fields(table(spark, d, t, key, *fields), t, key, fields)
        out = part if out is None else out.unionByName(part)
    return out


# Problem 1: free-entered values mapped to the canonical list


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_terms", "term_id", "term_kind", "term_name", "short_names")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = names.mapped(_names(spark, d, KINDS), KINDS, _terms(spark, d))
    return found.select("table_name", "record_id", "field_name", "term_id").distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, with how many rows hold them."""
    found = names.mapped(_names(spark, d, KINDS), KINDS, _terms(spark, d)).filter("term_id = 'NONE'")
    return found.groupBy("table_name", "field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


# Problem 2: oversized items split at natural boundaries


def _limit(spark: SparkSession, d: str, kind: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").filter(F.col("item_kind") == kind).select("max_size", "overlap").first()
    if row is None:
        raise ValueError(f"size_limits has no row for {kind}")
    return row["max_size"], row["overlap"] or 0


def _parents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each parent chunk once; of repeated rows the latest, and of equally late ones the one with the longest text."""
    df = table(spark, d, "parent_chunks", "parent_chunk_id", "created_at", "display_text", *columns).filter("parent_chunk_id is not null")
    order = F.struct("created_at", F.char_length("display_text"), "display_text")
    return df.groupBy("parent_chunk_id").agg(F.max_by(F.struct("display_text", *columns), order).alias("r")).select("parent_chunk_id", "r.*")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "parent_chunk")
    # Any row of a redelivered parent counts, so its rows aren't folded first: equal ones are, by their text.
    rows = table(spark, d, "parent_chunks", "parent_chunk_id", "display_text").filter("parent_chunk_id is not null")
    return split.split(rows, "display_text", limit, overlap).filter("piece_count > 1 and piece_no = 0").select("parent_chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every parent's pieces in order, with heading path and the children that each piece covers."""
    limit, overlap = _limit(spark, d, "parent_chunk")
    parents = cut(_parents(spark, d, "heading_path", "child_chunk_ids"))
    parts = split.split(parents.drop("child_chunk_ids"), "display_text", limit, overlap).drop("display_text")
    chunks = table(spark, d, "chunks", "chunk_id", "parent_chunk_id", "display_text")
    return split.with_children(parts, parents, chunks)


# Problem 3: visually identical text with different characters

_FORM_KINDS = {k: v for k, v in KINDS.items() if k[1] != "entity_name"}


def _usual(spark: SparkSession, d: str) -> DataFrame:
    return names.usual_words(_terms(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.odd_values(_names(spark, d, _FORM_KINDS), _usual(spark, d)).select("table_name", "record_id", "field_name").distinct()


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each form with the number of its spellings and of the rows that hold them."""
    x = names.forms(_names(spark, d, _FORM_KINDS), _usual(spark, d))
    return x.groupBy("table_name", "field_name", "form").agg(F.count_distinct("value").alias("n_spellings"), F.count(F.lit(1)).alias("n_rows"), F.count_if("odd").alias("n_odd"))


# Problem 7: the corpus encoded with a public tokenizer


def p7_ids(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return bpe.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", f"{tokenizers}/{BYTE_BPE}")


# Problem 8: fixed-capacity containers


def p8_windows(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every document in its context window: (doc_id, piece_no, start, n, window_id, position), in tokens."""
    capacity, _ = _limit(spark, d, "context_window")
    return pack.pack(_sized(spark, d, tokenizers), "doc_id", "n_tokens", capacity, "source", "copies")


def _sized(spark: SparkSession, d: str, tokenizers: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "source").withColumn("copies", F.xxhash64(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " ")))
    return cut(bpe.sizes(docs, "text", f"{tokenizers}/{BYTE_BPE}"))


def p8_report(spark: SparkSession, d: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """What p8_windows comes to, in one row: documents, windows, tokens, fill, windows over the capacity, documents cut that
    would have fitted, documents whose pieces don't make up their tokens, and windows in which a source, or copies of a
    text, meet."""
    capacity, _ = _limit(spark, d, "context_window")
    sized = _sized(spark, d, tokenizers)
    return pack.report(pack.pack(sized, "doc_id", "n_tokens", capacity, "source", "copies"), sized, "doc_id", "n_tokens", capacity, "source", "copies")


# Problem 9: keyword-stuffed and link-list pages


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed.stuffed(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").filter("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The stuffed part of every document, by mean mutual information and excess, and what the check confirms of it."""
    return stuffed.stuffed(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", F.round("part", 6).alias("part"), F.round("checked", 6).alias("checked"), "flagged")


def queries():
    return {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_pieces, p3_found, p3_forms, p7_ids, p8_windows, p8_report, p9_found, p9_scores)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "select distinct parent_chunk_id from parent_chunks, (select max_size from size_limits where item_kind = 'parent_chunk') where parent_chunk_id is not null and length(display_text) > max_size",
    }
