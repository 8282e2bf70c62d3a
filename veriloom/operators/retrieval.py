"""Hybrid retrieval: BM25, dense cosine, reciprocal rank fusion, rerank and evidence expansion.

Queries are rows (query_id, …) and travel through every operator together; nothing loops over questions. The index is
tables: postings, term_stats, doc_stats. Scores are rounded before they rank, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import balanced, cut

# BM25 and fusion parameters, recall and rerank sizes, vocabulary size.
K1, B, RRF_K, RECALL, RERANK, VOCABULARY, EVIDENCE = 1.2, 0.75, 60, 40, 8, 80_000, 12


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscore; a Han run gives its neighbouring pairs, and itself up to
    eight characters; runs of % and ‰ are words. Every word once: the reference's segmenter isn't there, so this is a
    documented substitute for it."""
    t = F.lower(text)
    words = F.regexp_extract_all(t, F.lit(r"([a-z0-9_]+|[%‰]+)"), F.lit(1))
    runs = F.regexp_extract_all(t, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    short = F.filter(runs, lambda r: (F.length(r) <= 8) & (F.length(r) > 2))
    return F.coalesce(F.concat(words, pairs, short), F.array().cast("array<string>"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return balanced(docs.select(key, text)).select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(docs: DataFrame, key: str, text: str, vocabulary: int | None = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings(term, key, tf, weight), term_stats(term, df, idx), corpus(n_docs, avgdl)).

    Lengths count all tokens, in the vocabulary or not; texts without tokens have length 0 and count as documents. The
    vocabulary is the `vocabulary` terms of the highest document frequency, ties by term (None: all terms).
    """
    counts = cut(term_counts(docs, key, text))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = stats.orderBy(F.desc("df"), "term").limit(vocabulary) if vocabulary else stats
    length = counts.groupBy(key).agg(F.sum("tf").alias("dl"))
    corpus = docs.select(F.col(key).alias("_k")).distinct().join(length.withColumnRenamed(key, "_k"), "_k", "left").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    return weighed(counts.join(kept.select("term"), "term", "left_semi"), length, corpus, key), kept, corpus


def weighed(counts: DataFrame, length: DataFrame, corpus: DataFrame, key: str, *more: str) -> DataFrame:
    """Postings (term, key, tf, weight) of some term counts, by the documents' lengths (key, dl)."""
    # One row of corpus figures goes to every row: its size is one row.
    x = counts.join(length, key).crossJoin(F.broadcast(corpus))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest("dl", F.lit(1)) / F.greatest("avgdl", F.lit(1.0))))
    return x.select("term", key, "tf", *more, weight.alias("weight"))


def bm25_query(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int = RECALL, vocabulary: int | None = VOCABULARY, counts: DataFrame | None = None) -> DataFrame:
    """What bm25_search gives over bm25_index, in one plan: postings are cut down to the queries' terms before they are
    weighed, and a document's hits are summed within its own task before they meet those of others.

    A frequent term's postings are spread by document, so that no term is a hot key: the terms of the queries, with
    their idf, come to them in `salts` copies.
    """
    counts = cut(term_counts(docs, key, text))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = stats.orderBy(F.desc("df"), "term").limit(vocabulary) if vocabulary else stats
    length = counts.groupBy(key).agg(F.sum("tf").alias("dl"))
    corpus = docs.select(F.col(key).alias("_k")).distinct().join(length.withColumnRenamed(key, "_k"), "_k", "left").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    corpus = cut(corpus)
    q = cut(term_counts(queries, "query_id", "text").withColumnRenamed("tf", "qtf"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = q.join(kept, "term").crossJoin(F.broadcast(corpus)).select("query_id", "term", (F.col("qtf") * idf).alias("qw"))
    salts = 16
    per_term = asked.groupBy("term").agg(F.collect_list(F.struct("query_id", "qw")).alias("asked")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = counts.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(per_term, ["term", "salt"])
    x = weighed(met.select("term", key, "tf", "asked"), length, corpus, key, "asked").select(key, F.explode("asked").alias("a"), "weight")
    hits = x.groupBy("a.query_id", key).agg(F.round(F.sum(F.col("a.qw") * F.col("weight")), 6).alias("score"))
    return top(hits, key, k)


def bm25_search(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], key: str, k: int = RECALL) -> DataFrame:
    """(query_id, key, score, rank) for queries (query_id, text): sum of query tf, document weight and idf."""
    postings, stats, corpus = index
    q = term_counts(queries, "query_id", "text").withColumnRenamed("tf", "qtf")
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = q.join(stats, "term").crossJoin(F.broadcast(corpus)).select("query_id", "term", (F.col("qtf") * idf).alias("qw"))
    hits = postings.join(terms, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
    return top(hits, key, k)


def top(hits: DataFrame, key: str, k: int) -> DataFrame:
    """The k best hits of each query with their rank; ties by key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_search(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = RECALL, block: int = 256, rows: int = 8192) -> DataFrame:
    """(query_id, key, score, rank) by cosine for queries (query_id, vector): a stated query set against all rows.

    Blocks of about `block` queries meet blocks of about `rows` rows as matrices; each pair of blocks passes on the k
    best per query, so every row is compared and nothing is gathered in one place. A zero or null vector scores 0; null
    vectors are no hits.
    """
    told, held = queries.filter(F.col("vector").isNotNull()), vectors.filter(F.col(vector).isNotNull())
    as_doubles = lambda c: F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return _by_blocks(held.select(key, as_doubles(F.col(vector)).alias("_v")), told.select("query_id", as_doubles(F.col("vector")).alias("_v")), key, k, rows, block, False)


def _by_blocks(rows: DataFrame, queries: DataFrame, key: str, k: int, block: int, query_block: int, above_zero: bool) -> DataFrame:
    """The k best rows (key, _v) of each query (query_id, _v) by cosine, block against block."""
    n_rows, n_queries = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // query_block))
    kinds = {c.name: c.dataType.simpleString() for c in [queries.schema["query_id"], rows.schema[key]]}

    def dealt(df: DataFrame, own: str, mine: str, n: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64(own), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))))

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": q["query_id"][:0], key: v[key][:0], "score": np.zeros(0)})
        v = v.sort_values(key, ignore_index=True)
        a, b = np.stack(q["_v"]).astype("float64"), np.stack(v["_v"]).astype("float64")
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        score = np.round(np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0), 6)
        at = np.argsort(-score, axis=1, kind="stable")[:, :k]  # equal scores keep the order of the keys
        out = pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), at.shape[1]), key: v[key].to_numpy()[at.ravel()], "score": np.take_along_axis(score, at, 1).ravel()})
        return out[out["score"] > 0] if above_zero else out

    v, q = dealt(rows, key, "_b", n_rows, "_q", n_queries), dealt(queries, "query_id", "_q", n_queries, "_b", n_rows)
    hits = v.groupBy("_b", "_q").cogroup(q.groupBy("_b", "_q")).applyInPandas(best, f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")
    return top(hits, key, k)


def fuse(channels: dict[str, DataFrame], key: str, k: int = RRF_K, most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of channels (query_id, key, score, rank): one row per candidate with each channel's rank
    and score (null where it isn't a hit), rrf and fused_rank."""
    out = None
    for name, hits in channels.items():
        part = hits.select("query_id", key, F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
        out = part if out is None else out.join(part, ["query_id", key], "full")
    rrf = sum((F.coalesce(1.0 / (k + F.col(f"{n}_rank")), F.lit(0.0)) for n in channels), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), key)
    out = out.withColumn("rrf", F.round(rrf, 9)).withColumn("fused_rank", F.row_number().over(w))
    return out.filter(F.col("fused_rank") <= most) if most else out


def merge_queries(hits: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Hits (question_id, query_no, key, score, rank) of a question's several queries as one list: a single query's
    list passes with its raw scores, several are scored by reciprocal ranks."""
    n = hits.groupBy("question_id").agg(F.count_distinct("query_no").alias("n_queries"))
    g = hits.groupBy("question_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.max("score").alias("raw"))
    x = g.join(n, "question_id").withColumn("score", F.round(F.when(F.col("n_queries") == 1, F.col("raw")).otherwise(F.col("rrf")), 9))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), key)
    return x.select("question_id", key, "score", F.row_number().over(w).alias("rank"))


def rerank(candidates: DataFrame, key: str, question: Column, text: Column, k: int = RERANK, score: Column | None = None) -> DataFrame:
    """The k best candidates (query_id, key, fused_rank) by a scorer; by default the share of the question's words that
    the text holds. A null score keeps the incoming order after the scored ones (fallback)."""
    q, t = F.array_distinct(tokens(question)), F.array_distinct(tokens(text))
    overlap = F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6)).otherwise(0.0)
    x = candidates.withColumn("rerank_score", score if score is not None else overlap)
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "fused_rank", key)
    return x.withColumn("rerank_rank", F.row_number().over(w)).filter(F.col("rerank_rank") <= k)


def expand_evidence(hits: DataFrame, owners: DataFrame, key: str, most: int = EVIDENCE) -> DataFrame:
    """(query_id, evidence_id, position): the evidence of the hits in hit order, each once, at most `most` per query.
    owners: (key, evidence_ids), one row per key."""
    x = hits.join(owners, key).select("query_id", "rank", F.posexplode("evidence_ids").alias("pos", "evidence_id")).filter("evidence_id is not null")
    first = x.groupBy("query_id", "evidence_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "evidence_id")
    return first.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most).select("query_id", "evidence_id", "position")


def merge_evidence(structured: DataFrame, document: DataFrame) -> DataFrame:
    """Evidence of both routes (query_id, evidence_id, position), structured first, each id once."""
    both = structured.withColumn("origin", F.lit(0)).unionByName(document.withColumn("origin", F.lit(1)))
    first = both.groupBy("query_id", "evidence_id").agg(F.min(F.struct("origin", "position")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "evidence_id")
    return first.select("query_id", "evidence_id", F.col("at.origin").alias("origin"), F.row_number().over(w).alias("position"))


def source_aliases(sources: DataFrame) -> DataFrame:
    """(content key, n_aliases, names, canonical): files of the same content are one source; the first row (by time,
    then id) is canonical. Repeated rows of a source count once."""
    once = sources.dropDuplicates(["source_id"])
    names = F.array_sort(F.collect_set("original_file_name"))
    return once.filter("source_sha256 is not null").groupBy("source_sha256").agg(F.count(F.lit(1)).alias("n_aliases"), names.alias("names"), F.min_by("source_id", F.struct("created_at", "source_id")).alias("canonical_source_id"))


def hashed_place(word: Column, size: int) -> Column:
    """The place of a word in a hashing vector, from its first, second and last characters and its length; every engine
    makes the same number of them, and none of them needs a digest."""
    at = lambda i: F.ascii(F.substring(word, i, 1)).cast("bigint")
    return F.pmod(at(1) * 7919 + at(2) * 611 + at(-1) * 1047 + F.length(word) * 31, F.lit(size)).cast("int")


def hashing_vector(text: Column, size: int = 64) -> Column:
    """The offline stand-in for an embedding model: counts of the words hashed into `size` places."""
    places = F.transform(tokens(text), lambda t: hashed_place(t, size))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))


def hashed_search(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int = RECALL, size: int = 64, block: int = 4096, query_block: int = 1024, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the dense channel over texts, by cosine of their hashing_vectors, for queries
    (query_id, text) against all rows.

    Blocks of queries meet blocks of rows as matrices, so nothing is gathered in one place, and each pair of blocks
    passes on the k best per query. A text without words is no hit and has none. counts: the documents' term_counts,
    where they are at hand.
    """
    def vectors(words: DataFrame, own: str) -> DataFrame:
        per_place = words.groupBy(own, hashed_place(F.col("term"), size).alias("p")).agg(F.sum("tf").alias("n"))
        filled = F.map_from_entries(F.collect_list(F.struct("p", "n")))
        m = per_place.groupBy(own).agg(filled.alias("m"))
        return m.select(own, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double")).alias("_v"))

    held = term_counts(docs, key, text) if counts is None else counts
    return _by_blocks(vectors(held, key), vectors(term_counts(queries, "query_id", "text"), "query_id"), key, k, block, query_block, True)


def facet_filter(df: DataFrame, facets: dict[str, list]) -> DataFrame:
    """The rows that fit every facet with any of its values; a list column fits if it shares a value. An empty facet lets
    all through. It goes before a search, so that only what may be found is scored."""
    kinds = dict(df.dtypes)
    for name, values in facets.items():
        if values:
            c = F.col(name)
            df = df.filter(F.arrays_overlap(c, F.array(*map(F.lit, values))) if kinds[name].startswith("array") else c.isin(*values))
    return df


def by_profile(dense: DataFrame, sparse: DataFrame, key: str, profile: str, most: int = RECALL) -> DataFrame:
    """(query_id, key, score, rank) of a profile: one channel keeps its own scores and order, both are fused."""
    if profile == "dense_only":
        return dense.filter(F.col("rank") <= most).select("query_id", key, "score", "rank")
    if profile == "bm25_only":
        return sparse.filter(F.col("rank") <= most).select("query_id", key, "score", "rank")
    if profile != "dense_bm25":
        raise ValueError(f"unknown profile {profile}")
    x = fuse({"dense": dense, "bm25": sparse}, key, most=most)
    return x.select("query_id", key, F.col("rrf").alias("score"), F.col("fused_rank").alias("rank"))


def by_route(plans: DataFrame, document: DataFrame, structured: DataFrame) -> DataFrame:
    """(query_id, evidence_id, origin, position) by each plan's route: document and structured plans take their own
    evidence, mixed ones both, structured first; rejected ones and those to be clarified take none. plans: (query_id,
    route)."""
    for_documents = document.join(plans.filter("route in ('document', 'mixed')").select("query_id"), "query_id", "left_semi")
    for_facts = structured.join(plans.filter("route in ('structured', 'mixed')").select("query_id"), "query_id", "left_semi")
    return merge_evidence(for_facts, for_documents)


def smoke(hits: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(query_id, passed): whether each chunk that was its own query comes back first. hits: (query_id, key, rank)."""
    first = hits.filter("rank = 1").select("query_id", F.col(key).alias("_found"))
    return chunks.select(F.col(key).alias("query_id")).distinct().join(first, "query_id", "left").select("query_id", F.coalesce(F.col("query_id") == F.col("_found"), F.lit(False)).alias("passed"))


def request_digest(hits: DataFrame, key: str) -> DataFrame:
    """(query_id, digest): the SHA-256 of what a reranker is asked: the question and, in rank order, ids and text hashes
    of its candidates (query_id, question, rank, key, text_sha256)."""
    g = hits.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("chunk_id"), "text_sha256"))).alias("c"))
    body = F.to_json(F.struct(F.transform("c", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text_sha256"].alias("text_sha256"))).alias("candidates"), "question"))
    return g.select("query_id", F.sha2(body, 256).alias("digest"))


def citations(evidence: DataFrame, aliases: DataFrame) -> DataFrame:
    """(evidence_id, source_id, original_file_name, source_format, excerpt): evidence with the name of its source: that of
    the canonical alias, else of the first; a source without a usable name is called by the kind of the evidence.
    evidence: (evidence_id, source_id, evidence_type, excerpt); aliases: (source_id, original_file_name, is_canonical)."""
    named = aliases.groupBy("source_id").agg(F.min_by("original_file_name", F.struct(~F.coalesce(F.col("is_canonical"), F.lit(False)), F.col("original_file_name"))).alias("name"))
    x = evidence.join(named, "source_id", "left")
    suffix = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"\.([^.]+)$", 1))
    good = suffix.isin("doc", "docx", "pdf", "xls", "xlsx")
    cell = F.col("evidence_type").isin("cell", "calculation")
    return x.select("evidence_id", "source_id", F.when(good, F.col("name")).when(cell, "确定性事实查询结果.xlsx").otherwise("知识库证据.pdf").alias("original_file_name"), F.when(good, suffix).when(cell, "xlsx").otherwise("pdf").alias("source_format"), F.substring("excerpt", 1, 1200).alias("excerpt"))


def embedded(texts: DataFrame, key: str, text: str, model, size: int, batch: int = 10, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, vector, tokens, attempts, error): texts through a model, a callable of a list of texts that gives (vectors,
    tokens) in their order; at most `batch` at a time. A failed call is tried again after 1, 2, 4 … times `wait`
    seconds; a wrong number of vectors or a wrong length counts as failed. What stays failed has a null vector and the
    error; the rest goes on. tokens are the batch's, shared out evenly. No text is told in errors."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in batches:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                told, error, tokens_ = None, None, None
                for n in range(1, tries + 1):
                    try:
                        told, tokens_ = model(part["_t"].tolist())
                        if len(told) != len(part) or any(len(v) != size for v in told):
                            told = None
                            raise ValueError("wrong number or length of vectors")
                        error = None
                        break
                    except Exception as e:
                        told, error = None, f"{type(e).__name__}"
                        if n < tries:
                            time.sleep(wait * 2 ** (n - 1))
                share = None if tokens_ is None or told is None else tokens_ / len(part)
                yield pd.DataFrame({key: part[key], "vector": [list(map(float, v)) for v in told] if told is not None else [None] * len(part), "tokens": share, "attempts": n, "error": error})

    return texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(run, f"{key} {kind}, vector array<double>, tokens double, attempts int, error string")


def embedding_cost(audit: DataFrame, per_million: float) -> DataFrame:
    """(n, n_failed, tokens, cost): what a run of embedded() took, at a price for a million tokens."""
    return audit.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.sum("tokens").alias("tokens"), (F.sum("tokens") * per_million / 1_000_000).alias("cost"))
