"""Trust gates: what may be answered, and whether an answer rests on its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.ids import stable_id
from veriloom.functions.text import numbers_in

# Normative terms, strongest first, and words that ask for a number.
NORMATIVE = ["原则上不得", "不得", "应当", "必须", "严禁", "可以"]
NUMERIC = "多少|数值|金额|余额|比例|计算"


def conflicts(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, n_values): labels (excerpt before the first ：) that carry more than one (value, unit), compared as
    text. Evidence without a value or with an empty label takes no part; a null unit is a value of its own."""
    label = F.trim(F.substring_index("excerpt", "：", 1))
    x = evidence.filter("source_value is not null").withColumn("label", label).filter("label <> ''")
    pair = F.struct("source_value", F.coalesce("unit", F.lit("\x00")))
    return x.groupBy(*keys, "label").agg(F.count_distinct(pair).alias("n_values")).filter("n_values > 1")


def pre_gate(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, allowed, reason) before an answer is drafted. evidence: (question_id, excerpt, source_value, unit,
    requires_manual_review). No evidence; a question for numbers whose evidence all needs review; conflicts."""
    by = evidence.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("requires_manual_review").alias("all_review"))
    clash = conflicts(evidence, ["question_id"]).groupBy("question_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    numeric = (F.size(numbers_in(F.col("question"))) > 0) | F.col("question").rlike(NUMERIC)
    reason = (
        F.when(F.col("n").isNull(), "no_evidence")
        .when(numeric & F.col("all_review"), "numeric_evidence_requires_manual_review")
        .when(F.col("labels").isNotNull(), F.concat(F.lit("conflicting_values:"), F.array_join("labels", ",")))
    )
    return questions.join(by, "question_id", "left").join(clash, "question_id", "left").select("question_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def unsupported_numbers(answer: Column, source: Column) -> Column:
    """The sorted numbers of an answer that its sources don't hold."""
    return F.array_sort(F.array_except(numbers_in(answer), numbers_in(source)))


def post_gate(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, allowed, reason) of a draft (question_id, question, answer_text, cited_ids, refusal_reason) against
    its evidence (question_id, evidence_id, excerpt, source_value, unit), in the order: refusal, missing text or
    citations, unknown or repeated citation, unsupported numbers, unsupported normative term."""
    cited = drafts.select("question_id", F.explode("cited_ids").alias("evidence_id"))
    text = F.concat_ws(" ", "excerpt", F.coalesce("source_value", F.lit("")), F.coalesce("unit", F.lit("")))
    known = cited.join(evidence.dropDuplicates(["question_id", "evidence_id"]), ["question_id", "evidence_id"]).groupBy("question_id").agg(F.count(F.lit(1)).alias("n_known"), F.array_join(F.array_sort(F.collect_list(text)), " ").alias("source"))
    x = drafts.join(known, "question_id", "left").withColumn("source", F.coalesce("source", F.lit("")))
    missing = unsupported_numbers(F.col("answer_text"), F.concat_ws(" ", "source", F.coalesce("question", F.lit(""))))
    term = F.coalesce(*(F.when(F.contains("answer_text", F.lit(t)) & ~F.contains("source", F.lit(t)), F.lit(t)) for t in NORMATIVE))
    unique = F.size(F.array_distinct("cited_ids"))
    reason = (
        F.when(F.coalesce("refusal_reason", F.lit("")) != "", F.concat(F.lit("model_refused:"), "refusal_reason"))
        .when((F.coalesce("answer_text", F.lit("")) == "") | (F.coalesce(F.size("cited_ids"), F.lit(0)) <= 0), "answer_or_citations_missing")
        .when((F.coalesce("n_known", F.lit(0)) != unique) | (F.size("cited_ids") != unique), "unknown_or_duplicate_citation")
        .when(F.size(missing) > 0, F.concat(F.lit("unsupported_numbers:"), F.array_join(missing, ",")))
        .when(term.isNotNull(), F.concat(F.lit("unsupported_normative_strength:"), term))
    )
    return x.select("question_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def answers(drafts: DataFrame, gate: DataFrame) -> DataFrame:
    """(question_id, status, answer_text, citations, reason): what passes is answered with its citations in order, each
    once; the rest is refused with the reason."""
    ok = F.col("allowed")
    return drafts.join(gate, "question_id").select("question_id", F.when(ok, "answered").otherwise("refused").alias("status"), F.when(ok, F.col("answer_text")).alias("answer_text"), F.when(ok, F.array_distinct("cited_ids")).otherwise(F.array().cast("array<string>")).alias("citations"), "reason")


def drafts(questions: DataFrame, evidence: DataFrame, model=None, most: int = 3) -> DataFrame:
    """(question_id, question, answer_text, cited_ids, refusal_reason): a draft per question. By default the excerpts of
    its first `most` pieces of evidence (question_id, evidence_id, position, excerpt); a model, a callable of (question,
    list of (id, excerpt)), gives a dict with answer_text, cited_ids and refusal_reason, and anything else refuses."""
    g = evidence.groupBy("question_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "evidence_id", "excerpt"))), 1, most).alias("e"))
    x = questions.select("question_id", "question").join(g, "question_id", "left")
    ids = F.coalesce(F.transform("e", lambda s: s["evidence_id"]), F.array().cast("array<string>"))
    if model is None:
        text = F.array_join(F.transform("e", lambda s: s["excerpt"]), "\n")
        return x.select("question_id", "question", F.coalesce(text, F.lit("")).alias("answer_text"), ids.alias("cited_ids"), F.when(F.col("e").isNull(), "no_evidence").alias("refusal_reason"))

    def run(batches):
        for b in batches:
            out = []
            for i, q, e in zip(b["question_id"], b["question"], b["e"]):
                try:
                    d = model(q, [(s["evidence_id"], s["excerpt"]) for s in (e if e is not None else [])])
                    out.append((i, q, str(d.get("answer_text") or ""), [str(c) for c in d.get("cited_ids") or []], d.get("refusal_reason")))
                except Exception as failed:
                    out.append((i, q, "", [], f"model_failed:{type(failed).__name__}"))
            yield type(b)(out, columns=["question_id", "question", "answer_text", "cited_ids", "refusal_reason"])

    kind = dict(x.dtypes)["question_id"]
    return x.mapInPandas(run, f"question_id {kind}, question string, answer_text string, cited_ids array<string>, refusal_reason string")


def declined(refused: DataFrame, counts: DataFrame) -> DataFrame:
    """(answer_id, question_id, status, refusal_reason, n_dense, n_bm25, n_fused, n_reranked, n_facts): the record of each
    refused answer (question_id, reason) with what retrieval brought; counts without a row are zero."""
    names = ["n_dense", "n_bm25", "n_fused", "n_reranked", "n_facts"]
    x = refused.join(counts, "question_id", "left")
    return x.select(stable_id("answer", F.col("question_id"), F.lit("refused"), F.col("reason")).alias("answer_id"), "question_id", F.lit("refused").alias("status"), F.col("reason").alias("refusal_reason"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))
