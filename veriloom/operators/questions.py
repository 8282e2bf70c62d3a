"""Question sets: rows normalised and checked, prompts, and the sources that retrieval brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import numbered

# The columns of a question set and the values of three of them.
COLUMNS = ["id", "source_type", "difficulty", "difficulty_cn", "qa_type", "question", "option_a", "option_b", "option_c", "option_d", "answer", "answer_text", "evidence", "source_title", "file_label"]
ALLOWED = {"source_type": ["excel", "word", "pdf"], "difficulty": ["easy", "medium", "hard"], "answer": ["A", "B", "C", "D"]}


def as_text(value: Column, kind: str) -> Column:
    """A cell as text: null as empty, days and times in ISO form, whole doubles without a point, others trimmed."""
    if kind == "date":
        return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    if kind in ("double", "float"):
        return F.coalesce(F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string")), F.lit(""))
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def normalised(rows: DataFrame, order: str) -> DataFrame:
    """rows of COLUMNS as text, in the order of a column, with `problems`: wrong_id, repeated_id, not_contiguous, empty and
    unknown fields. Rows without any value drop out. Answers are put in upper case; ids run Q001, Q002 and so on."""
    missing = [c for c in COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    kinds = dict(rows.dtypes)
    x = rows.select(F.col(order).alias("_order"), *(as_text(F.col(c), kinds[c]).alias(c) for c in COLUMNS)).withColumn("answer", F.upper("answer"))
    x = x.filter(F.concat(*COLUMNS) != "")
    x = numbered(x, "_order", "_k").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    id_ok = F.col("id").rlike("^Q[0-9]{3,}$")
    number = F.when(id_ok, F.substring("id", 2, 20)).try_cast("int")
    checks = [F.when(~id_ok, "wrong_id"), F.when(F.col("_n") > 1, "repeated_id"), F.when(id_ok & (number != F.col("_k")), "not_contiguous")]
    checks += [F.when(F.col(c) == "", f"empty:{c}") for c in COLUMNS if c != "id"]
    checks += [F.when((F.col(c) != "") & ~F.col(c).isin(*v), f"unknown:{c}") for c, v in ALLOWED.items()]
    return x.select(*COLUMNS, F.array_compact(F.array(*checks)).alias("problems"))


def counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of some columns stands."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(cells.alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))


def prompt(question: Column, options: list[Column]) -> Column:
    """The question with its lettered options; the reference answer is no part of it."""
    lines = [F.concat(F.lit(f"{letter}. "), F.coalesce(o, F.lit(""))) for letter, o in zip("ABCD", options)]
    return F.concat_ws("\n", question, *lines)


def profile_fits(source_type: Column, profile: Column) -> Column:
    """Whether a source's profile can answer a question of a type: word stands for both kinds of documents."""
    return F.when(source_type.isin("excel", "pdf"), profile == source_type).otherwise(profile.isin("native_docx", "converted_docx"))


def retrieved_sources(audit: DataFrame) -> DataFrame:
    """(question_id, retrieved, reranked): the sources of the last retrieval event of each question (question_id, seq,
    event_type, payload JSON): candidates and evidence, and hits after reranking and evidence; sorted, each once."""
    last = audit.filter("event_type = 'retrieval'").groupBy("question_id").agg(F.max_by("payload", "seq").alias("payload"))
    shape = "candidates array<struct<source_id:string>>, evidence array<struct<source_id:string>>, hits array<struct<chunk:struct<source_id:string>>>"
    x = last.withColumn("p", F.from_json("payload", shape))
    ids = lambda c, f: F.coalesce(F.filter(F.transform(c, f), lambda v: F.coalesce(v, F.lit("")) != ""), F.array().cast("array<string>"))
    evidence = ids(F.col("p.evidence"), lambda e: e["source_id"])
    both = lambda a: F.array_sort(F.array_distinct(F.concat(a, evidence)))
    return x.select("question_id", both(ids(F.col("p.candidates"), lambda e: e["source_id"])).alias("retrieved"), both(ids(F.col("p.hits"), lambda e: e["chunk"]["source_id"])).alias("reranked"))
