"""Evaluation: options resolved, outcomes classed and summed, sources mapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.numbers import option_number
from veriloom.functions.text import attachment_id, file_key, numbers_in, substring_coverage


def resolve_option(answer: Column, options: Column) -> Column:
    """struct(choice, method): empty; a letter named; the one option whose number the answer holds; the one option of
    two characters or more whose text it holds; else null. options: map of letter -> text."""
    letter = F.upper(F.regexp_extract(answer, r"(?i)(?:答案|选项|answer|option)\s*(?:是|为|:|：|is)?\s*[(（]?([A-D])(?![A-Za-z])|^\s*[(（]?([A-D])[)）.．、\s]*$", 1))
    alone = F.upper(F.regexp_extract(answer, r"^\s*[(（]?([A-Da-d])[)）.．、\s]*$", 1))
    named = F.coalesce(F.nullif(letter, F.lit("")), F.nullif(alone, F.lit("")))
    values = F.transform(numbers_in(answer), option_number)
    keys = F.array_sort(F.map_keys(options))
    numeric = F.filter(keys, lambda k: F.array_contains(values, option_number(F.element_at(options, k))))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    text = F.filter(keys, lambda k: (F.length(plain(F.element_at(options, k))) >= 2) & F.contains(plain(answer), plain(F.element_at(options, k))))
    out = lambda c, m: F.struct(c.cast("string").alias("choice"), F.lit(m).alias("method"))
    return (
        F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", out(F.lit(None), "empty"))
        .when(named.isNotNull(), out(named, "explicit_label"))
        .when(F.size(numeric) == 1, out(numeric[0], "numeric"))
        .when(F.size(text) == 1, out(text[0], "text"))
    )


def classify_outcome(expected: Column, choice: Column, failed: Column) -> Column:
    """failed, unanswered, correct or incorrect."""
    return F.when(failed, "failed").when(choice.isNull(), "unanswered").when(choice == expected, "correct").otherwise("incorrect")


def summarise(outcomes: DataFrame, facets: list[str]) -> DataFrame:
    """One row per profile, overall and by each facet (grouping sets): counts by outcome, accuracy over all expected,
    accuracy over the answered, the share of true among non-null `retrieved`, and tokens."""
    sets = [["profile"], *(["profile", f] for f in facets)]
    count = lambda o: F.count_if(F.col("outcome") == o).alias(f"n_{o}")
    g = outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in ["profile", *facets])).agg(
        F.count(F.lit(1)).alias("n"), *(count(o) for o in ("correct", "incorrect", "unanswered", "failed")),
        F.round(F.avg(F.col("retrieved").cast("int")), 6).alias("retrieved_rate"), F.sum("tokens").cast("long").alias("tokens"),
    )
    answered = F.col("n_correct") + F.col("n_incorrect")
    return g.withColumns({"accuracy": F.round(F.col("n_correct") / F.col("n"), 6), "answered_accuracy": F.when(answered > 0, F.round(F.col("n_correct") / answered, 6))})


def _grams(text: Column, size: Column) -> Column:
    """The distinct stretches of `size` characters of a text; none if it is shorter."""
    n = F.length(text) - size + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: text.substr(i, size)))).otherwise(F.array().cast("array<string>"))


def map_sources(questions: DataFrame, aliases: DataFrame, least: float = 0.8, slack: float = 0.02) -> DataFrame:
    """(question_id, source_ids) for questions (question_id, source_format, evidence_reference, file_label) and aliases
    (source_id, source_format, original_file_name).

    First by the attachment number that starts a file name; questions without such a hit go by the longest common
    substring of label and name, where it covers at least `least` of the label and comes within `slack` of the best.
    A name is compared only with labels of its format that share a stretch of up to four characters with it, as every
    pair of that coverage does.
    """
    a = aliases.select("source_id", "source_format", "original_file_name").distinct()
    number = F.regexp_replace(F.regexp_extract("original_file_name", "^([0-9]+)_", 1), "^0+", "")
    q = questions.withColumn("number", F.regexp_replace(attachment_id(F.col("evidence_reference")), "^0+", ""))
    by_id = q.join(a.withColumn("number", number).filter("number <> ''"), ["number", "source_format"]).select("question_id", "source_id")
    rest = q.join(by_id.select("question_id").distinct(), "question_id", "left_anti").withColumn("label", file_key(F.col("file_label"))).filter("label <> ''")
    # A common stretch of the least coverage holds each of its own stretches of this size.
    size = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.length("label") * least).cast("int")))
    named = a.withColumn("name", file_key(F.col("original_file_name")))
    some = rest.withColumn("gram", F.explode(_grams(F.col("label"), size)))
    sizes = F.flatten(F.array(*(_grams(F.col("name"), F.lit(n)) for n in range(1, 5))))
    pairs = some.join(named.withColumn("gram", F.explode(F.array_distinct(sizes))), ["source_format", "gram"]).select("question_id", "label", "source_id", "name").distinct()
    scored = pairs.withColumn("coverage", substring_coverage(F.col("label"), F.col("name"))).filter(F.col("coverage") >= least)
    best = F.max("coverage").over(Window.partitionBy("question_id"))
    by_name = scored.withColumn("best", best).filter(F.col("coverage") >= F.greatest(F.lit(least), F.col("best") - slack)).select("question_id", "source_id")
    return by_id.unionByName(by_name).groupBy("question_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def source_overlap(df: DataFrame) -> DataFrame:
    """df (…, expected, found arrays) with `hit`: null where nothing is expected."""
    return df.withColumn("hit", F.when(F.size("expected") > 0, F.arrays_overlap("expected", "found")))


def resume(questions: DataFrame, done: DataFrame) -> DataFrame:
    """The questions without an outcome; a failed outcome counts as done."""
    return questions.join(done.select("question_id").distinct(), "question_id", "left_anti")
