"""Spark side of fold and mapping: work per distinct value, results joined back to the rows.

Rows with clean values never reach a shuffle: fold's suspects are told by a JVM pattern, mapping's by an anti join
with the exact names. What is left is distinct before Python sees it, and comes back by a join on the value that
adaptive execution splits where a value is hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.fold import SUSPECT, USUAL_HAN, fold, irregular, words_of
from veriloom.llm.mapping import NONE, Bounds, Matcher
from veriloom.session import bounded

#: Most entries of a reference list that go to the workers at once; longer lists take several turns.
MOST_TERMS = 50_000


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df hashed over a set number of partitions, which adaptive execution doesn't merge: for costly work on few bytes."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def fields(df: DataFrame, table_name: str, key: str, names: list[str]) -> DataFrame:
    """(table_name, record_id, field_name, value): the non-null values of some text columns, one scan."""
    cells = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("value")) for n in names))
    return df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("string").alias("record_id"), F.explode(cells).alias("c")).select("table_name", "record_id", "c.field_name", "c.value").filter("value is not null")


def blocks(reference: DataFrame, most: int = MOST_TERMS) -> Iterator[list[tuple]]:
    """The reference list in blocks of about `most` entries at most, fetched one at a time; one block if it is no longer."""
    df = reference.select("term_id", "term_kind", "term_name", "short_names")
    rows = bounded(df, most)
    if rows is not None:
        yield [tuple(r) for r in rows]
        return
    n = -(-2 * df.count() // most)
    for i in range(n):
        yield [tuple(r) for r in df.filter(F.pmod(F.xxhash64("term_id", "term_kind", "term_name"), F.lit(n)) == i).collect()]


def usual_words(reference: DataFrame) -> DataFrame:
    """(word): the case-folded words of the names of a reference list that aren't ASCII; only these can be mistaken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": sorted(w for w in words_of(b["term_name"]) if not w.isascii())}, dtype="object")

    return reference.select("term_name").filter("term_name is not null").mapInPandas(run, "word string").distinct()


def forms(cells: DataFrame, usual: list[str] | DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """cells with `form`, the consistent form of value, and `odd`, whether it holds an irregular character.

    Nulls don't occur in cells; a value's form depends on the value and the list of usual names only. The list's words
    (usual_words, or a list of names) go to the workers while they are at most `most`; else each value meets the words
    it holds by a join.
    """
    known = None
    if not isinstance(usual, DataFrame):
        known = words_of(usual)
    elif (rows := bounded(usual, most)) is not None:
        known = frozenset(r["word"] for r in rows)

    def told(values: pd.Series, vocabularies: Iterable[frozenset]) -> dict:
        pairs = [(fold(v, w), irregular(v, w)) for v, w in zip(values, vocabularies)]
        return {"form": [f for f, _ in pairs], "odd": [o for _, o in pairs]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [known] * len(b) if known is not None else [frozenset(w) for w in b["words"]]
            yield b[["value"]].assign(**told(b["value"], own))

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(v, w) for v in b["value"] for w in sorted(words_of([v])) if not w.isascii()]
            yield pd.DataFrame(pairs, columns=["value", "word"], dtype="object")

    suspect = F.col("value").rlike(SUSPECT)
    plain = F.translate(F.trim(F.regexp_replace(F.lower("value"), " +", " ")), "".join(USUAL_HAN), "".join(USUAL_HAN.values()))
    values = spread(cells.filter(suspect).select("value").distinct(), "value")
    if known is None:
        met = values.mapInPandas(spelled, "value string, word string").join(usual, "word").groupBy("value").agg(F.collect_set("word").alias("words"))
        values = values.join(met, "value", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    done = values.mapInPandas(run, "value string, form string, odd boolean")
    return cells.filter(~suspect).withColumns({"form": plain, "odd": F.lit(False)}).unionByName(cells.filter(suspect).join(done, "value").select(*cells.columns, "form", "odd"))


def odd_values(cells: DataFrame, usual: list[str] | DataFrame) -> DataFrame:
    """The cells whose value holds an irregular character."""
    return forms(cells.filter(F.col("value").rlike(SUSPECT)), usual).filter("odd").select(*cells.columns)


def mapped(cells: DataFrame, kinds: dict[tuple[str, str], str], reference: DataFrame, bounds: Bounds = Bounds(), most: int = MOST_TERMS) -> DataFrame:
    """The cells whose value isn't a name of the reference list character for character, with term_id (or NONE) and score.

    kinds: (table_name, field_name) -> term_kind of the reference list. A list of more than `most` entries is matched
    block by block, each with the word weights of its block, and the best entry of all blocks is taken (of equal ones the
    smaller id).
    """
    kind = F.coalesce(*(F.when((F.col("table_name") == t) & (F.col("field_name") == f), k) for (t, f), k in kinds.items()))
    exact = reference.select(F.col("term_kind").alias("kind"), F.col("term_name").alias("value")).dropna().distinct()
    other = cells.withColumn("kind", kind).join(exact, ["kind", "value"], "left_anti")
    values = spread(other.select("kind", "value").distinct(), "kind", "value")

    def against(listed: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(listed, bounds)
            for b in batches:
                found = [matcher.match(k, v) for k, v in zip(b["kind"], b["value"])]
                yield b.assign(term_id=[t for t, _ in found], score=[s for _, s in found])

        return values.mapInPandas(run, "kind string, value string, term_id string, score double")

    parts = [against(block) for block in blocks(reference, most)]
    done = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            done = done.unionByName(part)
        order = F.struct((F.col("term_id") == NONE).alias("none"), (-F.col("score")).alias("s"), "term_id")
        done = done.groupBy("kind", "value").agg(F.min_by(F.struct("term_id", "score"), order).alias("r")).select("kind", "value", "r.*")
    return other.join(done, ["kind", "value"]).select(*cells.columns, "kind", "term_id", "score")
