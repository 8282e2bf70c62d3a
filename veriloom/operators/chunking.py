"""Ordered elements packed into chunks, chunks into parents, and neighbours linked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.text import estimate_tokens

#: The token counts that close a chunk before and after an element.
TARGET, HARD = 550, 800
#: Elements that stand alone.
ALONE = ["table", "picture", "formula"]


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, line, kind, heading, tokens): the non-blank lines of a text as elements, in order."""
    x = df.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("idx", "line")).filter(F.trim("line") != "")
    return x.select(key, "idx", "line", F.lit("text").alias("kind"), F.lit("").alias("heading"), estimate_tokens(F.col("line")).alias("tokens"))


def pack(elements: DataFrame, key: str, target: int = TARGET, hard: int = HARD) -> DataFrame:
    """elements (key, idx, line, kind, heading, tokens) with `chunk`, the number of the chunk each one goes to.

    A chunk closes before an element if the heading changes, the tokens would pass the target, or the element stands
    alone; after it if the tokens reach the hard limit or it stood alone. Elements are never split. The fold runs over
    the sorted elements of one document, whose size is that of a document.
    """
    rows = elements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "tokens", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce(F.col("kind").isin(*ALONE), F.lit(False)).alias("alone")))).alias("e"))
    part = lambda n: F.transform("e", lambda x: x[n])
    # One running state over each document, in Arrow batches of whole documents; linear in its elements.
    numbers = _folded(target, hard)(part("tokens"), part("heading"), part("alone"))
    folded = rows.select(key, F.explode(F.arrays_zip(part("idx").alias("idx"), numbers.alias("chunk"))).alias("o")).select(key, "o.idx", "o.chunk")
    return elements.join(folded, [key, "idx"])


def _folded(target: int, hard: int):
    """The fold of pack as a function of the lists of tokens, headings and lone marks of a document."""

    @F.pandas_udf("array<int>")
    def fold(tokens: pd.Series, headings: pd.Series, alone: pd.Series) -> pd.Series:
        def one(ts, hs, bs) -> list[int]:
            chunk = used = n = 0
            last, out = "", []
            for t, h, b in zip(ts, hs, bs):
                if n and (h != last or used + t > target or b):
                    chunk, used, n = chunk + 1, 0, 0
                used, n, last = used + int(t), n + 1, h
                out.append(chunk)
                if used >= hard or b:
                    chunk, used, n = chunk + 1, 0, 0
            return out

        return pd.Series([one(*x) for x in zip(tokens, headings, alone)], dtype="object")

    return fold


def chunks(packed: DataFrame, key: str, title: str | None = None) -> DataFrame:
    """One row per chunk: display, embedding and BM25 text, tokens, content type, and the neighbours' numbers."""
    order = F.array_sort(F.collect_list(F.struct("idx", "line", "kind")))
    g = packed.groupBy(key, "chunk", *([title] if title else [])).agg(order.alias("e"), F.sum("tokens").cast("long").alias("tokens"), F.min("heading").alias("heading"))
    display = F.array_join(F.transform("e", lambda x: x["line"]), "\n")
    w = Window.partitionBy(key).orderBy("chunk")
    g = g.withColumn("display_text", display)
    head = F.concat_ws("\n", *([F.nullif(F.col(title), F.lit(""))] if title else []), F.nullif(F.col("heading"), F.lit("")), F.col("display_text"))
    return g.select(
        key, "chunk", "tokens", F.size("e").alias("n_elements"), F.when(F.size("e") == 1, F.col("e")[0]["kind"]).otherwise("text").alias("content_type"),
        "display_text", head.alias("embedding_text"), F.col("display_text").alias("bm25_text"), F.lag("chunk").over(w).alias("previous_chunk"), F.lead("chunk").over(w).alias("next_chunk"),
    )


def parents(child_chunks: DataFrame) -> DataFrame:
    """(document_id, heading_path, n_children, child_chunk_ids, display_text) from chunks (document_id, heading_path,
    chunk_index, chunk_id, display_text): children of one heading path form one parent, runs that aren't neighbours
    included. Repeated chunk rows count once."""
    once = child_chunks.dropDuplicates(["chunk_id"])
    g = once.groupBy("document_id", "heading_path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "display_text"))).alias("c"))
    return g.select("document_id", "heading_path", F.size("c").alias("n_children"), F.transform("c", lambda x: x["chunk_id"]).alias("child_chunk_ids"), F.array_join(F.transform("c", lambda x: x["display_text"]), "\n").alias("display_text"))


def neighbours(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with previous_<name> and next_<name> within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"previous_{name}": F.lag(name).over(w), f"next_{name}": F.lead(name).over(w)})


def sheet_chunks(facts: DataFrame, keys: list[str], order: list[str], size: int = 20) -> DataFrame:
    """Facts of a sheet in batches of `size`, with the facets of each batch in order of first appearance."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = facts.withColumn("_k", F.row_number().over(w)).withColumn("batch", F.floor((F.col("_k") - 1) / size).cast("int"))
    line = F.concat_ws("；", "metric_name", "entity_name", F.concat(F.lit(""), F.coalesce("raw_value", F.lit("")), F.coalesce("unit", F.lit(""))))
    g = x.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("_k", "metric_name", "entity_name", F.col("period_end").cast("string").alias("period"), "unit", line.alias("line")))).alias("f"))
    facet = lambda n: F.array_distinct(F.filter(F.transform("f", lambda s: s[n]), lambda v: v.isNotNull()))
    return g.select(*keys, "batch", F.size("f").alias("n_facts"), facet("metric_name").alias("metrics"), facet("entity_name").alias("entities"), facet("period").alias("periods"), facet("unit").alias("units"), F.array_join(F.transform("f", lambda s: s["line"]), "\n").alias("text"))


def heading_paths(elements: DataFrame, key: str) -> DataFrame:
    """elements (key, idx, level or null, text) with heading_path: a heading at level n replaces what is at n and below.

    The last heading of each level counts only if no heading of a higher level came after it.
    """
    levels = 6
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = elements
    for n in range(1, levels + 1):
        at = F.when(F.col("level") == n, F.struct("idx", "text"))
        above = F.max(F.when(F.col("level") < n, F.col("idx"))).over(w)
        x = x.withColumn(f"_h{n}", F.last(at, ignorenulls=True).over(w)).withColumn(f"_a{n}", above)
    parts = [F.when(F.col(f"_h{n}.idx") > F.coalesce(F.col(f"_a{n}"), F.lit(-1)), F.col(f"_h{n}.text")) for n in range(1, levels + 1)]
    return x.withColumn("heading_path", F.filter(F.array(*parts), lambda v: v.isNotNull())).select(*elements.columns, "heading_path")
