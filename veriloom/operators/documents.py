"""Structured documents: parsed JSON inspected, elements typed, tables joined to rows, evidence made, rows chunked.

A parsed document is one JSON object with the arrays texts, tables and pictures and a body tree of references such as
#/texts/3. It is read by JSON expressions in the JVM; nothing walks it in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.ids import stable_id
from veriloom.operators.tables import SHEET

# Labels of text nodes and the element types they stand for.
TEXT_KINDS = {"section_header": "heading", "title": "heading", "list_item": "list_item", "formula": "formula", "caption": "caption", "footnote": "footnote"}
#: Phrases that make a picture's description useless.
UNUSABLE = ["无法识别", "无法查看", "cannot view", "unable to"]


def element_kind(reference: Column, label: Column) -> Column:
    """The type of the element that a reference points to: texts by their label, tables, pictures; else null."""
    named = F.element_at(F.create_map(*(F.lit(x) for kv in TEXT_KINDS.items() for x in kv)), F.coalesce(label, F.lit("")))
    return F.when(reference.startswith("#/texts/"), F.coalesce(named, F.lit("paragraph"))).when(reference.startswith("#/tables/"), "table").when(reference.startswith("#/pictures/"), "picture")


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, text): the rows of tables given as cells (keys, start_row, end_row, start_col, text), end exclusive. A
    cell that spans rows stands in each; blank cells and rows without text drop out."""
    x = cells.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("end_row") > F.col("start_row"))).withColumn("row", F.explode(F.sequence("start_row", F.col("end_row") - 1)))
    g = x.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("start_col", F.trim("text").alias("t")))).alias("c"))
    return g.select(*keys, "row", F.array_join(F.transform("c", lambda c: c["t"]), " | ").alias("text"))


def element_quality(kind: Column, description: Column) -> Column:
    """struct(status, flag, requires_manual_review, model_status): formulas and pictures need review; a picture's
    description is rejected if it holds a useless phrase, else pending."""
    unusable = F.coalesce(description, F.lit("")).rlike("|".join(UNUSABLE))
    none = F.coalesce(F.trim(description), F.lit("")) == ""
    flag = F.when(kind == "formula", "formula_requires_review").when(kind == "picture", F.when(none, "picture_without_description").when(unusable, "model_description_unusable").otherwise("picture_description_pending_validation"))
    model = F.when((kind == "picture") & ~none, F.when(unusable, "rejected").otherwise("pending"))
    return F.struct(F.when(flag.isNotNull(), "requires_review").otherwise("passed").alias("status"), flag.alias("flag"), flag.isNotNull().alias("requires_manual_review"), model.alias("model_status"))


def location(page: Column, left: Column, top: Column, right: Column, bottom: Column, reference: Column, uri: Column) -> Column:
    """struct(page, left, top, right, bottom, reference, uri): top is the smaller of both heights; inline data is no uri."""
    return F.struct(page.alias("page"), left.alias("left"), F.least(top, bottom).alias("top"), right.alias("right"), F.greatest(top, bottom).alias("bottom"), reference.alias("reference"), F.when(~uri.startswith("data:"), uri).alias("uri"))


def evidence_of(elements: DataFrame) -> DataFrame:
    """(evidence_id, element_id, evidence_type, excerpt): the original evidence of each element (element_id, kind, text)."""
    kind = F.when(F.col("kind").isin("table", "picture", "formula"), F.col("kind")).otherwise("text")
    return elements.select(stable_id("evidence", F.col("element_id"), F.lit("original")).alias("evidence_id"), "element_id", kind.alias("evidence_type"), F.col("text").alias("excerpt"))


def with_evidence(elements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Elements beside their evidence, one to one by element_id; a missing or second partner is an error."""
    n = evidence.groupBy("element_id").agg(F.count(F.lit(1)).alias("_n"), F.min("evidence_id").alias("evidence_id"))
    x = elements.join(n, "element_id", "left")
    ok = F.coalesce(F.col("_n"), F.lit(0)) == 1
    return x.withColumn("evidence_id", F.when(ok, F.col("evidence_id")).otherwise(F.raise_error(F.concat(F.lit("evidence not one to one: "), F.col("element_id"))))).drop("_n")


def row_evidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sheet rows (file, sheet, source_range, …) beside the evidence of their range, null where there is none."""
    return rows.join(evidence.select(*SHEET, "source_range", "evidence_id").dropDuplicates([*SHEET, "source_range"]), [*SHEET, "source_range"], "left")


def sheet_elements(rows: DataFrame) -> DataFrame:
    """(file, sheet, row, element_id, kind, text): the non-blank rows of a grid as elements; their numbers stay."""
    return rows.filter(F.trim(F.coalesce("row_text", F.lit(""))) != "").select(*SHEET, "row", stable_id("element", F.col("file"), F.col("sheet"), F.col("row")).alias("element_id"), F.lit("sheet_text").alias("kind"), F.trim("row_text").alias("text"))


def inspect_parsed(parsed: DataFrame, key: str, payload: str, schema_name: str) -> DataFrame:
    """One quality row per parsed document: (key, problem, n_texts, n_tables, n_pictures, n_formulas, n_empty, n_described,
    unresolved, status, flags).

    problem tells what makes it no document at all: not_json, wrong_schema, no_name_or_version, no_elements. unresolved
    are the body's references that point to nothing, sorted; they, and pictures without description, call for review.
    """
    x = parsed.select(key, F.try_parse_json(payload).alias("d"))
    # Parts of a null document, or that aren't there, are empty lists.
    part = lambda p: F.coalesce(F.expr(f"try_variant_get(d, '$.{p}', 'array<variant>')"), F.array().cast("array<variant>"))
    x = x.withColumns({"texts": part("texts"), "tables": part("tables"), "pictures": part("pictures"), "name": F.expr("try_variant_get(d, '$.name', 'string')"), "version": F.expr("try_variant_get(d, '$.version', 'string')"), "schema": F.expr("try_variant_get(d, '$.schema_name', 'string')")})
    text = lambda v, p: F.try_variant_get(v, f"$.{p}", "string")
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.to_json(F.expr("try_variant_get(d, '$.body', 'variant')")), F.lit("")), F.lit(r'"\$ref":"((?:[^"\\]|\\.)*)"'), F.lit(1))))
    x = x.withColumn("refs", refs)
    at = lambda r: F.regexp_extract(r, r"^#/(?:texts|tables|pictures|groups)/([0-9]+)$", 1).try_cast("int")
    held = lambda r: F.when(r.startswith("#/texts/"), F.size("texts")).when(r.startswith("#/tables/"), F.size("tables")).when(r.startswith("#/pictures/"), F.size("pictures")).when(r.startswith("#/groups/"), F.coalesce(F.size(F.expr("try_variant_get(d, '$.groups', 'array<variant>')")), F.lit(0))).otherwise(0)
    described = lambda v: F.exists(F.coalesce(F.try_variant_get(v, "$.annotations", "array<variant>"), F.array().cast("array<variant>")), lambda a: (text(a, "kind") == "description") & (F.trim(F.coalesce(text(a, "text"), F.lit(""))) != ""))
    count = lambda c, f: F.size(F.filter(c, f))
    x = x.withColumns({
        "n_texts": F.size("texts"), "n_tables": F.size("tables"), "n_pictures": F.size("pictures"),
        "n_formulas": count("texts", lambda v: text(v, "label") == "formula"), "n_empty": count("texts", lambda v: F.trim(F.coalesce(text(v, "text"), F.lit(""))) == ""),
        "n_described": count("pictures", described), "unresolved": F.filter("refs", lambda r: at(r).isNull() | (at(r) >= held(r))),
    })
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    problem = F.when(F.col("d").isNull(), "not_json").when(F.coalesce("schema", F.lit("")) != schema_name, "wrong_schema").when(blank("name") | blank("version"), "no_name_or_version").when(F.col("n_texts") + F.col("n_tables") + F.col("n_pictures") == 0, "no_elements")
    flags = F.array_compact(F.array(F.when(F.col("n_empty") > 0, "empty_text_elements"), F.when(F.size("unresolved") > 0, "unresolved_body_references"), F.when(F.col("n_described") < F.col("n_pictures"), "pictures_without_description")))
    status = F.when(problem.isNotNull(), "rejected").when((F.size("unresolved") > 0) | (F.col("n_described") < F.col("n_pictures")), "requires_review").otherwise("passed")
    return x.select(key, problem.alias("problem"), "n_texts", "n_tables", "n_pictures", "n_formulas", "n_empty", "n_described", "unresolved", status.alias("status"), flags.alias("flags"))


def row_chunks(rows: DataFrame, most: int = 4000) -> DataFrame:
    """(file, sheet, start_row, end_row, source_range, text, chunk_id) of grid rows (file, sheet, row, row_text,
    source_range): rows go together up to `most` characters, each counted eight longer than its text; never across
    sheets. A longer row is a chunk of its own. The fold runs over one sheet."""
    from veriloom.operators.chunking import pack

    key = F.to_json(F.struct(*SHEET))
    e = rows.select(key.alias("key"), F.col("row").alias("idx"), F.col("row_text").alias("line"), F.lit("text").alias("kind"), F.lit("").alias("heading"), (F.length("row_text") + 8).alias("tokens"), *SHEET, "source_range")
    p = pack(e, "key", most, 1 << 30)
    g = p.groupBy(*SHEET, "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "line", "source_range"))).alias("r"))
    first, last = F.col("r")[0], F.element_at("r", -1)
    name = F.concat_ws("|", "file", "sheet", first["idx"].cast("string"), last["idx"].cast("string"))
    span = F.concat(F.substring_index(first["source_range"], ":", 1), F.lit(":"), F.substring_index(last["source_range"], ":", -1))
    return g.select(*SHEET, first["idx"].alias("start_row"), last["idx"].alias("end_row"), span.alias("source_range"), F.array_join(F.transform("r", lambda r: F.concat(F.lit("R"), r["idx"].cast("string"), F.lit(": "), r["line"])), "\n").alias("text"), F.substring(F.sha2(name, 256), 1, 24).alias("chunk_id"))


def reading_order(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node, depth, place): the nodes of trees (key, node, parent or null, idx) that a root reaches, in reading
    order. The tree is walked by levels, all trees at once; a node that is its own ancestor is left at that."""
    from veriloom.session import cut

    step = F.format_string("%08d", F.col("idx"))
    level = nodes.filter("parent is null").select(key, "node", F.lit(0).alias("depth"), F.array(step).alias("path"), F.array("node").alias("seen"))
    out, under = level, nodes.filter("parent is not null")
    while True:
        up = level.select(key, F.col("node").alias("parent"), "depth", "path", "seen")
        level = cut(under.join(up, [key, "parent"]).filter(~F.array_contains("seen", F.col("node"))).select(key, "node", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(step)).alias("path"), F.concat("seen", F.array("node")).alias("seen")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    w = Window.partitionBy(key).orderBy("path", "node")
    return out.select(key, "node", "depth", F.row_number().over(w).alias("place"))


def parse_report(documents: DataFrame, by: str) -> DataFrame:
    """(by, n, n_passed, n_review, n_rejected, coverage): how many documents of each profile were parsed."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = documents.groupBy(by).agg(F.count(F.lit(1)).alias("n"), n("passed").alias("n_passed"), n("requires_review").alias("n_review"), n("rejected").alias("n_rejected"))
    return g.withColumn("coverage", F.round((F.col("n") - F.col("n_rejected")) / F.col("n"), 6))
