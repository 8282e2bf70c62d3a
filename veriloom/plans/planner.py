"""Questions planned by rules, a batch at a time: filters, route, intent, operation, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.dates import question_periods
from veriloom.functions.text import collapsed, nfkc
from veriloom.operators.facts import FactQuery

# The signals of questions.
DOCUMENT_NUMBER = r"((?:银发|银保监发|银保监规|金规|金办发|证监会令|国务院令)[〔\[【]?[0-9]{4}[〕\]】]?[0-9]+号)"
UNIT = r"(亿元|万元|元|万户|万件|户|家|个|笔|(?<![个每])人(?!身|员|民|寿|均)|%|％|百分点)"
CLAUSE = r"第[一二三四五六七八九十百千万零〇两0-9]+条"
STATISTIC = "多少|数值|金额|余额|比例|比率|数量|户数|家数|增长率|下降率|合计|平均"
COMPARISON = "对比|比较|区别|差异|变化|相较|同比|环比|分别"
REGULATION = "法规|制度|办法|规定|通知|意见|指引|准则|条例|条款|应当|不得|必须"
AMBIGUOUS = "这个|那个|上述|前者|后者|它们|相关情况"
OPERATIONS = [
    ("sum", "求和|加总|总和是多少|合计计算"),
    ("average", "求平均|平均值是多少"),
    ("maximum", "最大值|最高的是|最高值"),
    ("minimum", "最小值|最低的是|最低值"),
    ("count", "(?:有|共有|共计)多少(?:家|户|个|笔|人)"),
    ("difference", "相差|差额|变化多少|增长了多少|下降了多少"),
    ("ratio", "占.+(?:比例|比重)|比值"),
    ("trend", "趋势"),
]
#: Fixed value: below this confidence a model may be asked, or the question clarified.
SURE = 0.72


def operation(question: Column) -> Column:
    """The operation a question asks for; rules in order, lookup if none holds."""
    out = F.lit("lookup")
    for name, pattern in reversed(OPERATIONS):
        out = F.when(question.rlike(pattern), name).otherwise(out)
    return out


def matched_terms(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(question_id, kind, terms): the dictionary terms (kind, term) in each question, without those that lie within a
    longer one found there. A question meets the terms that begin with two (or, for terms of one, with one) of its
    neighbouring characters; the dictionary may be of any size."""
    q = F.col("question")
    pairs = F.when(F.length(q) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), lambda i: F.array(q.substr(i, F.lit(1)), q.substr(i, F.lit(2))))))
    asked = questions.withColumn("head", F.explode(F.array_distinct(pairs)))
    listed = terms.filter("term is not null and term <> ''").distinct().withColumn("head", F.substring("term", 1, 2))
    hits = asked.join(listed, "head").filter(F.contains("question", F.col("term"))).select("question_id", "kind", "term")
    g = hits.groupBy("question_id", "kind").agg(F.collect_set("term").alias("all"))
    longest = F.filter("all", lambda t: ~F.exists("all", lambda o: (o != t) & F.contains(o, t)))
    return g.select("question_id", "kind", F.array_sort(longest).alias("terms"))


def plan(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """One plan per question (question_id, question): filters, route, intent, operation, confidence, reasons,
    clarification. Null questions plan as empty ones."""
    q = questions.select("question_id", collapsed(nfkc(F.coalesce("question", F.lit("")))).alias("question"))
    found = matched_terms(q, terms).groupBy("question_id").pivot("kind", ["metric", "entity"]).agg(F.first("terms"))
    none = F.array().cast("array<string>")
    x = q.join(found, "question_id", "left").select("question_id", "question", F.coalesce("metric", none).alias("metrics"), F.coalesce("entity", none).alias("entities"))
    s = F.col("question")
    x = x.withColumns({
        "periods": question_periods(s),
        "units": F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(UNIT), F.lit(1)), lambda u: F.translate(u, "％", "%")))),
        "document_numbers": F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(DOCUMENT_NUMBER), F.lit(1)))),
        "operation": operation(s),
        "comparison": s.rlike(COMPARISON),
        "ambiguous": s.rlike(AMBIGUOUS),
        "clause": s.rlike(CLAUSE),
    })
    some = lambda c: F.size(c) > 0
    x = x.withColumns({
        "statistic": s.rlike(STATISTIC) | (some("metrics") & some("periods")),
        "regulation": s.rlike(REGULATION) | some("document_numbers") | F.col("clause"),
    })
    explicit = sum((some(c).cast("int") for c in ("metrics", "entities", "periods", "units", "document_numbers")), F.lit(0))
    base = F.least(F.lit(0.98), F.lit(0.58) + explicit * 0.08 + F.when(F.col("statistic") | F.col("regulation"), 0.12).otherwise(0.0))
    x = x.withColumn("confidence", F.round(F.when(F.col("ambiguous"), F.greatest(F.lit(0.2), base - 0.3)).otherwise(base), 4))
    route = F.when(F.col("statistic") & F.col("regulation"), "mixed").when(F.col("statistic"), "structured").otherwise("document")
    intent = (
        F.when(F.col("statistic") & F.col("comparison"), "statistic_comparison")
        .when(F.col("statistic") & (F.col("operation") != "lookup"), "statistic_calculation")
        .when(F.col("statistic"), "statistic_lookup")
        .when(F.col("comparison"), "regulation_comparison")
        .when(F.col("clause"), "clause_lookup")
        .when(F.col("regulation"), "regulation_lookup")
        .otherwise("general_lookup")
    )
    bare = (route != "document") & ~some("metrics") & ~some("entities") & ~some("periods")
    return x.select("question_id", "question", route.alias("route"), intent.alias("intent"), "operation", "metrics", "entities", "periods", "units", "document_numbers", "confidence", ((F.col("confidence") < SURE) & (F.col("ambiguous") | bare)).alias("clarify"))


def fact_query(row) -> FactQuery:
    """The fact query of one planned question (a collected row of plan)."""
    return FactQuery(row["operation"], metrics=tuple(row["metrics"]), entities=tuple(row["entities"]), periods=tuple(row["periods"]), units=tuple(row["units"]))


def choice_queries(questions: DataFrame) -> DataFrame:
    """(question_id, query_no, query): the stem with each of its options A to D, only if all four are there; else the
    question itself."""
    parts = F.regexp_extract_all("question", F.lit(r"(?s)(?:^|\s)([A-D])[.、．]\s*(.*?)(?=\s[A-D][.、．]|$)"), F.lit(2))
    letters = F.regexp_extract_all("question", F.lit(r"(?s)(?:^|\s)([A-D])[.、．]\s*(.*?)(?=\s[A-D][.、．]|$)"), F.lit(1))
    stem = F.trim(F.regexp_extract("question", r"(?s)^(.*?)(?:^|\s)A[.、．]", 1))
    expanded = F.transform(parts, lambda p: F.concat(F.col("_stem"), F.lit(" "), F.trim(p)))
    x = questions.withColumn("_stem", stem).withColumn("_q", F.when(F.concat_ws("", letters) == "ABCD", expanded).otherwise(F.array("question")))
    return x.select("question_id", F.posexplode("_q").alias("query_no", "query"))


#: What a model may set in a plan.
PATCH = {"route": ["document", "structured", "mixed", "reject"], "intent": None, "metrics": None, "entities": None, "periods": None, "units": None, "clarify": None}


def patched(plans: DataFrame, model) -> DataFrame:
    """plans with `planner_mode`: those below the sure confidence go through a model, a callable of (question, plan as a
    dict) that gives a dict; only the fields of PATCH may be in it, of the right types. Anything else, or a failure,
    leaves the plan as the rules made it and asks for clarification. No model: all plans stay. The model's words are
    values of fields and never become SQL."""
    names = ["route", "intent", "metrics", "entities", "periods", "units", "clarify"]
    if model is None:
        return plans.withColumn("planner_mode", F.lit("rules"))

    def one(row: dict) -> dict:
        if row["confidence"] >= SURE:
            return row | {"planner_mode": "rules"}
        base = {k: list(v) if hasattr(v, "tolist") or isinstance(v, (list, tuple)) else v for k, v in row.items()}
        try:
            patch = model(row["question"], base)
            ok = isinstance(patch, dict) and set(patch) <= set(names) and patch.get("route", base["route"]) in PATCH["route"] and isinstance(patch.get("intent", ""), str) and isinstance(patch.get("clarify", False), bool) and all(isinstance(patch.get(n, []), list) and all(isinstance(v, str) for v in patch.get(n, [])) for n in ("metrics", "entities", "periods", "units"))
        except Exception:
            ok = False
        return base | patch | {"planner_mode": "rules_with_model"} if ok else base | {"clarify": True, "planner_mode": "model_failed"}

    columns = [*plans.columns, "planner_mode"]

    def run(batches):
        for b in batches:
            yield type(b)([one(r) for r in b.to_dict("records")], columns=columns)

    return plans.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in [*plans.dtypes, ("planner_mode", "string")]))


def document_facets(plan: dict) -> dict[str, list]:
    """The filters of a plan that are safe for documents: sources, file names and formats; dictionary hits are not."""
    return {k: list(plan.get(k) or []) for k in ("source_id", "original_file_name", "source_format")}


def scoped(plans: DataFrame, sources: list[str]) -> DataFrame:
    """plans within stated sources: structured and mixed ones lose their entities, since words of a file's title need not
    be rows of its tables."""
    none = F.array().cast("array<string>")
    kept = F.when(F.col("route").isin("structured", "mixed"), none).otherwise(F.col("entities"))
    return plans.withColumns({"entities": kept, "sources": F.array_sort(F.array_distinct(F.array(*map(F.lit, sources)).cast("array<string>")))})
