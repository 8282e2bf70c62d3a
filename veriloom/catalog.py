"""Queries of the engine's own operators over the domain tables, each with its SQL.

`query` registers a function (spark, folder) -> DataFrame under its name, beside the SQL that must give the same rows.
Searches take as queries the documents whose id is divisible by 100, against all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import dates, numbers, text
from veriloom.functions.ids import stable_id
from veriloom.operators import channels, chunking, dims, evaluation, facts, gates, jobs, quality, retrieval, tables
from veriloom.operators.facts import FactQuery
from veriloom.plans import planner
from veriloom.session import table
from veriloom.streaming.jobs import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Facts: lookup, aggregates, derived operations

_FACT_COLUMNS = ["fact_id", "source_id", "metric_code", "metric_name", "entity_code", "entity_name", "period_end", "raw_value", "normalized_value", "unit", "sheet_name", "cell_range", "run_id", "created_at"]
_LATEST = "f as (select * from (select *, row_number() over (partition by fact_id order by created_at desc, run_id desc) k from table_facts) where k = 1)"
_VALUE = "try_cast(normalized_value as decimal(38,12))"
_LAST_ORDER = "period_end asc nulls last, metric_code asc nulls last, entity_code asc nulls last, fact_id asc nulls last"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest(table(spark, d, "table_facts", *_FACT_COLUMNS))


def _grouped(operation: str, *by: str, most: int | None = None):
    return lambda spark, d: facts.run(_facts(spark, d), FactQuery(operation, group_by=by), most)


@query(f"with {_LATEST} select fact_id, period_end, metric_code, entity_code, normalized_value, unit, concat_ws('；', entity_name, metric_name, cast(period_end as varchar)) || '：' || coalesce(normalized_value,'') || coalesce(unit,'') excerpt from f where normalized_value is not null and unit in ('亿元','CNY_100M') and metric_code in ('M1000','M1105') order by {_LAST_ORDER} limit 200")
def fact_lookup(spark, d):
    q = FactQuery(metrics=("M1000", "M1105"), units=("亿元",))
    return facts.run(_facts(spark, d), q).select("fact_id", "period_end", "metric_code", "entity_code", "normalized_value", "unit", "excerpt")


@query(f"with {_LATEST} select metric_code, unit, cast(sum({_VALUE}) as decimal(38,12)) \"value\" from f where normalized_value is not null group by 1, 2 having sum({_VALUE}) is not null")
def fact_sum(spark, d):
    return _grouped("sum", "metric_code", "unit")(spark, d)


@query(f"with {_LATEST} select entity_code, round(avg(cast({_VALUE} as double)) + 1e-9, 6) \"value\" from f where normalized_value is not null and unit = 'PERCENT' group by 1 having avg({_VALUE}) is not null")
def fact_average(spark, d):
    # The shift keeps averages that end in a 5 from rounding by the order of their sum.
    return facts.run(_facts(spark, d), FactQuery("average", units=("PERCENT",), group_by=("entity_code",))).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query(f"with {_LATEST} select metric_code, unit, min({_VALUE}) \"value\" from f where normalized_value is not null group by 1, 2 having min({_VALUE}) is not null")
def fact_minimum(spark, d):
    return _grouped("minimum", "metric_code", "unit")(spark, d)


@query(f"with {_LATEST} select metric_code, unit, max({_VALUE}) \"value\" from f where normalized_value is not null group by 1, 2 having max({_VALUE}) is not null")
def fact_maximum(spark, d):
    return _grouped("maximum", "metric_code", "unit")(spark, d)


@query(f"with {_LATEST} select period_end, count(*) \"value\" from f where normalized_value is not null group by 1")
def fact_count(spark, d):
    return _grouped("count", "period_end")(spark, d)


def _derived_sql(value: str, most: str = "where n <= 200") -> str:
    return f"""with {_LATEST}, r as (select *, row_number() over (partition by metric_code, entity_code, unit order by {_LAST_ORDER}) n from f where normalized_value is not null),
g as (select metric_code, entity_code, unit, count(*) c, min(n) a, max(n) b from r {most} group by all having count(*) >= 2),
p as (select g.metric_code, g.entity_code, g.unit, g.c n, x.period_end first_period, y.period_end last_period, try_cast(x.normalized_value as decimal(38,12)) u, try_cast(y.normalized_value as decimal(38,12)) v
 from g join r x on x.n = g.a and x.metric_code is not distinct from g.metric_code and x.entity_code is not distinct from g.entity_code and x.unit is not distinct from g.unit
 join r y on y.n = g.b and y.metric_code is not distinct from g.metric_code and y.entity_code is not distinct from g.entity_code and y.unit is not distinct from g.unit)
select metric_code, entity_code, unit, first_period, last_period, n, {value} \"value\" from p where u is not null and v is not null and {value} is not null"""


@query(_derived_sql("cast(v - u as decimal(38,12))"))
def fact_difference(spark, d):
    """The feature of a reply: the first 200 rows of each group by period."""
    return _grouped("difference", "metric_code", "entity_code", "unit", most=facts.MOST_ROWS)(spark, d)


@query(_derived_sql("(case when u <> 0 then round(cast(v as double) / cast(u as double), 6) end)"))
def fact_ratio(spark, d):
    """The feature of a reply: the first 200 rows of each group by period."""
    return _grouped("ratio", "metric_code", "entity_code", "unit", most=facts.MOST_ROWS)(spark, d)


@query(_derived_sql("cast(v - u as decimal(38,12))"))
def fact_trend(spark, d):
    """The feature of a reply: the first 200 rows of each group by period."""
    return _grouped("trend", "metric_code", "entity_code", "unit", most=facts.MOST_ROWS)(spark, d)


@query(_derived_sql("cast(v - u as decimal(38,12))", ""))
def fact_difference_whole(spark, d):
    """The same over all rows of each group."""
    return _grouped("difference", "metric_code", "entity_code", "unit")(spark, d)


@query(_derived_sql("(case when u <> 0 then round(cast(v as double) / cast(u as double), 6) end)", ""))
def fact_ratio_whole(spark, d):
    return _grouped("ratio", "metric_code", "entity_code", "unit")(spark, d)


@query("select fact_id, source_id, sheet_name, cell_range, created_at from (select *, row_number() over (partition by fact_id order by source_id asc nulls last, sheet_name asc nulls last, cell_range asc nulls last, created_at asc nulls last) k from table_facts) where k = 1")
def fact_dedup(spark, d):
    return facts.first_by(table(spark, d, "table_facts", "fact_id", "source_id", "sheet_name", "cell_range", "created_at"), "fact_id", ["source_id", "sheet_name", "cell_range", "created_at"])


@query("select distinct kind, code, name from (select 'metric' kind, metric_code code, metric_name \"name\" from table_facts union all select 'entity', entity_code, entity_name from table_facts) where name is not null")
def fact_dictionaries(spark, d):
    return facts.dictionaries(table(spark, d, "table_facts", "metric_code", "metric_name", "entity_code", "entity_name"))


# Quality


@query("select source_id, sheet_name, cell_range, count(*) n from table_facts group by 1, 2, 3 having count(*) > 1")
def dq_duplicate_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "table_facts", "source_id", "sheet_name", "cell_range"), ["source_id", "sheet_name", "cell_range"])


@query("with e as (select distinct unnest(child_chunk_ids) chunk_id from parent_chunks), a as (select distinct chunk_id from chunks) select chunk_id, 'missing' side from e where chunk_id is not null and chunk_id not in (select chunk_id from a where chunk_id is not null) union all select chunk_id, 'extra' from a where chunk_id is not null and chunk_id not in (select chunk_id from e where chunk_id is not null)")
def dq_key_set_difference(spark, d):
    expected = table(spark, d, "parent_chunks", "child_chunk_ids").select(F.explode("child_chunk_ids").alias("chunk_id"))
    return quality.key_set_difference(expected, table(spark, d, "chunks", "chunk_id"), ["chunk_id"])


@query("""with m as (select region_name_raw, metric_name_raw, period_end, max(value) v from region_premium_facts where period_basis = 'YTD' and value is not null and period_end is not null group by all),
x as (select *, lag(period_end) over w previous_period, lag(v) over w previous_value from m window w as (partition by region_name_raw, metric_name_raw, year(period_end) order by period_end, v))
select region_name_raw, metric_name_raw, period_end, cast(v as double) v, previous_period, cast(previous_value as double) previous_value from x where v < previous_value""")
def dq_cumulative_decrease(spark, d):
    x = table(spark, d, "region_premium_facts", "region_name_raw", "metric_name_raw", "period_end", "period_basis", "value").filter("period_basis = 'YTD' and value is not null")
    m = x.groupBy("region_name_raw", "metric_name_raw", "period_end").agg(F.max("value").alias("v"))
    out = quality.cumulative_decrease(m, ["region_name_raw", "metric_name_raw"], "period_end", "v", F.lit(0))
    return out.select("region_name_raw", "metric_name_raw", "period_end", F.col("v").cast("double").alias("v"), "previous_period", F.col("previous_value").cast("double").alias("previous_value"))


@query("""with h as (select distinct entity_code, cast(date_trunc('month', period_end) as date) m from table_facts where period_end is not null), s as (select entity_code, min(m) a, max(m) b from h group by 1),
g as (select entity_code, cast(unnest(generate_series(a, b, interval 1 month)) as date) m from s)
select g.entity_code, g.m "month" from g left join h on h.entity_code = g.entity_code and h.m = g.m where h.m is null and g.entity_code is not null""")
def dq_missing_periods(spark, d):
    return dates.missing_months(table(spark, d, "table_facts", "entity_code", "period_end").filter("entity_code is not null"), ["entity_code"], "period_end")


@query("""with t as (select l_orderkey, cast(sum(case when l_returnflag = 'N' then cast(l_quantity as decimal(18,2)) end) as double) total_value, cast(sum(case when l_returnflag <> 'N' then cast(l_quantity as decimal(18,2)) end) as double) parts_value from lineitem group by 1)
select l_orderkey, total_value, parts_value, total_value - parts_value gap from t where abs(total_value - parts_value) > 2.5""")
def dq_row_identity(spark, d):
    x = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity").withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    return quality.row_identity(x, ["l_orderkey"], "l_returnflag", "N", "q", 2.5).select("l_orderkey", *(F.col(c).cast("double").alias(c) for c in ("total_value", "parts_value", "gap")))


@query("select source_file_hash, count(distinct period_end) n_periods from life_insurance_facts where source_file_hash is not null group by 1 having count(distinct period_end) > 1")
def dq_repeated_hashes(spark, d):
    return quality.repeated_hashes(table(spark, d, "life_insurance_facts", "source_file_hash", "period_end"), "source_file_hash", "period_end")


@query("select period_end, count(distinct source_file) n_files from region_premium_facts group by 1 having count(distinct source_file) > 1")
def dq_one_file_per_period(spark, d):
    return quality.one_file_per_period(table(spark, d, "region_premium_facts", "period_end", "source_file"), "period_end", "source_file")


@query("""select fact_id, 'normalized_value_missing' "rule" from table_facts where value_type in ('integer','decimal','percentage','currency') and raw_value is not null and normalized_value is null
union all select fact_id, 'formula_fields_disagree' from table_facts where is_formula <> (formula is not null and formula_cache_status <> 'not_formula')""")
def dq_record_invariants(spark, d):
    return quality.record_invariants(table(spark, d, "table_facts", "fact_id", "value_type", "raw_value", "normalized_value", "is_formula", "formula", "formula_cache_status"))


@query("""with t as (select source_file, bool_or(value is null) no_value, bool_or(coalesce(formula_raw, '') <> '' and value is null) no_cache, bool_or(unit is null) no_unit from region_premium_facts group by 1)
select source_file, case when no_cache then 'ERROR' when no_value then 'WARN' when no_unit then 'WARN' else 'PASS' end status, case when no_cache then 'formula_cache_missing' when no_value then 'value_missing' when no_unit then 'unit_missing' else '' end code from t""")
def dq_severity(spark, d):
    x = table(spark, d, "region_premium_facts", "source_file", "value", "formula_raw", "unit")
    g = x.groupBy("source_file").agg(F.bool_or(F.col("value").isNull()).alias("nv"), F.bool_or((F.coalesce("formula_raw", F.lit("")) != "") & F.col("value").isNull()).alias("nc"), F.bool_or(F.col("unit").isNull()).alias("nu"))
    s = quality.severity([(F.col("nv"), "WARN", "value_missing"), (F.col("nu"), "WARN", "unit_missing"), (F.col("nc"), "ERROR", "formula_cache_missing")])
    return g.select("source_file", s["status"].alias("status"), s["code"].alias("code"))


# Ordered operators


@query("select source_file, row_id, last_value(region_code ignore nulls) over (partition by source_file order by row_id rows unbounded preceding) region_code from (select source_file, row_id, max(region_code) region_code from region_premium_facts group by all)")
def forward_fill(spark, d):
    x = table(spark, d, "region_premium_facts", "source_file", "row_id", "region_code").groupBy("source_file", "row_id").agg(F.max("region_code").alias("region_code"))
    return tables.filled_down(x, ["source_file"], "row_id", ["region_code"])


_LINES = "l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 idx, unnest(string_split(text, chr(10))) line from documents where text is not null)"


@query(f"with {_LINES}, x as (select *, trim(line) = '' blank, sum(case when trim(line) = '' then 1 else 0 end) over (partition by doc_id order by idx rows unbounded preceding) r from l) select doc_id, cast(r as bigint) region, cast(min(idx) as integer) start_row, cast(max(idx) as integer) end_row, count(*) n_rows from x where not blank group by doc_id, r")
def table_regions(spark, d):
    x = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).withColumn("blank", F.trim("line") == "")
    return tables.table_regions(x, ["doc_id"], "idx", "blank")


@query("select chunk_id, document_id, chunk_index, lag(chunk_id) over w previous_chunk_id, lead(chunk_id) over w next_chunk_id from (select distinct chunk_id, document_id, parent_chunk_id, chunk_index from chunks) window w as (partition by parent_chunk_id order by chunk_index, chunk_id)")
def chunk_neighbours(spark, d):
    x = table(spark, d, "chunks", "chunk_id", "document_id", "parent_chunk_id", "chunk_index").distinct()
    return chunking.neighbours(x, ["parent_chunk_id"], ["chunk_index", "chunk_id"], "chunk_id").drop("parent_chunk_id")


_TOKENS = r"greatest(1, len(regexp_extract_all(line, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[^\s]')))"


@query(f"""with recursive {_LINES}, e as (select doc_id, row_number() over (partition by doc_id order by idx) k, cast({_TOKENS} as bigint) t from l where trim(line) <> ''),
p as (select doc_id, k, t, 0 chunk, t used, t >= 800 bump from e where k = 1
 union all select e.doc_id, e.k, e.t, p.chunk + case when p.bump or p.used + e.t > 550 then 1 else 0 end, case when p.bump or p.used + e.t > 550 then e.t else p.used + e.t end, (case when p.bump or p.used + e.t > 550 then e.t else p.used + e.t end) >= 800 from p join e on e.doc_id = p.doc_id and e.k = p.k + 1)
select doc_id, chunk, cast(sum(t) as bigint) tokens, cast(count(*) as integer) n_elements from p group by doc_id, chunk""")
def chunk_pack(spark, d):
    e = chunking.lines(table(spark, d, "documents", "doc_id", "text").filter("text is not null"), "doc_id", "text")
    return chunking.chunks(chunking.pack(e, "doc_id"), "doc_id").select("doc_id", "chunk", "tokens", "n_elements")


@query("""with c as (select distinct on (chunk_id) * from chunks order by chunk_id) select document_id, heading_path, cast(count(*) as integer) n_children, list(chunk_id order by chunk_index, chunk_id) child_chunk_ids, string_agg(display_text, chr(10) order by chunk_index, chunk_id) display_text from c group by document_id, heading_path""")
def chunk_parents(spark, d):
    return chunking.parents(table(spark, d, "chunks", "chunk_id", "document_id", "heading_path", "chunk_index", "display_text"))


@query(f"""with {_LATEST}, x as (select *, cast(floor((row_number() over (partition by source_id, sheet_name order by cell_range, fact_id) - 1) / 20) as integer) batch from f)
select source_id, sheet_name, batch, cast(count(*) as integer) n_facts, cast(count(distinct metric_name) as integer) n_metrics, cast(count(distinct unit) as integer) n_units from x group by all""")
def sheet_chunks(spark, d):
    x = chunking.sheet_chunks(_facts(spark, d), ["source_id", "sheet_name"], ["cell_range", "fact_id"])
    return x.select("source_id", "sheet_name", "batch", "n_facts", F.size("metrics").alias("n_metrics"), F.size("units").alias("n_units"))


# Identity and deduplication


@query("select source_sha256, count(*) n_aliases, list_sort(list(distinct original_file_name)) \"names\", arg_min(source_id, (created_at, source_id)) canonical_source_id from (select distinct source_id, source_sha256, original_file_name, created_at from source_files) where source_sha256 is not null group by 1")
def source_aliases(spark, d):
    return retrieval.source_aliases(table(spark, d, "source_files", "source_id", "source_sha256", "original_file_name", "created_at"))


@query("select sha256(text) content_hash, count(*) n_documents, min(doc_id) canonical_doc_id from documents where text is not null group by 1")
def content_dedup(spark, d):
    x = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return x.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("canonical_doc_id"))


@query("""select doc_id, 'doc_' || substr(sha256('["' || cast(doc_id as varchar) || '",' || case when source is null then 'null' else '"' || source || '"' end || ']'), 1, 24) stable_id from documents""")
def stable_ids(spark, d):
    return table(spark, d, "documents", "doc_id", "source").select("doc_id", stable_id("doc", F.col("doc_id"), F.col("source")).alias("stable_id"))


# Retrieval

_WORDS = r"""tk as (select doc_id, list_concat(list_concat(regexp_extract_all(lower(text), '[a-z0-9_]+|[%‰]+'), flatten(list_transform(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]{2,}'), lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, cast(i as integer), 2))))), list_filter(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]{2,}'), lambda r: length(r) between 3 and 8)) w from documents where text is not null),
tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(w) term from tk) group by all),
st as (select term, count(*) df from tf group by 1 order by df desc, term limit 80000),
dl as (select doc_id, sum(tf) dl from tf group by 1),
co as (select count(*) n_docs, avg(coalesce(dl, 0)) avgdl from (select distinct doc_id from documents) a left join dl using (doc_id))"""
_QUERY_WORDS = r"""qt as (select doc_id query_id, list_concat(list_concat(regexp_extract_all(lower(title), '[a-z0-9_]+|[%‰]+'), flatten(list_transform(regexp_extract_all(lower(title), '[\x{4e00}-\x{9fff}]{2,}'), lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, cast(i as integer), 2))))), list_filter(regexp_extract_all(lower(title), '[\x{4e00}-\x{9fff}]{2,}'), lambda r: length(r) between 3 and 8)) w from documents where title is not null and doc_id % 100 = 0),
qf as (select query_id, term, count(*) qtf from (select query_id, unnest(w) term from qt) group by all)"""
_BM25 = f"""{_WORDS}, {_QUERY_WORDS},
sc as (select q.query_id, t.doc_id, round(sum(q.qtf * ln((co.n_docs - st.df + 0.5) / (st.df + 0.5) + 1) * (t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * greatest(dl.dl, 1) / greatest(co.avgdl, 1.0))))), 6) score from qf q join st using (term) join tf t using (term) join dl on dl.doc_id = t.doc_id cross join co group by 1, 2),
hb as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) "rank" from sc) where "rank" <= 40)"""


def _docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents", "doc_id", "text", "title")
    return docs.select("doc_id", "text"), docs.filter("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


@query(f"with {_WORDS} select term, df from st")
def bm25_terms(spark, d):
    return retrieval.bm25_index(_docs(spark, d)[0], "doc_id", "text")[1].select("term", "df")


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _docs(spark, d)
    return retrieval.bm25_query(queries, docs, "doc_id", "text")


@query(f"with {_BM25} select query_id, doc_id, score from hb")
def bm25_topk(spark, d):
    return _sparse(spark, d).select("query_id", "doc_id", "score")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_search(q, v, "vec_id", "embedding")


_COSINE = "de as (select * from (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) desc, v.vec_id) \"rank\" from embeddings q, embeddings v where q.vec_id % 100 = 0) where \"rank\" <= 40)"


@query(f"with {_COSINE} select query_id, vec_id, score from de")
def dense_topk(spark, d):
    return _dense(spark, d).select("query_id", "vec_id", "score")


_PLACE = "(unicode(substr(x, 1, 1)) * 7919 + case when length(x) > 1 then unicode(substr(x, 2, 1)) else 0 end * 611 + unicode(substr(x, -1, 1)) * 1047 + length(x) * 31) % 64"
_HASHED = f"""vd as (select doc_id, {_PLACE} p, count(*) n from (select doc_id, unnest(w) x from tk) group by all), vq as (select query_id, {_PLACE} p, count(*) n from (select query_id, unnest(w) x from qt) group by all),
nd as (select doc_id, sqrt(sum(n * n)) l from vd group by 1), nq as (select query_id, sqrt(sum(n * n)) l from vq group by 1),
dn as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) "rank" from (select vq.query_id, vd.doc_id, round(sum(vq.n * vd.n) / (any_value(nq.l) * any_value(nd.l)), 6) score from vq join vd using (p) join nq on nq.query_id = vq.query_id join nd on nd.doc_id = vd.doc_id group by 1, 2)) where "rank" <= 40)"""


@query(f"""with {_BM25}, {_HASHED} select query_id, doc_id, cast(dn."rank" as integer) dense_rank, cast(hb."rank" as integer) bm25_rank, round(coalesce(1.0 / (60 + dn."rank"), 0) + coalesce(1.0 / (60 + hb."rank"), 0), 9) rrf from dn full join hb using (query_id, doc_id)""")
def rrf_fuse_documents(spark, d):
    """Words and hashed vectors fused over the whole id space of the documents."""
    docs, queries = _docs(spark, d)
    hits = channels.both(queries, docs, "doc_id", "text")
    x = retrieval.fuse({c: hits.filter(F.col("channel") == c) for c in ("dense", "bm25")}, "doc_id")
    return x.select("query_id", "doc_id", "dense_rank", "bm25_rank", "rrf")


@query(f"""with {_COSINE}, h as (select query_id // 200 question_id, query_id query_no, vec_id, score, "rank" from de), n as (select question_id, count(distinct query_no) n from h group by 1)
select h.question_id, h.vec_id, round(case when n.n = 1 then max(score) else sum(1.0 / (60 + "rank")) end, 6) score from h join n using (question_id) group by h.question_id, h.vec_id, n.n""")
def rrf_multi_query(spark, d):
    h = _dense(spark, d).select(F.floor(F.col("query_id") / 200).alias("question_id"), F.col("query_id").alias("query_no"), "vec_id", "score", "rank")
    return retrieval.merge_queries(h, "vec_id").select("question_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"""with {_BM25}, c as (select query_id, doc_id, "rank" fr from hb), s as (select c.query_id, c.doc_id, c.fr, case when len(list_distinct(q.w)) > 0 then round(len(list_intersect(list_distinct(q.w), list_distinct(t.w))) / len(list_distinct(q.w)), 6) else 0 end sc from c join qt q using (query_id) join tk t using (doc_id))
select query_id, doc_id, cast(sc as double) rerank_score, cast(k as integer) rerank_rank from (select *, row_number() over (partition by query_id order by sc desc, fr, doc_id) k from s) where k <= 8""")
def rerank_overlap(spark, d):
    docs, queries = _docs(spark, d)
    hits = _sparse(spark, d).withColumnRenamed("rank", "fused_rank")
    x = hits.join(docs, "doc_id").join(queries.withColumnRenamed("text", "question"), "query_id")
    return retrieval.rerank(x, "doc_id", F.col("question"), F.col("text")).select("query_id", "doc_id", "rerank_score", "rerank_rank")


_HITS = "hits as (select document_id query_id, parent_chunk_id, row_number() over (partition by document_id order by parent_chunk_id) \"rank\" from (select distinct document_id, parent_chunk_id from parent_chunks)), own as (select parent_chunk_id, any_value(evidence_ids) evidence_ids from parent_chunks group by 1)"
_EXPANDED = f"""{_HITS}, ex as (select query_id, "rank", generate_subscripts(evidence_ids, 1) pos, unnest(evidence_ids) evidence_id from hits join own using (parent_chunk_id)), fi as (select query_id, evidence_id, min(("rank", pos)) "at" from ex where evidence_id is not null group by 1, 2), ee as (select query_id, evidence_id, row_number() over (partition by query_id order by "at", evidence_id) "position" from fi)"""


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parent_chunks", "document_id", "parent_chunk_id", "evidence_ids")
    hits = retrieval.top(p.select(F.col("document_id").alias("query_id"), "parent_chunk_id", F.lit(0).alias("score")).distinct(), "parent_chunk_id", 1 << 30)
    return retrieval.expand_evidence(hits, p.groupBy("parent_chunk_id").agg(F.any_value("evidence_ids").alias("evidence_ids")), "parent_chunk_id")


@query(f'with {_EXPANDED} select query_id, evidence_id, cast("position" as integer) "position" from ee where "position" <= 12')
def evidence_expand(spark, d):
    return _expanded(spark, d)


@query(f"""with {_EXPANDED}, s as (select document_id query_id, evidence_id, row_number() over (partition by document_id order by evidence_id) p from (select distinct document_id, evidence_id from table_facts where evidence_id is not null and document_id is not null) qualify p <= 12),
u as (select query_id, evidence_id, min((o, p)) "at" from (select query_id, evidence_id, 0 o, p from s union all select query_id, evidence_id, 1, "position" from ee where "position" <= 12) group by 1, 2)
select query_id, evidence_id, cast("at"[1] as integer) origin, cast(row_number() over (partition by query_id order by "at", evidence_id) as integer) "position" from u""")
def evidence_merge(spark, d):
    f = table(spark, d, "table_facts", "document_id", "evidence_id").dropna().distinct().select(F.col("document_id").alias("query_id"), "evidence_id", F.lit(0).alias("score"))
    s = retrieval.top(f, "evidence_id", 12).select("query_id", "evidence_id", F.col("rank").alias("position"))
    return retrieval.merge_evidence(s, _expanded(spark, d))


# Gates


@query("""with e as (select document_id, trim(metric_name) || '；' || cast(period_end as varchar) || '：' || coalesce(raw_value, '') excerpt, normalized_value source_value, unit from table_facts where metric_name is not null and period_end is not null)
select document_id, label, n_values from (select document_id, trim(string_split(excerpt, '：')[1]) label, count(distinct (source_value, coalesce(unit, chr(0)))) n_values from e where source_value is not null group by 1, 2) where label <> '' and n_values > 1""")
def gate_conflicts(spark, d):
    e = table(spark, d, "table_facts", "document_id", "metric_name", "period_end", "raw_value", "normalized_value", "unit").filter("metric_name is not null and period_end is not null")
    e = e.select("document_id", F.concat(F.trim("metric_name"), F.lit("；"), F.col("period_end").cast("string"), F.lit("："), F.coalesce("raw_value", F.lit(""))).alias("excerpt"), F.col("normalized_value").alias("source_value"), "unit")
    return gates.conflicts(e, ["document_id"])


@query()
def gate_numbers(spark, d):
    """Numbers of each chunk that its parent's text doesn't hold (look-behind: rows only)."""
    c = table(spark, d, "chunks", "chunk_id", "parent_chunk_id", "display_text").dropDuplicates(["chunk_id"])
    p = table(spark, d, "parent_chunks", "parent_chunk_id", "display_text").dropDuplicates(["parent_chunk_id"]).withColumnRenamed("display_text", "source")
    return c.join(p, "parent_chunk_id").select("chunk_id", gates.unsupported_numbers(F.col("display_text"), F.col("source")).alias("unsupported"))


@query("""with c as (select distinct chunk_id, display_text from chunks), t as (select unnest(['原则上不得','不得','应当','必须','严禁','可以']) term) select term, count(*) n_chunks from c, t where contains(display_text, term) group by 1""")
def gate_normative_terms(spark, d):
    c = table(spark, d, "chunks", "chunk_id", "display_text").distinct()
    found = F.filter(F.array(*map(F.lit, gates.NORMATIVE)), lambda t: F.contains("display_text", t))
    return c.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"))


# Evaluation


_OUTCOMES = "o as (select coalesce(lang, '-') profile, coalesce(doc_type, '-') doc_type, coalesce(source, '-') source, case when text is null then 'failed' when trim(text) = '' then 'unanswered' when n_chars % 2 = 0 then 'correct' else 'incorrect' end outcome, case when title is null then null else n_chars > 500 end retrieved, n_chars tokens from documents)"


@query(f"""with {_OUTCOMES}, g as (select profile, doc_type, source, count(*) n, count(*) filter (outcome = 'correct') n_correct, count(*) filter (outcome = 'incorrect') n_incorrect, count(*) filter (outcome = 'unanswered') n_unanswered, count(*) filter (outcome = 'failed') n_failed, round(avg(cast(retrieved as integer)), 6) retrieved_rate, cast(sum(tokens) as bigint) tokens from o group by grouping sets ((profile), (profile, doc_type), (profile, source)))
select *, round(n_correct / n, 6) accuracy, case when n_correct + n_incorrect > 0 then round(n_correct / (n_correct + n_incorrect), 6) end answered_accuracy from g""")
def eval_summary(spark, d):
    x = table(spark, d, "documents", "lang", "doc_type", "source", "text", "title", "n_chars")
    dash = lambda c: F.coalesce(c, F.lit("-"))
    blank = F.trim("text") == ""
    outcome = evaluation.classify_outcome(F.lit(0), F.when(~blank, F.col("n_chars") % 2), F.col("text").isNull())
    o = x.select(dash("lang").alias("profile"), dash("doc_type").alias("doc_type"), dash("source").alias("source"), outcome.alias("outcome"), F.when(F.col("title").isNotNull(), F.col("n_chars") > 500).alias("retrieved"), F.col("n_chars").alias("tokens"))
    return evaluation.summarise(o, ["doc_type", "source"])


@query("""with s as (select distinct source_id, source_format, original_file_name from source_files), q as (select source_id question_id, source_format, 'x/' || original_file_name ref from s),
n as (select source_id, source_format, ltrim(regexp_extract(original_file_name, '^([0-9]+)_', 1), '0') k from s)
select question_id, list_sort(list(distinct n.source_id)) source_ids from q join n on n.source_format = q.source_format and n.k = ltrim(regexp_extract(q.ref, '(?:^|[/\\\\])([0-9]+)_', 1), '0') where n.k <> '' group by 1""")
def eval_source_map(spark, d):
    s = table(spark, d, "source_files", "source_id", "source_format", "original_file_name").distinct()
    q = s.select(F.col("source_id").alias("question_id"), "source_format", F.concat(F.lit("x/"), "original_file_name").alias("evidence_reference"), F.lit("").alias("file_label"))
    return evaluation.map_sources(q, s)


# Jobs and audit

_EVENTS = "ev as (select cast(user_id as varchar) job_id, cast(event_id % 7 as varchar) file_id, event_id seq, case event_type when 'click' then 'parsed' when 'view' then 'registered' when 'purchase' then 'published' when 'signup' then 'chunked' else 'indexed' end stage, case when value > 95 then 'completed' when value < 5 then 'failed' else 'running' end status from events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("event_type") == "click", "parsed").when(F.col("event_type") == "view", "registered").when(F.col("event_type") == "purchase", "published").when(F.col("event_type") == "signup", "chunked").otherwise("indexed")
    status = F.when(F.col("value") > 95, "completed").when(F.col("value") < 5, "failed").otherwise("running")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 7).cast("string").alias("file_id"), F.col("event_id").alias("seq"), stage.alias("stage"), status.alias("status"))


_RANK = "list_position(['registered','parsed','normalized','chunked','embedded','indexed','validated','published'], stage)"
_STATES = f"""{_EVENTS}, lv as (select *, coalesce(max(case when status in ('completed','failed') then 1 else 0 end) over (partition by job_id, file_id order by seq rows between unbounded preceding and 1 preceding), 0) fin from ev),
fs as (select job_id, file_id, coalesce(max(case when status <> 'running' then status end), 'running') status, max({_RANK}) r, count(*) n_events from lv where fin = 0 group by 1, 2)"""


@query(f"with {_STATES} select job_id, file_id, status, ['registered','parsed','normalized','chunked','embedded','indexed','validated','published'][r] stage, n_events from fs")
def job_file_states(spark, d):
    return jobs.file_states(_events(spark, d)).drop("progress")


@query(f"with {_STATES}, g as (select job_id, count(*) n_files, count(*) filter (status = 'completed') n_completed, count(*) filter (status = 'failed') n_failed from fs group by 1) select job_id, case when n_completed + n_failed < n_files then 'running' when n_failed = 0 then 'completed' when n_completed = 0 then 'failed' else 'partial' end status, n_files, n_completed, n_failed from g")
def job_rollup(spark, d):
    return jobs.job_states(jobs.file_states(_events(spark, d))).drop("progress")


@query(f"""with {_EVENTS}, x as (select *, {_RANK} r, max({_RANK}) over w before, coalesce(max(case when status <> 'running' then 1 else 0 end) over w, 0) fin from ev window w as (partition by job_id, file_id order by seq rows between unbounded preceding and 1 preceding))
select job_id, file_id, seq, case when fin = 1 then 'after_final' else 'backwards' end problem from x where fin = 1 or r < before""")
def job_illegal_changes(spark, d):
    return jobs.illegal_changes(_events(spark, d))


@query("select date_trunc('day', ts) window_start, event_type, count(*) n from events group by 1, 2")
def audit_event_window(spark, d):
    return windowed_counts(table(spark, d, "events", "ts", "event_type"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Scalar functions over whole columns


@query(r"select doc_id, nullif(regexp_extract(text, '^(第[一二三四五六七八九十百千万零〇两0-9]+条|[一二三四五六七八九十]+、)', 1), '') clause, cast(greatest(1, coalesce(len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[^\s]')), 0)) as integer) tokens from documents")
def text_clause_tokens(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.clause(F.col("text")).alias("clause"), text.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"select distinct metric_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(metric_name, '[ \t\n\x0b\f\r\x85]+', '', 'g'), '[*＊]', '', 'g'), '^[0-9]+[.、]', ''), '^（[一二三四五六七八九十]+）', ''), '^(?:其中[：:])+', '') label_key from table_facts where metric_name is not null")
def text_label_keys_plain(spark, d):
    """The label key of every metric name, without NFKC, which SQL lacks; text_label_keys_all takes it first."""
    return table(spark, d, "table_facts", "metric_name").filter("metric_name is not null").distinct().select("metric_name", text.label_key(F.col("metric_name")).alias("label_key"))


@query()
def text_label_keys_all(spark, d):
    """The label key of every metric name, whatever its characters (rows only: SQL has no NFKC)."""
    names = table(spark, d, "table_facts", "metric_name").filter("metric_name is not null").distinct()
    return names.select("metric_name", text.full_label_key(F.col("metric_name")).alias("label_key"))


@query(r"select distinct source_id, lower(regexp_replace(regexp_replace(original_file_name, '\.[^.]*$', ''), '[^\p{L}\p{N}]', '', 'g')) file_key from source_files")
def text_file_keys(spark, d):
    return table(spark, d, "source_files", "source_id", "original_file_name").select("source_id", text.file_key(F.col("original_file_name")).alias("file_key")).distinct()


@query("""with r as (select distinct raw_value, trim(raw_value) t from table_facts), n as (select *, try_cast(regexp_replace(regexp_replace(t, '[,%％*]', '', 'g'), '^\\((.*)\\)$', '-\\1') as decimal(38,18)) v from r)
select raw_value, case when t is null or t = '' then 'missing' when t in ('-','--','—','/','不适用') then 'not_reported' when t like '#%' or v is null then 'parse_error' when round_even(v, 6) = 0 then 'reported_zero' else 'reported' end status, cast(case when t not in ('-','--','—','/','不适用') and t not like '#%' then round_even(v, 6) end as double) "value" from n""")
def number_parse(spark, d):
    x = table(spark, d, "table_facts", "raw_value").distinct().withColumn("p", numbers.parsed_decimal(F.col("raw_value")))
    return x.select("raw_value", F.col("p.status").alias("status"), F.col("p.value").cast("double").alias("value"))


@query("select distinct metric_code, metric_name, case when metric_code = 'net_profit_ytd' then '亿元' when regexp_matches(coalesce(metric_name, ''), '率|占比|净息差|存贷比|比例') then '%' else '亿元' end unit from table_facts")
def metric_units(spark, d):
    return table(spark, d, "table_facts", "metric_code", "metric_name").distinct().withColumn("unit", numbers.metric_unit(F.col("metric_code"), F.col("metric_name")))


@query("select distinct row_id, period_basis, period_end, case when period_basis = 'POINT_IN_TIME' then period_end when period_basis = 'YTD' then make_date(year(period_end), 1, 1) end period_start from life_insurance_facts")
def period_starts(spark, d):
    return table(spark, d, "life_insurance_facts", "row_id", "period_basis", "period_end").distinct().withColumn("period_start", dates.period_start(F.col("period_basis"), F.col("period_end")))


@query("select metric_name, count(*) n from table_facts where metric_name is not null and metric_name not in (select term_name from canonical_terms where term_kind = 'metric') group by 1")
def dim_unknown_labels(spark, d):
    known = table(spark, d, "canonical_terms", "term_kind", "term_name").filter("term_kind = 'metric'").select(F.col("term_name").alias("metric_name"))
    return table(spark, d, "table_facts", "metric_name").filter("metric_name is not null").join(known, "metric_name", "left_anti").groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"))


@query("select f.metric_code, t.term_name, t.quantity, count(*) n from table_facts f left join canonical_terms t on t.term_kind = 'metric' and t.term_code = f.metric_code group by all")
def dim_metric_join(spark, d):
    t = table(spark, d, "canonical_terms", "term_kind", "term_code", "term_name", "quantity").filter("term_kind = 'metric'").select(F.col("term_code").alias("metric_code"), "term_name", "quantity")
    n = table(spark, d, "table_facts", "metric_code").groupBy("metric_code").agg(F.count(F.lit(1)).alias("n"))
    return n.join(t, "metric_code", "left").select("metric_code", "term_name", "quantity", "n")


_DATED = "regexp_matches(c, '^[0-9]+_20[0-9]{2}年')"
_KINDS = " ".join([
    *(f"when regexp_matches(n, '{p}') then '{k}'" for k, p in tables.MONTHLY),
    f"when {_DATED} and regexp_matches(c, '监管统计信息发布日程|机构范围|指标解释') then 'regulatory_release_schedule'",
    *(f"when {_DATED} and contains(c, '{t}') then '{k}'" for k, t in tables.REGULATORY),
    f"when {_DATED} and regexp_matches(c, '[一二三四1234]季度保险(?:业|公司)资金运用情况表') then 'insurance_funds_investment'",
    f"when {_DATED} and contains(c, '偿付能力') and regexp_matches(c, '状况表|情况表') then 'insurance_solvency'",
    "when string_split(n, '_')[1] in (" + ", ".join(f"'{t}'" for t in tables.TEMPLATES) + ") then 'excel_template_library'",
])


@query(f"with x as (select distinct source_id, original_file_name, original_file_name n, regexp_replace(original_file_name, '\\s+', '', 'g') c from source_files) select source_id, original_file_name, case {_KINDS} else 'excel_reference_documents' end dataset from x")
def classify_workbooks(spark, d):
    """The dataset each source file holds by its name."""
    return table(spark, d, "source_files", "source_id", "original_file_name").distinct().withColumn("dataset", tables.workbook_kind(F.col("original_file_name")))


_OPS = " ".join(f"when regexp_matches(q, '{p}') then '{n}'" for n, p in planner.OPERATIONS)


@query(f"with t as (select doc_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) q from documents) select doc_id, case {_OPS} else 'lookup' end operation from t")
def plan_operations(spark, d):
    t = table(spark, d, "documents", "doc_id", "title").withColumn("q", text.collapsed(F.coalesce("title", F.lit(""))))
    return t.select("doc_id", planner.operation(F.col("q")).alias("operation"))


@query()
def plan_questions(spark, d):
    """Every document title planned as a question, with metrics and entities from the canonical list (rows only)."""
    q = table(spark, d, "documents", "doc_id", "title").select(F.col("doc_id").alias("question_id"), F.col("title").alias("question"))
    terms = table(spark, d, "canonical_terms", "term_kind", "term_name").filter("term_kind in ('metric', 'entity')").select(F.col("term_kind").alias("kind"), F.col("term_name").alias("term"))
    return planner.plan(q, terms)
