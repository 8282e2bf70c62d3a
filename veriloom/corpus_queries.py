"""Queries of the operators over documents, corpora, question sets, retrieval results and jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriloom import catalog
from veriloom.catalog import query
from veriloom.functions import arrays
from veriloom.operators import chunking, dims, documents, gates, jobs, quality, questions, retrieval
from veriloom.plans import planner
from veriloom.session import numbered, table
from veriloom.sources import corpus

# Lists, flags and states


@query("select source_id, list_sort(list_distinct(flatten(list(quality_flags)))) flags from table_facts where quality_flags is not null group by 1 union all select source_id, [] from table_facts group by 1 having count(quality_flags) = 0")
def flags_union(spark, d):
    return table(spark, d, "table_facts", "source_id", "quality_flags").groupBy("source_id").agg(arrays.union_sorted(F.col("quality_flags")).alias("flags"))


_RANKS = ", ".join(map(repr, dims.QUALITY_RANK))


@query(f"select document_id, [{_RANKS}][max(r)] status from (select document_id, nullif(coalesce(list_position([{_RANKS}], quality_status), 0), 0) r from table_facts) group by 1")
def worst_status(spark, d):
    return table(spark, d, "table_facts", "document_id", "quality_status").groupBy("document_id").agg(arrays.worst(F.col("quality_status")).alias("status"))


@query("select distinct fact_id, coalesce(array_to_string(quality_flags, '|'), '') flags, list_filter(string_split(coalesce(array_to_string(quality_flags, '|'), ''), '|'), lambda f: f <> '') again from table_facts")
def flags_text(spark, d):
    x = table(spark, d, "table_facts", "fact_id", "quality_flags").select("fact_id", arrays.join_flags(F.col("quality_flags")).alias("flags"))
    return x.withColumn("again", arrays.split_flags(F.col("flags"))).distinct()


@query("select quality_status, producer, count(*) n, count(distinct document_id) n_documents, bool_and(requires_manual_review) all_review from table_facts group by 1, 2")
def status_counts(spark, d):
    return table(spark, d, "table_facts", "quality_status", "producer", "document_id", "requires_manual_review").groupBy("quality_status", "producer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("n_documents"), F.bool_and("requires_manual_review").alias("all_review"))


@query("with x as (select chunk_id, count(distinct (schema_version, document_id, source_id, parent_chunk_id, chunk_index, content_type, display_text, token_count)) n from chunks where chunk_id is not null group by 1) select chunk_id, n from x where n > 1 union all select 'all', count(*) from x")
def chunk_ids_unique(spark, d):
    """Ids that stand for more than one content, and, as 'all', how many ids there are."""
    c = table(spark, d, "chunks", "chunk_id", "schema_version", "document_id", "source_id", "parent_chunk_id", "chunk_index", "content_type", "display_text", "token_count")
    return corpus.repeated_ids(c, "chunk_id").unionByName(c.agg(F.lit("all").alias("chunk_id"), F.count_distinct("chunk_id").alias("n")))


@query("select distinct metric_code, metric_name, metric_name_raw from region_premium_facts")
def alias_mapping(spark, d):
    return table(spark, d, "region_premium_facts", "metric_code", "metric_name", "metric_name_raw").distinct()


@query("with e as (select distinct unnest(evidence_ids) evidence_id from parent_chunks), a as (select distinct evidence_id from evidence) select evidence_id, 'missing' side from e where evidence_id is not null and evidence_id not in (select evidence_id from a where evidence_id is not null) union all select evidence_id, 'extra' from a where evidence_id is not null and evidence_id not in (select evidence_id from e where evidence_id is not null)")
def dq_evidence_sets(spark, d):
    """The evidence that parents name against the evidence there is: both sides have a difference."""
    named = table(spark, d, "parent_chunks", "evidence_ids").select(F.explode("evidence_ids").alias("evidence_id"))
    return quality.key_set_difference(named, table(spark, d, "evidence", "evidence_id"), ["evidence_id"])


@query("select payload_hash, n_periods from (select sha256(region_name_raw || '|' || metric_name_raw) payload_hash, count(distinct period_end) n_periods from region_premium_facts where region_name_raw is not null and metric_name_raw is not null group by 1) where n_periods > 1")
def dq_repeated_contents(spark, d):
    """Contents that come back in more than one period."""
    x = table(spark, d, "region_premium_facts", "region_name_raw", "metric_name_raw", "period_end").withColumn("payload_hash", F.sha2(F.concat("region_name_raw", F.lit("|"), "metric_name_raw"), 256))
    return quality.repeated_hashes(x, "payload_hash", "period_end")


# Documents and chunks

_LINE_GRID = "g as (select cast(doc_id as varchar) file, coalesce(lang, '-') sheet, cast(i as integer) \"row\", line row_text from (select doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) i, unnest(string_split(text, chr(10))) line from documents where text is not null) where trim(line) <> '')"


def _line_grid(spark, d):
    """The lines of documents as rows of a sheet."""
    x = table(spark, d, "documents", "doc_id", "lang", "text").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("lang", F.lit("-")).alias("sheet"), F.posexplode(F.split("text", "\n")).alias("i", "row_text")).filter(F.trim("row_text") != "")
    row = (F.col("i") + 1).cast("int")
    return x.select("file", "sheet", row.alias("row"), "row_text", F.concat(F.lit("A"), row.cast("string"), F.lit(":A"), row.cast("string")).alias("source_range"))


@query(f"""with recursive {_LINE_GRID}, e as (select *, length(row_text) + 8 t, row_number() over (partition by file order by "row") k from g),
p as (select file, sheet, "row", row_text, k, t, 0 chunk, t used from e where k = 1 union all select e.file, e.sheet, e."row", e.row_text, e.k, e.t, p.chunk + case when p.used + e.t > 4000 then 1 else 0 end, case when p.used + e.t > 4000 then e.t else p.used + e.t end from p join e on e.file = p.file and e.k = p.k + 1)
select file, sheet, min("row") start_row, max("row") end_row, 'A' || min("row") || ':A' || max("row") source_range, md5(string_agg('R' || "row" || ': ' || row_text, chr(10) order by "row")) text_md5, substr(sha256(file || '|' || sheet || '|' || min("row") || '|' || max("row")), 1, 24) chunk_id from p group by file, sheet, chunk""")
def row_chunks(spark, d):
    x = documents.row_chunks(_line_grid(spark, d))
    return x.select("file", "sheet", "start_row", "end_row", "source_range", F.md5("text").alias("text_md5"), "chunk_id")


@query(f"with {_LINE_GRID} select file, sheet, \"row\", 'element_' || substr(sha256('[\"' || file || '\",\"' || sheet || '\",\"' || \"row\" || '\"]'), 1, 24) element_id, 'sheet_text' kind, md5(trim(row_text)) text_md5 from g")
def sheet_elements(spark, d):
    return documents.sheet_elements(_line_grid(spark, d)).select("file", "sheet", "row", "element_id", "kind", F.md5("text").alias("text_md5"))


@query("select o_orderkey, cast(unnest(generate_series(a, b - 1)) as integer) \"row\", t \"text\" from (select o_orderkey, 0 a, 2 b, string_agg(trim(o_orderpriority), ' | ') t from orders group by 1)")
def table_rows(spark, d):
    """A cell over two rows stands in both."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.lit(0).alias("start_row"), F.lit(2).alias("end_row"), F.lit(1).alias("start_col"), F.col("o_orderpriority").alias("text"))
    return documents.table_rows(o, ["o_orderkey"])


_KIND = "case content_type when 'table' then 'table' when 'picture' then 'picture' when 'formula' then 'formula' else 'text' end"


@query(f"select distinct chunk_id element_id, 'evidence_' || substr(sha256('[\"' || chunk_id || '\",\"original\"]'), 1, 24) evidence_id, {_KIND} evidence_type from chunks where chunk_id is not null")
def element_evidence(spark, d):
    c = table(spark, d, "chunks", "chunk_id", "content_type", "display_text").filter("chunk_id is not null").distinct()
    return documents.evidence_of(c.select(F.col("chunk_id").alias("element_id"), F.col("content_type").alias("kind"), F.col("display_text").alias("text"))).select("element_id", "evidence_id", "evidence_type").distinct()


@query("select * from (select doc_id, case doc_type when 'notice' then 'formula' when 'annex' then 'picture' else 'paragraph' end kind, case when doc_type = 'notice' then 'formula_requires_review' when doc_type = 'annex' then case when trim(coalesce(title, '')) = '' then 'picture_without_description' else 'picture_description_pending_validation' end end flag, case when doc_type = 'annex' and trim(coalesce(title, '')) <> '' then 'pending' end model_status from documents)")
def element_quality(spark, d):
    x = table(spark, d, "documents", "doc_id", "doc_type", "title").withColumn("kind", F.when(F.col("doc_type") == "notice", "formula").when(F.col("doc_type") == "annex", "picture").otherwise("paragraph"))
    return x.withColumn("q", documents.element_quality(F.col("kind"), F.col("title"))).select("doc_id", "kind", "q.flag", "q.model_status")


@query("select source_profile, count(*) n, count(*) filter (quality_status = 'passed') n_passed, count(*) filter (quality_status = 'requires_review') n_review, count(*) filter (quality_status = 'rejected') n_rejected, round((count(*) - count(*) filter (quality_status = 'rejected')) / count(*), 6) coverage from (select distinct document_id, source_profile, quality_status from document_records) group by 1")
def parse_coverage(spark, d):
    x = table(spark, d, "document_records", "document_id", "source_profile", "quality_status").distinct().withColumnRenamed("quality_status", "status")
    return documents.parse_report(x, "source_profile")


@query("""with recursive s as (select source_id, max(converted_from_source_id) p from source_files group by 1), w as (select source_id, source_id cur, 0 steps from s union all select w.source_id, s.p, w.steps + 1 from w join s on s.source_id = w.cur join s t on t.source_id = s.p where s.p <> s.source_id and w.steps < 100)
select source_id, arg_max(cur, steps) origin_id, max(steps) steps from w group by 1""")
def source_origins(spark, d):
    return corpus.origins(table(spark, d, "source_files", "source_id", "converted_from_source_id"))


@query("""with x as (select doc_id, line, i from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) i, unnest(string_split(text, chr(10))) line from documents where text is not null) where trim(line) <> ''), n as (select doc_id, cast(i as varchar) node, i from x)
select cast(doc_id as varchar) doc, node, case when k = 1 then 0 else 1 end depth, cast(k as integer) place from (select doc_id, node, row_number() over (partition by doc_id order by i) k from n)""")
def reading_order(spark, d):
    """A document's first line as the root of its tree, the others below it."""
    x = _line_grid(spark, d).withColumn("first", F.min("row").over(Window.partitionBy("file")))
    nodes = x.select(F.col("file").alias("doc"), F.col("row").cast("string").alias("node"), F.when(F.col("row") != F.col("first"), F.col("first").cast("string")).alias("parent"), F.col("row").alias("idx"))
    return documents.reading_order(nodes, "doc")


@query(f"""with recursive {catalog._LINES}, e as (select doc_id, line, row_number() over (partition by doc_id order by idx) k, cast({catalog._TOKENS} as bigint) t from l where trim(line) <> ''),
p as (select doc_id, line, k, t, 0 chunk, t used, t >= 800 bump from e where k = 1
 union all select e.doc_id, e.line, e.k, e.t, p.chunk + case when p.bump or p.used + e.t > 550 then 1 else 0 end, case when p.bump or p.used + e.t > 550 then e.t else p.used + e.t end, (case when p.bump or p.used + e.t > 550 then e.t else p.used + e.t end) >= 800 from p join e on e.doc_id = p.doc_id and e.k = p.k + 1)
select doc_id, chunk, md5(string_agg(line, chr(10) order by k)) text_md5 from p group by doc_id, chunk""")
def chunk_texts(spark, d):
    """What chunk_pack counts, with the texts themselves."""
    e = chunking.lines(table(spark, d, "documents", "doc_id", "text").filter("text is not null"), "doc_id", "text")
    return chunking.chunks(chunking.pack(e, "doc_id"), "doc_id").select("doc_id", "chunk", F.md5("display_text").alias("text_md5"))


# Question sets

_ROWS = "q as (select row_number() over (order by doc_id) k, doc_id, coalesce(title, '') title, lang, doc_type from documents)"


def _question_rows(spark, d):
    x = numbered(table(spark, d, "documents", "doc_id", "title", "lang", "doc_type"), "doc_id", "k")
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "zh", "excel").otherwise("scan")
    empty = F.lit("x")
    return x.select(
        "k", F.concat(F.lit("Q"), F.lpad(F.when(F.col("k") == 5, 4).otherwise(F.col("k")).cast("string"), 7, "0")).alias("id"), kind.alias("source_type"), F.lit("easy").alias("difficulty"), empty.alias("difficulty_cn"), "doc_type", F.col("doc_type").alias("qa_type"), F.col("title").alias("question"),
        *(empty.alias(f"option_{c}") for c in "abcd"), F.lit("a").alias("answer"), empty.alias("answer_text"), F.col("k").cast("double").alias("evidence"), empty.alias("source_title"), F.lit(None).cast("string").alias("file_label"),
    )


@query(f"""with {_ROWS} select 'Q' || lpad(cast(case when k = 5 then 4 else k end as varchar), 7, '0') id, trim(title) question, cast(k as varchar) evidence, 'A' answer,
list_filter([case when k in (4, 5) then 'repeated_id' end, case when k = 5 then 'not_contiguous' end, case when coalesce(doc_type, '') = '' then 'empty:qa_type' end, case when trim(title) = '' then 'empty:question' end, 'empty:file_label', case when lang is null or lang not in ('en', 'zh') then 'unknown:source_type' end], lambda p: p is not null) problems from q""")
def question_rows(spark, d):
    """Titles as a question set; one id stands twice, a column is empty, some source types are unknown."""
    return questions.normalised(_question_rows(spark, d), "k").select("id", "question", "evidence", "answer", "problems")


@query("select 'doc_type' \"column\", doc_type \"value\", count(*) n from documents group by 2 union all select 'lang', lang, count(*) from documents group by 2")
def question_counts(spark, d):
    return questions.counts(table(spark, d, "documents", "doc_type", "lang"), ["doc_type", "lang"])


@query("select doc_id, coalesce(title || chr(10), '') || 'A. ' || coalesce(source, '') || chr(10) || 'B. ' || coalesce(lang, '') || chr(10) || 'C. ' || coalesce(doc_type, '') || chr(10) || 'D. x' prompt from documents")
def question_prompts(spark, d):
    x = table(spark, d, "documents", "doc_id", "title", "source", "lang", "doc_type")
    return x.select("doc_id", questions.prompt(F.col("title"), [F.col("source"), F.col("lang"), F.col("doc_type"), F.lit("x")]).alias("prompt"))


@query("with p as (select distinct source_profile, unnest(['excel', 'pdf', 'word']) source_type from document_records) select source_type, source_profile, case when source_type in ('excel', 'pdf') then source_profile = source_type else source_profile in ('native_docx', 'converted_docx') end fits from p")
def question_profiles(spark, d):
    x = table(spark, d, "document_records", "source_profile").distinct().withColumn("source_type", F.explode(F.array(*map(F.lit, ["excel", "pdf", "word"]))))
    return x.select("source_type", "source_profile", questions.profile_fits(F.col("source_type"), F.col("source_profile")).alias("fits"))


@query("with f as (select document_id, list_sort(list_distinct(list(source_id) filter (source_id is not null))) s from table_facts where document_id is not null group by 1), e as (select document_id, list_sort(list_distinct(list(source_id) filter (source_id is not null))) s from evidence where document_id is not null group by 1) select f.document_id question_id, list_sort(list_distinct(list_concat(coalesce(f.s, []), coalesce(e.s, [])))) retrieved, coalesce(e.s, []) reranked from f left join e using (document_id)")
def retrieved_sources(spark, d):
    """Facts as the candidates and evidence as the evidence of a retrieval event of their document."""
    ids = lambda t, n: table(spark, d, t, "document_id", "source_id").filter("document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("source_id")).alias(n))
    x = ids("table_facts", "c").join(ids("evidence", "e"), "document_id", "left")
    as_structs = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.struct(s.alias("source_id")))
    payload = F.to_json(F.struct(as_structs(F.col("c")).alias("candidates"), as_structs(F.col("e")).alias("evidence"), F.array().cast("array<struct<chunk:struct<source_id:string>>>").alias("hits")))
    return questions.retrieved_sources(x.select(F.col("document_id").alias("question_id"), F.lit(1).alias("seq"), F.lit("retrieval").alias("event_type"), payload.alias("payload")))


# Retrieval


@query("with " + catalog._BM25.replace("from documents where text is not null)", "from documents where text is not null and lang in ('zh', 'zh-en'))").replace("from (select distinct doc_id from documents) a", "from (select distinct doc_id from documents where lang in ('zh', 'zh-en')) a") + " select query_id, doc_id, score from hb")
def bm25_facets(spark, d):
    """The word search within two languages: the filter goes before the index, so lengths and frequencies are theirs."""
    docs = table(spark, d, "documents", "doc_id", "text", "title", "lang")
    asked = docs.filter("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    held = retrieval.facet_filter(docs, {"lang": ["zh", "zh-en"], "title": []}).select("doc_id", "text")
    return retrieval.bm25_query(asked, held, "doc_id", "text").select("query_id", "doc_id", "score")


@query(f"with {catalog._BM25} select query_id, doc_id, score, cast(\"rank\" as integer) \"rank\" from hb")
def profile_bm25_only(spark, d):
    hits = catalog._sparse(spark, d)
    return retrieval.by_profile(hits.limit(0), hits, "doc_id", "bm25_only")


@query(f"with {catalog._COSINE} select query_id, query_id = vec_id passed from de where \"rank\" = 1")
def smoke_check(spark, d):
    """Every query vector must find itself first (its twins, if it has any, come before it)."""
    v = table(spark, d, "embeddings", "vec_id").filter("vec_id % 100 = 0")
    return retrieval.smoke(catalog._dense(spark, d), v, "vec_id")


@query(f"""with {catalog._BM25}, x as (select hb.query_id, q.title, hb."rank" r, hb.doc_id, sha256(t.text) h from hb join documents q on q.doc_id = hb.query_id join documents t on t.doc_id = hb.doc_id)
select query_id, sha256('{{"candidates":[' || string_agg('{{"chunk_id":"' || doc_id || '","text_sha256":"' || h || '"}}', ',' order by r) || '],"question":' || any_value(to_json(title)) || '}}') digest from x group by query_id""")
def rerank_digests(spark, d):
    hits = catalog._sparse(spark, d)
    docs, asked = catalog._docs(spark, d)
    x = hits.join(docs.select("doc_id", F.sha2("text", 256).alias("text_sha256")), "doc_id").join(asked.withColumnRenamed("text", "question"), "query_id")
    return retrieval.request_digest(x, "doc_id")


@query("""with a as (select source_id, arg_min(original_file_name, original_file_name) n from source_files group by 1), e as (select distinct evidence_id, source_id, evidence_type, excerpt from evidence), x as (select e.*, n, lower(regexp_extract(coalesce(n, ''), '\\.([^.]+)$', 1)) s from e left join a using (source_id))
select evidence_id, source_id, case when s in ('doc','docx','pdf','xls','xlsx') then n when evidence_type in ('cell','calculation') then '确定性事实查询结果.xlsx' else '知识库证据.pdf' end original_file_name, case when s in ('doc','docx','pdf','xls','xlsx') then s when evidence_type in ('cell','calculation') then 'xlsx' else 'pdf' end source_format, substr(excerpt, 1, 1200) excerpt from x""")
def evidence_citations(spark, d):
    aliases = table(spark, d, "source_files", "source_id", "original_file_name").withColumn("is_canonical", F.lit(None).cast("boolean"))
    return retrieval.citations(table(spark, d, "evidence", "evidence_id", "source_id", "evidence_type", "excerpt").distinct(), aliases)


@query("""with p as (select distinct document_id query_id, case when hash_ % 4 = 0 then 'document' when hash_ % 4 = 1 then 'structured' when hash_ % 4 = 2 then 'mixed' else 'reject' end route from (select document_id, ascii(right(document_id, 1)) hash_ from table_facts where document_id is not null)),
s as (select document_id query_id, evidence_id, row_number() over (partition by document_id order by evidence_id) p from (select distinct document_id, evidence_id from table_facts where document_id is not null and evidence_id is not null)),
t as (select document_id query_id, evidence_id, row_number() over (partition by document_id order by evidence_id) p from (select distinct document_id, evidence_id from evidence where document_id is not null and evidence_id is not null)),
u as (select query_id, evidence_id, 0 o, p from s where query_id in (select query_id from p where route in ('structured', 'mixed')) union all select query_id, evidence_id, 1, p from t where query_id in (select query_id from p where route in ('document', 'mixed'))),
f as (select query_id, evidence_id, min((o, p)) \"at\" from u group by 1, 2)
select query_id, evidence_id, cast(\"at\"[1] as integer) origin, cast(row_number() over (partition by query_id order by \"at\", evidence_id) as integer) \"position\" from f""")
def route_evidence(spark, d):
    def ordered(t):
        x = table(spark, d, t, "document_id", "evidence_id").dropna().distinct().select(F.col("document_id").alias("query_id"), "evidence_id", F.lit(0).alias("score"))
        return retrieval.top(x, "evidence_id", 1 << 30).select("query_id", "evidence_id", F.col("rank").alias("position"))

    code = F.pmod(F.ascii(F.substring("document_id", -1, 1)), F.lit(4))
    plans = table(spark, d, "table_facts", "document_id").filter("document_id is not null").distinct().select(F.col("document_id").alias("query_id"), F.when(code == 0, "document").when(code == 1, "structured").when(code == 2, "mixed").otherwise("reject").alias("route"))
    return retrieval.by_route(plans, ordered("evidence"), ordered("table_facts"))


@query("""with e as (select document_id question_id, evidence_id, row_number() over (partition by document_id order by evidence_id) p, excerpt from (select evidence_id, any_value(document_id) document_id, any_value(excerpt) excerpt from evidence where document_id is not null group by 1)), q as (select distinct document_id question_id from document_records where document_id is not null)
select q.question_id, md5(coalesce(string_agg(excerpt, chr(10) order by p) filter (p <= 3), '')) text_md5, coalesce(list(evidence_id order by p) filter (p <= 3), []) cited_ids, case when count(evidence_id) = 0 then 'no_evidence' end refusal_reason from q left join e using (question_id) group by 1""")
def answer_drafts(spark, d):
    e = table(spark, d, "evidence", "evidence_id", "document_id", "excerpt").filter("document_id is not null").dropDuplicates(["evidence_id"])
    e = e.select(F.col("document_id").alias("question_id"), "evidence_id", F.row_number().over(Window.partitionBy("document_id").orderBy("evidence_id")).alias("position"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))
    q = table(spark, d, "document_records", "document_id").filter("document_id is not null").distinct().select(F.col("document_id").alias("question_id"), F.lit("").alias("question"))
    return gates.drafts(q, e).select("question_id", F.md5("answer_text").alias("text_md5"), "cited_ids", "refusal_reason")


@query("""with q as (select distinct document_id from document_records where document_id is not null), n as (select document_id, count(*) c from table_facts group by 1)
select 'answer_' || substr(sha256('["' || document_id || '","refused","no_evidence"]'), 1, 24) answer_id, document_id question_id, 'refused' status, 'no_evidence' refusal_reason, cast(0 as bigint) n_dense, cast(0 as bigint) n_bm25, cast(0 as bigint) n_fused, cast(0 as bigint) n_reranked, coalesce(c, 0) n_facts from q left join n using (document_id)""")
def declined_answers(spark, d):
    q = table(spark, d, "document_records", "document_id").filter("document_id is not null").distinct().select(F.col("document_id").alias("question_id"), F.lit("no_evidence").alias("reason"))
    zero = [F.lit(0).alias(n) for n in ("n_dense", "n_bm25", "n_fused", "n_reranked")]
    n = table(spark, d, "table_facts", "document_id").filter("document_id is not null").groupBy(F.col("document_id").alias("question_id")).agg(F.count(F.lit(1)).alias("n_facts")).select("question_id", *zero, "n_facts")
    return gates.declined(q, n)


# Jobs


@query(f"with {catalog._STATES} select job_id, file_id, case when status = 'completed' then 100 else cast(round_even(100 * coalesce(r, 0) / 8.0, 0) as integer) end progress from fs")
def job_file_progress(spark, d):
    return jobs.file_states(catalog._events(spark, d)).select("job_id", "file_id", "progress")


@query(f"with {catalog._STATES} select job_id, cast(round_even(avg(case when status = 'completed' then 100 else cast(round_even(100 * coalesce(r, 0) / 8.0, 0) as integer) end), 0) as integer) progress, count(*) n_files from fs group by 1")
def job_progress(spark, d):
    return jobs.job_states(jobs.file_states(catalog._events(spark, d))).select("job_id", "progress", "n_files")


@query("""with x as (select user_id answer_id, event_id seq, case event_type when 'click' then 'delta' when 'view' then 'status' when 'purchase' then 'completed' when 'signup' then 'citations' else 'other' end e from events), y as (select *, nullif(coalesce(list_position(['status','delta','citations','usage','completed','error'], e), 0), 0) r from x), z as (select *, lag(r) over (partition by answer_id order by seq) b from y),
g as (select answer_id, bool_or(r < b) back, bool_or(r is null) unknown, arg_max(e, seq) l, count(*) filter (e in ('completed', 'error')) n from z group by 1)
select cast(answer_id as varchar) answer_id, problem from (select answer_id, unnest(list_filter([case when back then 'backwards' end, case when unknown then 'unknown' end, case when l not in ('completed', 'error') or n <> 1 then 'not_ended' end], lambda p: p is not null)) problem from g)""")
def answer_event_order(spark, d):
    kind = F.when(F.col("event_type") == "click", "delta").when(F.col("event_type") == "view", "status").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "citations").otherwise("other")
    return jobs.event_order_problems(table(spark, d, "events", "user_id", "event_id", "event_type").select(F.col("user_id").cast("string").alias("answer_id"), F.col("event_id").alias("seq"), kind.alias("event")))


@query("select question_id, route, case when route in ('structured', 'mixed') then [] else entities end entities, ['s1', 's2'] sources from (select doc_id question_id, case when lang = 'zh' then 'structured' when lang = 'en' then 'document' else 'mixed' end route, [coalesce(source, '')] entities from documents)")
def scoped_plans(spark, d):
    route = F.when(F.col("lang") == "zh", "structured").when(F.col("lang") == "en", "document").otherwise("mixed")
    x = table(spark, d, "documents", "doc_id", "lang", "source").select(F.col("doc_id").alias("question_id"), route.alias("route"), F.array(F.coalesce("source", F.lit(""))).alias("entities"))
    return planner.scoped(x, ["s2", "s1", "s2"])


@query("select distinct s.source_id, case when s.source_sha256 is null then 'missing' else 'known' end state, f.reuse from source_files s left join (select source_sha256, min(source_id) reuse from source_files where source_sha256 is not null group by 1 having count(distinct source_id) > 1) f on f.source_sha256 = s.source_sha256 and f.reuse <> s.source_id")
def source_reuse(spark, d):
    """Sources of a content that another one, the smallest id, has already brought."""
    s = table(spark, d, "source_files", "source_id", "source_sha256").distinct()
    done = s.filter("source_sha256 is not null").select(F.col("source_sha256").alias("source_id"), F.col("source_id").alias("path"))
    x = corpus.resume_duplicates(s.select(F.col("source_id").alias("path"), F.col("source_sha256").alias("source_id")), done)
    return x.select(F.col("path").alias("source_id"), F.when(F.col("source_id").isNull(), "missing").otherwise("known").alias("state"), "reuse").distinct()
