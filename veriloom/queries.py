"""Queries of the core operators: (spark, folder) -> DataFrame, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import catalog, corpus_queries, workbook_queries  # noqa: F401  (each adds its queries to the catalog)
from veriloom.operators import drift, units
from veriloom.operators import references as refs
from veriloom.session import table

REGION_COLUMNS = ["row_id", "release_id", "period_start", "period_end", "period_basis", "region_code", "region_name", "region_name_raw", "region_type", "metric_code", "metric_name", "metric_name_raw", "value", "value_status", "unit", "scope_version", "statistical_scope_version", "accounting_basis_version", "source_cell", "formula_raw", "number_format", "footnotes", "quality_flags"]
LIFE_COLUMNS = ["row_id", "release_id", "period_start", "period_end", "period_basis", "entity_code", "entity_name", "entity_type", "metric_code", "metric_name", "metric_name_raw", "parent_metric_code", "product_line", "product_line_name", "product_line_raw", "value", "value_status", "unit", "scope_version", "accounting_basis_version", "source_cell", "formula_raw", "number_format", "footnotes", "quality_flags"]
# The types of the facts tables; fields not named are text.
REGION_TYPES = dict.fromkeys(REGION_COLUMNS, "string") | {"period_start": "date", "period_end": "date", "value": "decimal(20,6)"}
LIFE_TYPES = dict.fromkeys(LIFE_COLUMNS, "string") | {"period_start": "date", "period_end": "date", "value": "decimal(38,18)"}


_REFS = """with tg as (select 'evidence_id' f, evidence_id id, deleted_at, created_at from evidence union all select 'document_id', document_id, deleted_at, created_at from document_records union all select 'source_id', source_id, deleted_at, created_at from source_files),
t as (select f, id, bool_and(deleted_at is not null) del, min(created_at) since from tg where id is not null group by 1, 2),
r as (select 'table_facts' table_name, fact_id record_id, 'evidence_id' field_name, 'evidence_id' f, evidence_id ref_id, created_at, strftime(period_end, '%Y-%m') period from table_facts
 union all select 'table_facts', fact_id, 'document_id', 'document_id', document_id, created_at, strftime(period_end, '%Y-%m') from table_facts union all select 'table_facts', fact_id, 'source_id', 'source_id', source_id, created_at, strftime(period_end, '%Y-%m') from table_facts
 union all select 'parent_chunks', parent_chunk_id, 'evidence_ids', 'evidence_id', unnest(evidence_ids), created_at, strftime(created_at, '%Y-%m') from parent_chunks),
x as (select r.*, case when t.id is null then 'missing' when t.del then 'deleted' when t.since > r.created_at then 'late' end reason from r left join t on t.f = r.f and t.id = r.ref_id where r.ref_id is not null)"""
_DRIFT_STEPS = """with r as (select distinct feed_id, file_no, cast(payload as json) p, json_extract_string(payload, '$.rec_key') rec from raw_records where feed_id is not null and file_no is not null),
fl as (select feed_id, file_no, min(source_file) source_file, lag(file_no) over (partition by feed_id order by file_no) prior_no from raw_records where feed_id is not null and file_no is not null group by 1, 2),
k as (select feed_id, file_no, rec, p, unnest(json_keys(p)) "name" from r),
v as (select feed_id, file_no, rec, "name", case json_type(p, '$."' || "name" || '"') when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end kind, cast(json_extract(p, '$."' || "name" || '"') as varchar) c from k),
s as (select feed_id, file_no, "name", list_sort(list(distinct kind) filter (kind is not null)) kinds from v group by 1, 2, 3),
o as (select fl.feed_id, fl.file_no, s."name", coalesce(s.kinds, []) kinds from fl join s on s.feed_id = fl.feed_id and s.file_no = fl.prior_no),
n as (select fl.feed_id, fl.file_no, s."name", coalesce(s.kinds, []) kinds from fl join s on s.feed_id = fl.feed_id and s.file_no = fl.file_no where fl.prior_no is not null),
b as (select coalesce(o.feed_id, n.feed_id) feed_id, coalesce(o.file_no, n.file_no) file_no, coalesce(o."name", n."name") "name", o.kinds old, n.kinds new from o full join n on n.feed_id = o.feed_id and n.file_no = o.file_no and n."name" = o."name"),
h as (select distinct fl.feed_id, fl.file_no, fl.prior_no, a.rec from fl join r a on a.feed_id = fl.feed_id and a.file_no = fl.file_no join r z on z.feed_id = fl.feed_id and z.file_no = fl.prior_no and z.rec = a.rec),
w as (select distinct h.feed_id, h.file_no, h.rec, v."name", v.c from h join v on v.feed_id = h.feed_id and v.file_no = h.prior_no and v.rec = h.rec join b on b.feed_id = h.feed_id and b.file_no = h.file_no and b."name" = v."name" and b.new is null where v.kind is not null),
u as (select distinct h.feed_id, h.file_no, h.rec, v."name", v.c from h join v on v.feed_id = h.feed_id and v.file_no = h.file_no and v.rec = h.rec join b on b.feed_id = h.feed_id and b.file_no = h.file_no and b."name" = v."name" and b.old is null where v.kind is not null),
m as (select w.feed_id, w.file_no, w."name" prior_name, u."name", count(*) c from w join u on u.feed_id = w.feed_id and u.file_no = w.file_no and u.rec = w.rec and u.c = w.c group by 1, 2, 3, 4),
e as (select m.* from m where c = (select count(*) from w where w.feed_id = m.feed_id and w.file_no = m.file_no and w."name" = m.prior_name) and c = (select count(*) from u where u.feed_id = m.feed_id and u.file_no = m.file_no and u."name" = m."name")),
d as (select feed_id, file_no, 'renamed' change_kind, "name" field_name, prior_name from e
 union all select feed_id, file_no, 'removed', "name", '' from b where new is null and not exists (select 1 from e where e.feed_id = b.feed_id and e.file_no = b.file_no and e.prior_name = b."name")
 union all select feed_id, file_no, 'added', "name", '' from b where old is null and not exists (select 1 from e where e.feed_id = b.feed_id and e.file_no = b.file_no and e."name" = b."name")
 union all select feed_id, file_no, 'type_changed', "name", '' from b where len(old) > 0 and len(new) > 0 and old <> new)"""
_DRIFT = f"""{_DRIFT_STEPS}
select distinct fl.source_file, change_kind, field_name, prior_name from d join fl on fl.feed_id = d.feed_id and fl.file_no = d.file_no"""
_MIGRATIONS = f"""{_DRIFT_STEPS}, st as (select *, case change_kind when 'renamed' then 1 when 'removed' then 2 when 'added' then 3 else 4 end o from d)
select st.feed_id, st.file_no, fl.source_file, cast(row_number() over (partition by st.feed_id, st.file_no order by o, field_name, prior_name) as integer) step_no, ['rename','default','extend','cast'][o] step, field_name, prior_name from st join fl on fl.feed_id = st.feed_id and fl.file_no = st.file_no"""
_UNIFIED = r"nullif(regexp_replace(regexp_replace(regexp_replace(upper(trim(schema_version)), '[-\s.]+', '_', 'g'), '^V?_?([0-9]+)(_0+)*$', 'V\1'), '^V?_?([0-9]+)_((?:19|20)[0-9]{2})$', 'V\1_\2'), '')"
_VERSIONS = f"""{_DRIFT_STEPS}, fp as (select fl.feed_id, fl.file_no, fl.source_file, sha256(coalesce(string_agg(s."name" || ':' || array_to_string(s.kinds, '|'), ',' order by s."name"), '')) fingerprint, count(s."name") n_fields from fl left join s on s.feed_id = fl.feed_id and s.file_no = fl.file_no group by 1, 2, 3),
ch as (select *, coalesce(cast(lag(fingerprint) over (partition by feed_id order by file_no) <> fingerprint as integer), 0) c from fp),
pe as (select feed_id, file_no, min(period_end) period_end, list_sort(coalesce(list(distinct {_UNIFIED}) filter ({_UNIFIED} is not null), [])) delivered_schema_versions, count(*) filter ({_UNIFIED} is null) n_no_schema_version from raw_records group by 1, 2)
select ch.feed_id, ch.file_no, source_file, period_end, fingerprint, cast(1 + sum(c) over (partition by ch.feed_id order by ch.file_no) as bigint) "version", cast(n_fields as integer) n_fields, delivered_schema_versions, n_no_schema_version from ch join pe on pe.feed_id = ch.feed_id and pe.file_no = ch.file_no"""


def _read_sql(of: str, scale: str | None) -> str:
    """struct(family, power) in SQL of the unit that a text names, as units.read_units reads it."""
    w = f"lower(trim(translate({of}, '{units._WIDE}', '{units._PLAIN}')))"
    any_ = units._any
    look = lambda m, x: "case " + x + "".join(f" when '{k}' then {v}" for k, v in m.items()) + " end"
    found = lambda p, t=w: f"regexp_extract({t}, '({p})', 1)"
    code, digits, letter = f"regexp_extract({w}, '^(cny|rmb|items?)_([0-9]+)([kmb]?)$', 1)", f"length(regexp_extract({w}, '_([0-9]+)[kmb]?$', 1))", f"regexp_extract({w}, '_[0-9]+([kmb])$', 1)"
    ratio, money = found(any_(units.RATIOS)), found(any_(units.MONEY))
    count = found(any_(units.COUNTS), f"regexp_replace({w}, '{any_(units.MONEY)}', ' ', 'g')")
    power = found(any_(units.POWERS), f"regexp_replace({w}, '{any_([*units.MONEY, 'items?', 'units?'])}', ' ', 'g')")
    rest = f"regexp_replace({w}, '{any_([*units.MONEY, *units.COUNTS, *units.POWERS])}', '', 'g')"
    family = f"case when {code} <> '' then case when {code} like 'item%' then 'count' else 'money' end when {ratio} <> '' then 'ratio' when regexp_matches({rest}, '[\\p{{L}}\\p{{N}}]') then null when {money} <> '' then 'money' when {count} <> '' then 'count' when {power} <> '' then 'money' end"
    base = f"case when {code} <> '' then {digits} - 1 + case {letter} when 'k' then 3 when 'm' then 6 when 'b' then 9 else 0 end when {ratio} <> '' then {look(units.RATIOS, ratio)} when {power} <> '' then {look(units.POWERS, power)} else 0 end"
    if scale is None:
        more = "0"
    else:
        s = f"lower(trim(translate({scale}, '{units._WIDE}', '{units._PLAIN}')))"
        n = f"try_cast(replace({s}, ',', '') as double)"
        word = found(any_(units.POWERS), s)
        more = f"case when {scale} is null then 0 when {n} > 0 then case when abs(log10({n}) - round(log10({n}))) < 1e-9 then cast(round(log10({n})) as integer) end when {word} <> '' then {look(units.POWERS, word)} end"
    return f"struct_pack(family := {family}, power := ({base}) + ({more}))"


_NUMBER_SQL = units._NUMBER.replace("'", "''")
# The words decide here what the ensemble predicts from them with certainty; where it doesn't, the rows differ.
_COMMON = rf"""with p as (select *, translate(raw_value, '{units._WIDE}', '{units._PLAIN}') plain, translate(normalized_value, '{units._WIDE}', '{units._PLAIN}') np from table_facts),
n as (select *, regexp_extract(plain, '({_NUMBER_SQL})', 1) num, regexp_extract(np, '({_NUMBER_SQL})', 1) nnum, trim(regexp_replace(regexp_replace(plain, '{_NUMBER_SQL}', ' ', 'g'), '[*#()\s]+', ' ', 'g')) words from p),
v as (select *, case when num like '(%)' then -abs(try_cast(regexp_replace(num, '[(),+\s]', '', 'g') as double)) else try_cast(regexp_replace(num, '[(),+\s]', '', 'g') as double) end x, case when nnum like '(%)' then -abs(try_cast(regexp_replace(nnum, '[(),+\s]', '', 'g') as double)) else try_cast(regexp_replace(nnum, '[(),+\s]', '', 'g') as double) end y from n),
u as (select *, {_read_sql('unit', 'scale')} f, {_read_sql('words', None)} t from v),
w as (select *, case when unit is not null and f.family is not null and f.power is not null then 'field' when coalesce(words, '') <> '' and t.family is not null and x is not null then 'predicted' else 'review' end src from u),
c as (select *, case src when 'field' then f.family when 'predicted' then t.family end family, case src when 'field' then f.power when 'predicted' then t.power end power from w),
d as (select *, x * pow(10.0, power + case family when 'money' then -8 else 0 end) common from c)"""
SQL: dict[str, str] = {
    "p4_found": f"{_COMMON} select distinct fact_id from d where common is not null and normalized_value is not null and (y is null or abs(y - common) > 0.001 * abs(common))",
    "p4_common_values": f"{_COMMON} select distinct fact_id, raw_value, unit, scale, family quantity, common_unit, round(common, 8) common_value, src unit_source, (x is not null and src = 'review') needs_review from d left join common_units on quantity = family",
    "p5_found": _DRIFT,
    "p5_migrations": _MIGRATIONS,
    "p5_fact_versions": "with x as (" + " union all ".join(f"select '{t}' table_name, source_file, '{c}' field_name, {c} spelled, {_UNIFIED.replace('schema_version', c)} \"version\" from {t}" for t in ("region_premium_facts", "life_insurance_facts") for c in ("schema_version", "scope_version")) + ") select table_name, source_file, field_name, \"version\", count(distinct spelled) n_spellings, count(*) n_rows from x group by 1, 2, 3, 4",
    "p5_schema_versions": _VERSIONS,
    "p6_found": f"{_REFS} select distinct table_name, record_id, field_name, ref_id, reason from x where reason is not null",
    "p6_counts": f"""{_REFS} select table_name, field_name, period, count(*) n_refs, count(*) filter (reason = 'missing') n_missing, count(*) filter (reason = 'deleted') n_deleted, count(*) filter (reason = 'late') n_late,
 count(distinct ref_id) filter (reason is not null) n_orphan_ids, round(count(*) filter (reason is not null) / count(*), 6) orphan_share from x group by 1, 2, 3""",
}

# Problem 4: quantities recorded in different units


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.misscaled(_converted(spark, d))


def _converted(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["fact_id", "source_id", "table_id", "metric_code", "metric_name", "entity_code", "period_basis", "raw_value", "normalized_value", "value_type", "unit", "scale", "statistical_scope", "accounting_basis", "sheet_name"]
    return units.convert(table(spark, d, "table_facts", *wanted))


def p4_common_values(spark: SparkSession, d: str) -> DataFrame:
    """Each fact once, in the common unit of its quantity, and how its unit was told."""
    names = table(spark, d, "common_units", "quantity", "common_unit")
    x = _converted(spark, d).withColumn("quantity", F.col("unit_family"))
    return x.join(names, "quantity", "left").select("fact_id", "raw_value", "unit", "scale", "quantity", "common_unit", F.round("common_value", 8).alias("common_value"), "unit_source", "needs_review").distinct()


def p4_review(spark: SparkSession, d: str) -> DataFrame:
    """The values left for review, with the chance of the unit predicted."""
    return units.review_queue(_converted(spark, d))


# Problem 5: schemas that drift between files


def _raw(spark: SparkSession, d: str, dataset: str | None = None) -> DataFrame:
    df = table(spark, d, "raw_records", *(["raw_id", "dataset"] if dataset else []), "feed_id", "file_no", "source_file", "period_end", "payload")
    return (df.filter(F.col("dataset") == dataset) if dataset else df).drop("dataset")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_raw(spark, d)).select("source_file", "change_kind", "field_name", "prior_name").distinct()


def p5_migrations(spark: SparkSession, d: str) -> DataFrame:
    return drift.migrations(_raw(spark, d))


def p5_schema_versions(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint version of each file beside the schema versions that it was delivered with."""
    raw = table(spark, d, "raw_records", "feed_id", "file_no", "schema_version")
    return drift.schema_versions(_raw(spark, d)).join(drift.delivered_versions(raw, "schema", F.col("schema_version")), drift.FILE, "left")


def p5_fact_versions(spark: SparkSession, d: str) -> DataFrame:
    """The schema and scope versions of the facts by source file, unified: spellings and rows of each (null: none told)."""
    out = None
    for t, fields in (("region_premium_facts", ["schema_version", "scope_version"]), ("life_insurance_facts", ["schema_version", "scope_version"])):
        cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("spelled")) for f in fields)))
        part = table(spark, d, t, "source_file", *fields).select(F.lit(t).alias("table_name"), "source_file", cells.alias("c")).select("table_name", "source_file", "c.*")
        out = part if out is None else out.unionByName(part)
    keys = ["table_name", "source_file", "field_name", drift.unified_version(F.col("spelled")).alias("version")]
    return out.groupBy(*keys).agg(F.count_distinct("spelled").alias("n_spellings"), F.count(F.lit(1)).alias("n_rows"))


def p5_region_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent(_raw(spark, d, "region_premium_facts"), REGION_TYPES)


def p5_life_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent(_raw(spark, d, "life_insurance_facts"), LIFE_TYPES)


def p5_region_uncast(spark: SparkSession, d: str) -> DataFrame:
    """What p5_region_table couldn't cast to its type, per file and field."""
    return drift.cast_failures(p5_region_table(spark, d))


def p5_life_uncast(spark: SparkSession, d: str) -> DataFrame:
    """What p5_life_table couldn't cast to its type, per file and field."""
    return drift.cast_failures(p5_life_table(spark, d))


# Problem 6: references to records that do not exist

_TARGETS = {"evidence": "evidence_id", "document_records": "document_id", "source_files": "source_id"}


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts = table(spark, d, "table_facts", "fact_id", *_TARGETS.values(), "created_at", "period_end")
    parents = table(spark, d, "parent_chunks", "parent_chunk_id", "evidence_ids", "created_at")
    link = lambda t, k, f, to, p: refs.Link(t, k, f, to, period=p)
    r = refs.references(facts, [link("table_facts", "fact_id", f, t, "period_end") for t, f in _TARGETS.items()])
    r = r.unionByName(refs.references(parents, [link("parent_chunks", "parent_chunk_id", "evidence_ids", "evidence", "created_at")]))
    return r, refs.targets({t: (table(spark, d, t, k, "created_at", "deleted_at"), k) for t, k in _TARGETS.items()})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return refs.orphans(*_references(spark, d)).select("table_name", "record_id", "field_name", "ref_id", "reason").distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return refs.orphan_counts(*_references(spark, d))


PROBLEMS = (p4_found, p4_common_values, p4_review, p5_found, p5_migrations, p5_schema_versions, p5_fact_versions, p5_region_table, p5_life_table, p5_region_uncast, p5_life_uncast, p6_found, p6_counts)


def queries():
    return {**catalog.QUERIES, **{f.__name__: f for f in PROBLEMS}}


def oracle_sql() -> dict[str, str]:
    return {**catalog.SQL, **SQL}
