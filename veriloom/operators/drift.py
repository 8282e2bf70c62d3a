"""Schemas that drift between files: fingerprints, changes, migration steps and one consistent table.

Input rows are records as delivered: (feed_id, file_no, source_file, period_end, payload), payload a JSON object, and
raw_id where there is one. A file is a (feed_id, file_no); the file before it is the one with the next lower file_no in
the feed, whatever the order of arrival. Rows may be delivered twice. A field is in a file if any record has it, null
included; names compare exactly. Types are JSON's; null gives none.

registry   one pass over the payloads gives each file its fields, the fingerprint of them, its version within the feed,
           and the fields of the file before it
steps      only where the fingerprint differs from that of the file before, the two schemas are compared, and the
           explicit migration steps between the two versions recorded:
  rename     a field gone and a field new have the same content in all records that both files hold (told by the record
             key), at least one of them not null; both fields then count once
  default    another field gone: it gets the default, null
  extend     another field new
  cast       a field in both files whose sets of types differ, both not empty
changes    the steps, read as changes: renamed, removed, added, type_changed
consistent each file's records, sent through the chain of steps of its feed into one table
Rows with a null feed_id or file_no belong to no order and give no change; a payload that is no JSON object has no
fields. A feed's first file has no changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import cut

FILE = ["feed_id", "file_no"]
# Types as bits, so that a set of them is a number: string, number, boolean, array, object.
KINDS = ["string", "number", "boolean", "array", "object"]


def _records(raw: DataFrame, *columns: str) -> DataFrame:
    """The rows that belong to a file, with their payload as a map of variants (null if it is no object)."""
    v = raw.filter(F.col("feed_id").isNotNull() & F.col("file_no").isNotNull()).select(*FILE, *columns, F.try_parse_json("payload").alias("doc"))
    is_object = F.schema_of_variant("doc").startswith("OBJECT")
    return v.withColumn("m", F.when(is_object, F.expr("cast(doc as map<string, variant>)")))


def _bit(value: Column) -> Column:
    """The bit of a variant's type; 0 for null."""
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (shape == "VOID"), 0)
        .when(shape == "STRING", 1)
        .when(shape == "BOOLEAN", 4)
        .when(shape.startswith("ARRAY"), 8)
        .when(shape.startswith("OBJECT"), 16)
        .otherwise(2)
    )


def _kinds(bits: Column) -> Column:
    """The names of a set of types, sorted and joined by |."""
    return F.array_join(F.array_compact(F.array(*(F.when(bits.bitwiseAND(1 << i) != 0, k) for i, k in sorted(enumerate(KINDS), key=lambda x: x[1])))), "|")


def registry(raw: DataFrame) -> DataFrame:
    """One row per file: (feed_id, file_no, source_file, period_end, k, columns, fingerprint, version, prior_no,
    prior_columns, prior_fingerprint), k its place in the feed, columns a sorted list of (name, bits) structs.

    The fingerprint is the SHA-256 of the sorted name:types list. The version starts at 1 and grows by one at each file
    whose fingerprint differs from that of the file before it.
    """
    told = _records(raw, "source_file", "period_end")
    flat = told.select(*FILE, "source_file", "period_end", F.explode_outer("m").alias("name", "value"))
    per_field = flat.groupBy(*FILE, "name").agg(F.bit_or(_bit(F.col("value"))).alias("bits"), F.min("source_file").alias("source_file"), F.min("period_end").alias("period_end"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "bits"))
    per_file = per_field.groupBy(*FILE).agg(F.min("source_file").alias("source_file"), F.min("period_end").alias("period_end"), F.array_sort(F.collect_list(entry)).alias("columns"))
    spelled = F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), _kinds(c["bits"])))
    w = Window.partitionBy("feed_id").orderBy("file_no")
    x = per_file.withColumn("fingerprint", F.sha2(F.concat_ws(",", spelled), 256))
    x = x.withColumns({"k": F.row_number().over(w), **{f"prior_{n}": F.lag(c).over(w) for n, c in (("no", "file_no"), ("columns", "columns"), ("fingerprint", "fingerprint"))}})
    moved = F.coalesce((F.col("prior_fingerprint") != F.col("fingerprint")).cast("int"), F.lit(0))
    return x.withColumn("version", (F.lit(1) + F.sum(moved).over(w)).cast("long"))


def _differences(files: DataFrame) -> DataFrame:
    """The files whose fingerprint differs from that of the file before: (…, gone, new, typed), lists of names."""
    x = files.filter("prior_no is not null and fingerprint <> prior_fingerprint")
    bits = lambda c: F.map_from_entries(c)
    names = lambda c: F.transform(c, lambda e: e["name"])
    x = x.withColumns({"now": bits(F.col("columns")), "was": bits(F.col("prior_columns"))})
    typed = F.filter("columns", lambda e: (e["bits"] != 0) & (F.coalesce(F.element_at("was", e["name"]), F.lit(0)) != 0) & (F.element_at("was", e["name"]) != e["bits"]))
    return x.select(*FILE, "source_file", "k", "prior_no", F.array_except(names(F.col("prior_columns")), names(F.col("columns"))).alias("gone"), F.array_except(names(F.col("columns")), names(F.col("prior_columns"))).alias("new"), names(typed).alias("typed"))


def _renames(raw: DataFrame, differing: DataFrame, key: str) -> DataFrame:
    """(feed_id, file_no, renamed): per file a list of (prior_name, name).

    Only files that both lose and gain fields, and the files before them, are read again, and only for those fields.
    The contents of a record in both files meet in one shuffle by record, whose counts meet in one by file.
    """
    both = differing.filter("size(gone) > 0 and size(new) > 0")
    side = lambda no, names, now: both.select("feed_id", F.col(no).alias("file_no"), F.col("file_no").alias("at_no"), F.col(names).alias("names"), F.lit(now).alias("now"))
    reads = side("file_no", "new", True).unionByName(side("prior_no", "gone", False))
    found = _records(raw).withColumn("rec", F.expr(f"variant_get(doc, '$.{key}', 'string')")).filter("rec is not null").join(reads, FILE)
    cells = F.transform(F.col("names"), lambda n: F.struct(F.col("now"), n.alias("name"), F.to_json(F.when(_bit(F.element_at("m", n)) != 0, F.element_at("m", n))).alias("content")))
    held = found.select("feed_id", "at_no", "rec", "now", F.explode(cells).alias("cell"))
    rec = held.groupBy("feed_id", "at_no", "rec").agg(F.bool_or("now").alias("n"), F.bool_or(~F.col("now")).alias("w"), F.collect_set(F.when(F.col("cell.content").isNotNull(), F.col("cell"))).alias("cells"))
    rec = rec.filter("n and w").withColumns({"a": F.filter("cells", lambda c: ~c["now"]), "b": F.filter("cells", lambda c: c["now"])})
    vote = lambda a, b: F.struct(a.alias("prior_name"), b.alias("name"))
    none = F.lit(None).cast("string")
    same = F.flatten(F.transform("a", lambda x: F.transform(F.filter("b", lambda y: y["content"] == x["content"]), lambda y: vote(x["name"], y["name"]))))
    votes = F.concat(F.transform("a", lambda x: vote(x["name"], none)), F.transform("b", lambda y: vote(none, y["name"])), same)
    counted = rec.select("feed_id", "at_no", F.explode(votes).alias("v")).groupBy("feed_id", "at_no", "v.prior_name", "v.name").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("feed_id", "at_no").agg(F.collect_list(F.struct("prior_name", "name", "n")).alias("v"))
    agreed = F.filter("v", lambda x: x["prior_name"].isNotNull() & x["name"].isNotNull() & ~F.exists("v", lambda y: (y["n"] != x["n"]) & ((y["prior_name"].isNull() & (y["name"] == x["name"])) | (y["name"].isNull() & (y["prior_name"] == x["prior_name"])))))
    # Should several fields agree, the smallest names pair up, each used once.
    less = lambda one, other: lambda x: F.size(F.filter("agreed", lambda y: (y[one] == x[one]) & (y[other] < x[other])))
    once = F.filter("agreed", lambda x: less("prior_name", "name")(x) == less("name", "prior_name")(x))
    return per.withColumn("agreed", agreed).select("feed_id", F.col("at_no").alias("file_no"), F.transform(once, lambda x: F.struct(x["prior_name"], x["name"])).alias("renamed"))


def steps(raw: DataFrame, key: str = "rec_key", files: DataFrame | None = None) -> DataFrame:
    """The recorded migration steps: (feed_id, file_no, source_file, k, step, field_name, prior_name)."""
    files = cut(registry(raw)) if files is None else files
    differing = _differences(files)
    x = differing.join(_renames(raw, differing, key), FILE, "left").withColumn("renamed", F.coalesce("renamed", F.array().cast("array<struct<prior_name:string,name:string>>")))
    left = lambda names, part: F.array_except(names, F.transform("renamed", lambda r: r[part]))
    step = lambda kind, name, prior: F.struct(F.lit(kind).alias("step"), name.alias("field_name"), prior.alias("prior_name"))
    none = F.lit("")
    all_steps = F.concat(
        F.transform("renamed", lambda r: step("rename", r["name"], r["prior_name"])),
        F.transform(left(F.col("gone"), "prior_name"), lambda n: step("default", n, none)),
        F.transform(left(F.col("new"), "name"), lambda n: step("extend", n, none)),
        F.transform("typed", lambda n: step("cast", n, none)),
    )
    return x.select(*FILE, "source_file", "k", F.explode(all_steps).alias("s")).select(*FILE, "source_file", "k", "s.*")


_CHANGE = {"rename": "renamed", "default": "removed", "extend": "added", "cast": "type_changed"}


def changes(raw: DataFrame, key: str = "rec_key") -> DataFrame:
    """(feed_id, file_no, source_file, change_kind, field_name, prior_name): the recorded steps, read as changes."""
    kind = F.element_at(F.create_map(*(F.lit(v) for kv in _CHANGE.items() for v in kv)), F.col("step"))
    return steps(raw, key).select(*FILE, "source_file", kind.alias("change_kind"), "field_name", "prior_name")


def schema_versions(raw: DataFrame) -> DataFrame:
    """Per file: the fingerprint of its schema, the version it has within its feed and the number of fields."""
    return registry(raw).select(*FILE, "source_file", "period_end", "fingerprint", "version", F.size("columns").alias("n_fields"))


def unified_version(spelled: Column) -> Column:
    """A delivered version in one spelling: '2.0', 'v2' and 'V2' as V2, 'V2-2022' and 'v2_2022' as V2_2022; other
    text in upper case, blank as null."""
    t = F.regexp_replace(F.upper(F.trim(spelled)), r"[-\s.]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"^V?_?([0-9]+)(_0+)*$", "V$1"), r"^V?_?([0-9]+)_((?:19|20)[0-9]{2})$", "V$1_$2")
    return F.nullif(t, F.lit(""))


def delivered_versions(raw: DataFrame, kind: str, spelled: Column) -> DataFrame:
    """Per file: the versions its rows were delivered with, unified, as a sorted list, and how many rows have none."""
    x = raw.filter(F.col("feed_id").isNotNull() & F.col("file_no").isNotNull()).select(*FILE, unified_version(spelled).alias("v"))
    return x.groupBy(*FILE).agg(F.array_sort(F.collect_set("v")).alias(f"delivered_{kind}_versions"), F.count_if(F.col("v").isNull()).alias(f"n_no_{kind}_version"))


def migrations(raw: DataFrame, key: str = "rec_key") -> DataFrame:
    """The explicit steps from each file's schema to the next: rename, drop, default (null) and cast, in that order."""
    rank = F.array_position(F.array(*map(F.lit, _CHANGE)), F.col("step"))
    w = Window.partitionBy(*FILE).orderBy(rank, "field_name", "prior_name")
    return steps(raw, key).select(*FILE, "source_file", F.row_number().over(w).alias("step_no"), "step", "field_name", "prior_name")


def routes(raw: DataFrame, wanted: list[str], key: str = "rec_key") -> DataFrame:
    """Where the field of each file goes: (feed_id, file_no, name, bits, to, level).

    A field's stretch is a run of files, one after the other, that hold its name; rename steps join stretches of a feed
    into chains. A field goes to the wanted name (the first of `wanted`, should there be several) that its chain holds
    (level 0). Should it hold none, the chains that share a name with it are asked, of other feeds too: if all of them
    that lead to a wanted name lead to the same one, that is taken (level 1), and further chains may ask this one. Else
    the field keeps the last name of its chain (level 2).
    Chains are followed by pointer doubling, so their length doesn't count, and no feed is gathered in one place.
    """
    files = cut(registry(raw))
    held = files.select("feed_id", "file_no", "k", F.explode("columns").alias("c")).select("feed_id", "file_no", "k", "c.name", "c.bits")
    by_name = Window.partitionBy("feed_id", "name").orderBy("k")
    ident = lambda name, k: F.concat_ws("\x01", "feed_id", name, k)
    held = cut(held.withColumn("gap", F.coalesce(F.lag("k").over(by_name), F.lit(-1)) != F.col("k") - 1).withColumn("start", F.max(F.when(F.col("gap"), F.col("k"))).over(by_name.rowsBetween(Window.unboundedPreceding, 0))).withColumn("id", ident("name", "start")).drop("gap"))
    renames = steps(raw, key, files).filter("step = 'rename'").select("feed_id", "k", "prior_name", F.col("field_name").alias("name"))
    before = held.select("feed_id", (F.col("k") + 1).alias("k"), F.col("name").alias("prior_name"), "id")
    following = cut(renames.join(before, ["feed_id", "k", "prior_name"]).select("id", ident("name", "k").alias("next")))
    ends = following.select(F.col("next").alias("id"), F.col("next").alias("next"))
    pointers = cut(following.unionByName(ends.join(following.select("id"), "id", "left_anti")))
    while True:
        jump = pointers.select(F.col("id").alias("next"), F.col("next").alias("further"))
        moved = cut(pointers.join(jump, "next").select("id", F.col("further").alias("next"), (F.col("further") != F.col("next")).alias("moved")))
        pointers = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    told = held.select("id", "name").distinct().join(pointers, "id", "left").select("id", "name", F.coalesce("next", "id").alias("chain"))
    last = F.element_at(F.split("chain", "\x01"), -2)
    rank = F.array_position(F.array(*map(F.lit, wanted or [""])), F.col("name"))
    chains = told.groupBy("chain").agg(F.min_by("name", F.when(rank > 0, rank)).alias("own"), F.collect_set("name").alias("names"))
    chains = cut(chains)
    # Rounds of asking, until no further chain learns where it leads; each settles at least one name of the vocabulary.
    settled = chains.filter("own is not null").select("chain", "names", F.col("own").alias("to"), F.lit(0).alias("level"))
    open_ = chains.filter("own is null").select("chain", "names")
    while True:
        votes = settled.select(F.explode("names").alias("name"), "to").distinct()
        asked = open_.select("chain", F.explode("names").alias("name")).join(votes, "name").groupBy("chain").agg(F.min("to").alias("to"), F.max("to").alias("b")).filter("to = b").select("chain", "to")
        learnt = cut(open_.join(asked, "chain").select("chain", "names", "to", F.lit(1).alias("level")))
        if not learnt.limit(1).count():
            break
        settled = settled.unionByName(learnt)
        open_ = open_.join(learnt.select("chain"), "chain", "left_anti")
    goal = told.join(settled.select("chain", "to", "level"), "chain", "left").select("id", F.coalesce("to", last).alias("to"), F.coalesce("level", F.lit(2)).alias("level"))
    return held.join(goal, "id").select(*FILE, "name", "bits", "to", "level")


def plain(kind: Column, content: Column) -> Column:
    """The cast rule: a scalar of any JSON type as text; a list of one as its element; an object as the member that
    carries its text (text, code, value, amount, name) or its number (num), if it has one; anything else stays JSON."""
    v = F.parse_json(content)
    inner = F.coalesce(*(F.try_variant_get(v, f"$.{m}", "string") for m in ("text", "code", "value", "amount", "name", "num")))
    single = F.when(F.try_variant_get(v, "$[1]", "string").isNull(), F.try_variant_get(v, "$[0]", "string"))
    return F.when(kind == "object", F.coalesce(inner, content)).when(kind == "array", F.coalesce(single, content)).otherwise(v.cast("string"))


def ungrouped(text: Column) -> Column:
    """A number without its thousands commas; text that isn't wholly a number so grouped stays."""
    return F.when(text.rlike(r"^\s*[-+]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?\s*$"), F.regexp_replace(text, ",", "")).otherwise(text)


def typed(text: Column, kind: str) -> Column:
    """Text as a value of the target type, null where it isn't one or would lose digits."""
    if kind == "string":
        return text
    if not kind.startswith("decimal"):
        return text.try_cast(kind)
    value, whole = ungrouped(text).try_cast(kind), ungrouped(text).try_cast("decimal(38,18)")
    return F.when(value == whole, value)


def consistent(raw: DataFrame, wanted: list[str] | dict[str, str], key: str = "rec_key") -> DataFrame:
    """All files as one table: (feed_id, file_no, source_file, schema_version, rec, one column per wanted field,
    extra_fields, uncast_fields), one row per file and distinct delivered record.

    `wanted` gives each field its target type; in a list all are text. Each file's fields go along their routes (the
    chained renames), then through the cast rule (plain, typed); a wanted field that a file lacks gets the default null.
    Other fields stay in the map extra_fields under the name they lead to, those that are numbers in any record without
    thousands commas; what can't be cast keeps its text in the map uncast_fields. Should two fields of a record lead to
    one column, the one of the lower level and then the smaller name takes it, and the other stays in extra_fields under
    its own name, so nothing is lost. A record delivered twice (same raw_id, or same payload where there is none) counts
    once; records without a key are rows of their own.
    """
    kinds = wanted if isinstance(wanted, dict) else dict.fromkeys(wanted, "string")
    wanted = list(kinds)
    way = routes(raw, wanted, key).filter(F.col("name") != key)
    number = F.col("bits").bitwiseAND(2) != 0
    numbers = way.groupBy("to").agg(F.bool_or(number).alias("number"))
    way = way.join(numbers, "to")
    per_file = way.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("to", "level", "number")))).alias("way"))
    versions = registry(raw).select(*FILE, F.col("source_file").alias("_file"), F.col("version").alias("schema_version"))
    own = [c for c in ("raw_id",) if c in raw.columns]
    once = raw.dropDuplicates([*FILE, *own, "payload"])
    x = _records(once).filter("m is not null").withColumn("rec", F.expr(f"variant_get(doc, '$.{key}', 'string')")).join(per_file, FILE, "left").join(versions, FILE)

    def cell(e: Column) -> Column:
        bit = _bit(e["value"])
        kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.log2(bit) + 1).cast("int"))
        to = F.element_at("way", e["key"])
        return F.struct(to["level"].alias("level"), e["key"].alias("name"), to["to"].alias("to"), to["number"].alias("number"), plain(kind, F.to_json(e["value"])).alias("text"))

    told = F.filter(F.map_entries("m"), lambda e: (e["key"] != key) & (_bit(e["value"]) != 0))
    x = x.withColumn("cells", F.array_sort(F.transform(told, cell)))
    x = x.select(*FILE, F.col("_file").alias("source_file"), "schema_version", "rec", F.filter("cells", lambda c: c["text"].isNotNull()).alias("cells"))
    # The first cell of each goal, in the order of level and name, has it; later ones keep their own name.
    x = x.withColumn("cells", F.transform("cells", lambda c, i: F.struct(F.when(F.exists(F.slice("cells", F.lit(1), i), lambda o: o["to"] == c["to"]), c["name"]).otherwise(c["to"]).alias("key"), F.when(c["number"] & ~c["to"].isin(*wanted), ungrouped(c["text"])).otherwise(c["text"]).alias("value"), (c["to"].isin(*wanted) & ~F.exists(F.slice("cells", F.lit(1), i), lambda o: o["to"] == c["to"])).alias("wanted"))))
    entries = lambda wanted_: F.map_from_entries(F.transform(F.filter("cells", lambda c: c["wanted"] == F.lit(wanted_)), lambda c: F.struct(c["key"], c["value"])))
    x = x.select(*FILE, "source_file", "schema_version", "rec", entries(True).alias("m"), entries(False).alias("extra_fields"))
    bad = [w for w in wanted if kinds[w] != "string"]
    at = lambda w: F.element_at("m", w)
    # map_filter leaves the fields whose text is there and has no value of the target type.
    failed = F.map_filter("m", lambda k, v: F.coalesce(*(F.when(k == w, v.isNotNull() & typed(v, kinds[w]).isNull()) for w in bad), F.lit(False))) if bad else F.map_filter("m", lambda k, v: F.lit(False))
    return x.select(*FILE, "source_file", "schema_version", "rec", *(typed(at(w), kinds[w]).alias(w) for w in wanted), "extra_fields", failed.alias("uncast_fields"))


def cast_failures(table: DataFrame) -> DataFrame:
    """(feed_id, file_no, source_file, change_kind, field_name, n_records, example): the values of a consistent table
    that no cast could bring to their type, counted per file and field as the change `uncast`."""
    x = table.select(*FILE, "source_file", F.explode("uncast_fields").alias("field_name", "text"))
    return x.groupBy(*FILE, "source_file", F.lit("uncast").alias("change_kind"), "field_name").agg(F.count(F.lit(1)).alias("n_records"), F.min("text").alias("example"))
