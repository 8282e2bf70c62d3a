"""The corpus and its index on disk: streams with counts and hashes, saved indexes, snapshots that must be whole."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.sources.sinks import write_atomic

# What a snapshot's manifest must tell, and the embedding contract.
MANIFEST = ["snapshot_id", "knowledge_base_id", "corpus_sha256", "vector_collection", "vector_point_count", "facts_uri", "facts_sha256", "fact_count", "bm25_vocabulary_sha256", "embedding_model", "embedding_dimensions", "smoke_passed"]
#: Patterns of credentials in text, and of their assignment in configuration files.
SECRETS = [r"\bsk-[A-Za-z0-9]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"]
ASSIGNMENT = r"(?im)^\s*[\"']?[a-z_]*(?:api_key|secret|password|token)[\"']?\s*[:=]\s*[\"']?(?!\$\{|<|your|change|example|\s*$)[^\s\"'#]{8,}"


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n): ids that stand more than once with different content; must be empty before a corpus is written."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*rest))).alias("n")).filter("n > 1")


def write_corpus(streams: dict[str, DataFrame], root: str, keys: dict[str, str]) -> dict:
    """Each stream as JSON lines in a folder of its own under a new folder, and run.json with count and hash of each. The
    hash doesn't depend on the order of rows. Ids (keys: stream -> column) must not repeat with other content."""
    if os.path.exists(root):
        raise FileExistsError(root)
    for name, key in keys.items():
        if repeated_ids(streams[name], key).limit(1).count():
            raise ValueError(f"{name}: ids repeat")
    told = {}
    for name, df in streams.items():
        df.write.option("ignoreNullFields", "false").json(f"{root}/{name}")
        told[name] = content_hash(df)
    write_atomic(f"{root}/run.json", json.dumps({"streams": told}, ensure_ascii=False, sort_keys=True))
    return told


def content_hash(df: DataFrame) -> dict:
    """{count, sha256} of a table's rows, whatever their order: the hash of the sum, in words, of the rows' hashes."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"w{i}") for i in range(8)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *words).select("n", F.sha2(F.concat_ws(",", *(f"w{i}" for i in range(8))), 256).alias("h")).first()
    return {"count": r["n"], "sha256": r["h"]}


def save_index(index: tuple[DataFrame, DataFrame, DataFrame], path: str, schema: str = "bm25.v1") -> None:
    """A word index as tables: postings sorted by term, so that a search reads only the row groups of its terms, term
    statistics, corpus figures, and the schema it was made by. An existing path is never replaced."""
    for name, df, by in zip(("postings", "terms", "corpus"), index, ("term", "term", None)):
        out = df.repartitionByRange(by).sortWithinPartitions(by) if by else df.coalesce(1)
        out.write.mode("errorifexists").parquet(f"{path}/{name}")
    index[2].sparkSession.createDataFrame([(schema,)], "schema string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/about")


def load_index(spark: SparkSession, path: str, schema: str = "bm25.v1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A saved index; another schema, or a term that stands twice, is an error."""
    found = spark.read.parquet(f"{path}/about").first()["schema"]
    if found != schema:
        raise ValueError(f"the index was saved as {found}, not {schema}")
    postings, terms, corpus = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "corpus"))
    if terms.groupBy("term").count().filter("count > 1").limit(1).count():
        raise ValueError("the index holds a term twice")
    return postings, terms, corpus


def save_vectors(vectors: DataFrame, path: str, facets: list[str]) -> None:
    """Dense vectors with the columns that filters use, partitioned by the first of them."""
    vectors.write.mode("errorifexists").partitionBy(*facets[:1]).parquet(path)


def representative(chunks: DataFrame, profile: str, key: str, n: int) -> DataFrame:
    """The first n chunks of each profile by key: a small corpus for a trial build (a sampling operator)."""
    g = chunks.groupBy(profile).agg(F.slice(F.array_sort(F.collect_set(key)), 1, n).alias("k"))
    return chunks.join(g.select(profile, F.explode("k").alias(key)), [profile, key], "left_semi")


def inspect_facts(facts: DataFrame) -> dict[str, int]:
    """What a resumed build checks: rows and distinct ids of the stored facts."""
    r = facts.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("fact_id").alias("ids")).first()
    return {"rows": r["rows"], "ids": r["ids"]}


def manifest_problems(manifest: dict, model: str, dimensions: int, selected: int | None = None) -> list[str]:
    """What keeps a snapshot from being used: missing fields, a failed smoke test, empty stores, another embedding, or
    another number of points than was selected."""
    out = [f"missing:{k}" for k in MANIFEST if k not in manifest]
    if out:
        return out
    if not manifest["smoke_passed"]:
        out.append("smoke_failed")
    if int(manifest["vector_point_count"]) <= 0 or int(manifest["fact_count"]) <= 0:
        out.append("empty_store")
    if manifest["embedding_model"] != model or int(manifest["embedding_dimensions"]) != dimensions:
        out.append("other_embedding")
    if selected is not None and int(manifest["vector_point_count"]) != selected:
        out.append("point_count_differs")
    return out


def require_passed(runs: DataFrame) -> None:
    """All runs (run_id, status) that a corpus builds on must have passed."""
    bad = runs.filter("status is null or status not in ('passed', 'completed')").limit(5).collect()
    if bad:
        raise ValueError("runs that did not pass: " + ", ".join(str(r["run_id"]) for r in bad))


def relative_assets(text: Column, root: str) -> Column:
    """Text with absolute asset paths below a root, as file URIs or plain, made relative to it."""
    path = re.escape(root.rstrip("/"))
    return F.regexp_replace(text, rf"(?:file://)?{path}/", "")


def secrets(spark: SparkSession, root: str) -> DataFrame:
    """(path): text files under a folder that seem to hold a credential; only the path is told. Files named .env are
    always listed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    body = F.decode("content", "UTF-8")
    config = F.lower("path").rlike(r"\.(?:ya?ml|json|example|env|toml)$")
    hit = body.rlike("|".join(SECRETS)) | (config & body.rlike(ASSIGNMENT)) | F.col("path").rlike(r"/\.env$")
    return df.filter(hit).select(F.regexp_extract("path", re.escape(os.path.basename(os.path.abspath(root))) + "/(.*)$", 1).alias("path"))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """(key, path, origin): the file of each period; where it can't be read (content null), the official one, whose
    content must have the hash stated for it. primary: (key, path, content); fallback: (key, path, content, sha256)."""
    f = fallback.select(F.col(key).alias("_k"), F.col("path").alias("_path"), (F.sha2("content", 256) == F.lower("sha256")).alias("_ok"))
    x = primary.join(f, primary[key] == f["_k"], "left")
    own, spare = F.col("content").isNotNull(), F.coalesce(F.col("_ok"), F.lit(False))
    return x.select(key, F.when(own, F.col("path")).when(spare, F.col("_path")).alias("path"), F.when(own, "local_attachment").when(spare, "official_fallback").otherwise("missing").alias("origin"))


def dated_files(files: DataFrame, pattern: str) -> DataFrame:
    """(path, name, year, month) of the files whose name matches a pattern with year and month, in that order."""
    year, month = (F.regexp_extract("name", pattern, i).try_cast("int") for i in (1, 2))
    x = files.withColumns({"year": year, "month": month}).filter(F.col("name").rlike(pattern) & F.col("month").between(1, 12) & ~F.col("name").startswith("~$"))
    return x.select("path", "name", "year", "month").orderBy("year", "month", "name")


def unclaimed(files: DataFrame, *claimed: DataFrame) -> DataFrame:
    """The files that no parser has claimed by path."""
    out = files
    for c in claimed:
        out = out.join(c.select("path").distinct(), "path", "left_anti")
    return out


def origins(sources: DataFrame) -> DataFrame:
    """(source_id, origin_id, steps): what each source was converted from in the end, through chains of conversions; a
    reference that leads nowhere, or back, ends the chain. Pointers double, so long chains take few rounds."""
    from veriloom.session import cut

    once = sources.groupBy("source_id").agg(F.max("converted_from_source_id").alias("parent"))
    held = once.select(F.col("source_id").alias("parent"), F.lit(True).alias("there"))
    x = once.join(held, "parent", "left").withColumn("up", F.when(F.col("there") & (F.col("parent") != F.col("source_id")), F.col("parent")).otherwise(F.col("source_id")))
    x = cut(x.select("source_id", "up", (F.col("up") != F.col("source_id")).cast("int").alias("steps")))
    for _ in range(32):
        y = x.select(F.col("source_id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        x = cut(x.join(y, "up").select("source_id", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        if not x.filter("moved").limit(1).count():
            break
        x = x.drop("moved")
    return x.select("source_id", F.col("up").alias("origin_id"), "steps")


def resume_duplicates(files: DataFrame, done: DataFrame) -> DataFrame:
    """(path, source_id, reuse): files whose content was already worked on under another path take its result."""
    first = done.groupBy("source_id").agg(F.min("path").alias("reuse"))
    return files.join(first, "source_id", "left").select("path", "source_id", F.when(F.col("reuse") != F.col("path"), F.col("reuse")).alias("reuse"))
