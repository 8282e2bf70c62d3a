"""Ingestion jobs as tables: file states, job rollups, legality of stage changes, latest stage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.ids import stable_id

# The stages in order, and states that are final.
STAGES = ["registered", "parsed", "normalized", "chunked", "embedded", "indexed", "validated", "published"]
FINAL = ["completed", "failed"]


def stage_rank(stage: Column) -> Column:
    """The place of a stage, from 1; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0))


def file_states(events: DataFrame) -> DataFrame:
    """(job_id, file_id, status, stage, n_events) from events (job_id, file_id, seq, stage, status).

    The furthest stage counts; the first final status freezes a file, and later events of it change nothing.
    """
    w = Window.partitionBy("job_id", "file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    live = events.withColumn("_over", F.coalesce(F.max(F.col("status").isin(*FINAL).cast("int")).over(w), F.lit(0))).filter("_over = 0")
    g = live.groupBy("job_id", "file_id").agg(F.max(stage_rank(F.col("stage"))).alias("r"), F.max(F.when(F.col("status").isin(*FINAL), F.col("status"))).alias("final"), F.count(F.lit(1)).alias("n_events"))
    return g.select("job_id", "file_id", F.coalesce("final", F.lit("running")).alias("status"), F.try_element_at(F.array(*map(F.lit, STAGES)), F.col("r").cast("int")).alias("stage"), F.when(F.col("final") == "completed", 100).otherwise(F.bround(100 * (F.coalesce("r", F.lit(0))) / len(STAGES)).cast("int")).alias("progress"), "n_events")


def illegal_changes(events: DataFrame) -> DataFrame:
    """Events that step back a stage, or come after a final status: (job_id, file_id, seq, problem)."""
    w = Window.partitionBy("job_id", "file_id").orderBy("seq")
    x = events.withColumns({"_r": stage_rank(F.col("stage")), "_before": F.max(stage_rank(F.col("stage"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_final": F.coalesce(F.max(F.col("status").isin(*FINAL)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    problem = F.when(F.col("_final"), "after_final").when(F.col("_r") < F.col("_before"), "backwards")
    return x.withColumn("problem", problem).filter("problem is not null").select("job_id", "file_id", "seq", "problem")


def job_states(files: DataFrame) -> DataFrame:
    """(job_id, status, progress, n_files, n_completed, n_failed): running while a file runs; then completed, failed, or
    partial if both occur. The progress is the mean, half-even."""
    g = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.bround(F.avg("progress")).cast("int").alias("progress"))
    status = F.when(F.col("n_completed") + F.col("n_failed") < F.col("n_files"), "running").when(F.col("n_failed") == 0, "completed").when(F.col("n_completed") == 0, "failed").otherwise("partial")
    return g.select("job_id", status.alias("status"), "progress", "n_files", "n_completed", "n_failed")


def idempotency_key(kb: Column, hashes: Column, config: Column) -> Column:
    """A key that doesn't depend on the order of the source hashes and does on the configuration."""
    return F.sha2(F.to_json(F.struct(kb.alias("config_kb"), config.alias("config"), F.array_sort(F.array_distinct(hashes)).alias("hashes"))), 256)


def latest_stages(records: DataFrame) -> DataFrame:
    """The last record of each (run_id, stage) by seq."""
    rest = [c for c in records.columns if c not in ("run_id", "stage")]
    return records.groupBy("run_id", "stage").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("run_id", "stage", "r.*")


def created(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(job_id, kb, idempotency_key, reused) of requests (kb, hashes, config): one job per key, whose id follows from
    knowledge base and key; a job that exists is used again."""
    x = requests.withColumn("idempotency_key", idempotency_key(F.col("kb"), F.col("hashes"), F.col("config"))).select("kb", "idempotency_key").distinct()
    x = x.withColumn("job_id", stable_id("job", F.col("kb"), F.col("idempotency_key")))
    return x.join(existing.select("job_id").distinct().withColumn("reused", F.lit(True)), "job_id", "left").select("job_id", "kb", "idempotency_key", F.coalesce("reused", F.lit(False)).alias("reused"))


# The order of the events of a streamed answer.
EVENT_ORDER = ["status", "delta", "citations", "usage", "completed", "error"]


def event_order_problems(events: DataFrame) -> DataFrame:
    """(answer_id, problem): streamed answers (answer_id, seq, event) whose events go back in order (backwards), that hold
    an unknown one (unknown), or that don't end, once, in completed or error (not_ended)."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, EVENT_ORDER)), F.col("event")), F.lit(0))
    w = Window.partitionBy("answer_id").orderBy("seq")
    x = events.withColumns({"_r": rank, "_before": F.lag(rank).over(w)})
    g = x.groupBy("answer_id").agg(F.bool_or(F.col("_r") < F.col("_before")).alias("back"), F.bool_or(F.col("_r").isNull()).alias("unknown"), F.max_by("event", "seq").alias("last"), F.count_if(F.col("event").isin("completed", "error")).alias("ends"))
    found = F.array_compact(F.array(F.when(F.col("back"), "backwards"), F.when(F.col("unknown"), "unknown"), F.when(~F.col("last").isin("completed", "error") | (F.col("ends") != 1), "not_ended")))
    return g.select("answer_id", F.explode(found).alias("problem"))
