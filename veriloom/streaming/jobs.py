"""Streams: job states kept per file, idempotent intake, a resumable index build and the audit log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriloom.operators.jobs import FINAL, STAGES


def file_state_stream(events: DataFrame) -> DataFrame:
    """(job_id, file_id, status, stage) after each trigger, for the files that had events (job_id, file_id, seq, stage,
    status). Stages only move forward; a final status freezes a file. Rows within a trigger apply by seq."""
    rank = {s: i for i, s in enumerate(STAGES)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, status = state.get if state.exists else (-1, "running")
        rows = pd.concat(list(batches)).sort_values("seq")
        for s, t in zip(rows["stage"], rows["status"]):
            if status in FINAL:
                break
            stage = max(stage, rank.get(s, -1))
            status = t if t in FINAL else status
        state.update((stage, status))
        yield pd.DataFrame({"job_id": [key[0]], "file_id": [key[1]], "status": [status], "stage": [STAGES[stage] if stage >= 0 else None]})

    out = "job_id string, file_id string, status string, stage string"
    return events.groupBy("job_id", "file_id").applyInPandasWithState(step, out, "stage int, status string", "update", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: redelivered rows drop out."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, kind, n) per tumbling window; works on streams and tables. Our extension."""
    x = events.withColumn(at, F.col(at).cast("timestamp"))
    if x.isStreaming:
        x = x.withWatermark(at, late)
    return x.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def build_index(chunks: DataFrame, to: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """Index all chunks of a stream that aren't there yet: each trigger writes its own folder, so a run that broke off
    goes on where it stopped and writes a trigger again in place."""

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def audit_stream(events: DataFrame, to: str, checkpoint: str):
    """Append events (trace_id, event_type, at, payload) to files by date, exactly once."""
    rows = events.withColumn("event_date", F.to_date("at"))
    return rows.writeStream.format("parquet").partitionBy("event_date").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
