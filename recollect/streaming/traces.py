"""Trace events and task state as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.sources.shared import shared_path

EVENT = "event_id long, trace_id string, scope string, kind string, memory_id string, created_at timestamp, payload string"
STATE_OP = "scope string, slot string, seq long, body string, expected_version long, create_only boolean"


def trace_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Trace events as they arrive in a folder of Parquet files."""
    reader = spark.readStream.schema(EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, with its status: a trace belongs to the scope of its first event; others' events are denied.

    Repeats within the watermark are dropped; a trace's scope is kept as state. Of one trigger's events the
    first by (created_at, event_id) counts, in however many frames they come; only ids, times and scopes of
    a trace's events of one trigger are held. Without a scope an event is denied, and opens no trace.
    """
    once = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"]).select("trace_id", "event_id", "scope", "created_at")

    def own(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scope = state.get[0] if state.exists else None
        frame = pd.concat(frames)
        opening = frame.dropna(subset=["scope"])
        if scope is None and len(opening):
            scope = opening.sort_values(["created_at", "event_id"])["scope"].iloc[0]
            state.update((scope,))
        status = frame["scope"].eq(scope).map({True: "ok", False: "scope_denied"})
        yield pd.DataFrame({"event_id": frame["event_id"], "trace_id": key[0], "status": status})

    return once.groupBy("trace_id").applyInPandasWithState(own, "event_id long, trace_id string, status string", "scope string", "append", GroupStateTimeout.NoTimeout)


def task_state_stream(ops: DataFrame) -> DataFrame:
    """(scope, slot, seq, status, version) of compare-and-set writes as they arrive; a slot's version is state.

    A slot's writes of one trigger are taken in order of seq, in however many frames they come; of each only
    what decides is held, not the body. Earlier triggers come first.
    """
    body = F.coalesce("body", F.lit(""))
    ops = ops.select("scope", "slot", "seq", "expected_version", "create_only", (F.trim(body).startswith("{") & (F.octet_length(body) <= 8192)).alias("good"))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version = state.get[0] if state.exists else 0
        out = []
        for op in pd.concat(frames).sort_values("seq").itertuples(index=False):
            if not op.good:
                status = "invalid_body"
            elif op.create_only is True and version > 0:
                status = "exists"
            elif not pd.isna(op.expected_version) and op.expected_version != version:
                status = "version_conflict"
            else:
                status, version = "ok", version + 1
            out.append((*key, op.seq, status, version))
        state.update((version,))
        yield pd.DataFrame(out, columns=["scope", "slot", "seq", "status", "version"])

    return ops.groupBy("scope", "slot").applyInPandasWithState(
        fold, "scope string, slot string, seq long, status string, version long", "version long", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame) -> DataFrame:
    """Drives a stream over what is there now, into a table in the shared folder, and reads that table."""
    spark = stream.sparkSession
    at = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def in_turn(rows: DataFrame, trigger: Column, triggers: int) -> DataFrame:
    """A stream that brings the rows of trigger 0, 1, ... in that order, from a folder of the shared store with a file each."""
    spark = rows.sparkSession
    at = shared_path(spark, "in-turn")
    for k in range(triggers):
        rows.where(trigger == k).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
