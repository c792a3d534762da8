"""Streams with keyed state over several triggers, restarts and expiry, and counts of late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import revise, traces
from recollect.streaming import keyed, late
from recollect.streaming import traces as streams

DAY = datetime(2024, 1, 1)
EVENT = "event_id long, trace_id string, scope string, kind string, created_at timestamp"
OP = "scope string, slot string, seq long, body string, expected_version long, create_only boolean, created_at timestamp"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of keyed state is a worker to start in each trigger."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def minute(n):
    return DAY + timedelta(minutes=n)


def run(stream, path):
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_late_rows_are_those_of_the_batch(spark):
    rows = [(i, i // 40, minute(i // 40 * 100 + i * 37 % 400)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, trigger long, created_at timestamp")
    stream = streams.in_turn(df, F.col("trigger"), 5)
    kept, counted = late.run_counted(late.in_time(stream, "90 minutes").select("event_id"))
    want = {r.trigger: (r.arrived, r.dropped) for r in late.late_by_trigger(df, "90 minutes").collect()}
    got = {r.trigger: (r.arrived, r.dropped) for r in late.counts(spark, counted).where("arrived > 0").collect()}
    assert got == want and counted.dropped == sum(d for _, d in want.values()) > 0
    assert kept.count() == 200 - counted.dropped and counted.arrived == 200
    # What a windowed count gets afterwards is whole: nothing more is dropped.
    stream = streams.in_turn(df.withColumns({"memory_id": F.lit("m"), "kind": F.lit("search")}), F.col("trigger"), 5)
    windows, again = late.run_counted(late.in_time(stream, "90 minutes").groupBy(F.window("created_at", "1 hour")).agg(F.count("*").alias("n")).select("n"))
    assert again.dropped == counted.dropped
    closed = windows.agg(F.sum("n")).first()[0]
    assert 0 < closed <= 200 - counted.dropped


def test_slots_over_triggers_and_a_restart(spark, tmp_path):
    ops = [("o", f"s{i % 4}", i, "[]" if i % 9 == 4 else "{}", i % 5 if i % 3 == 0 else None, i % 7 == 0, minute(i)) for i in range(60)]
    want = sorted(map(tuple, revise.fold_task_state(spark.createDataFrame(ops, OP)).collect()))
    with keyed.rocksdb(spark):
        for low in (0, 20, 40):  # each run but the first is a restart; each takes two triggers
            put(spark, ops[low : low + 10], OP, tmp_path / "in")
            put(spark, ops[low + 10 : low + 20], OP, tmp_path / "in")
            stream = spark.readStream.schema(OP).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            got = run(keyed.keyed_task_state(stream), tmp_path)
    assert sorted(map(tuple, got.collect())) == want


def test_idle_slots_expire_and_seed_the_next_run(spark, tmp_path):
    with keyed.rocksdb(spark):
        first = [("o", "a", 1, "{}", None, False, minute(0)), ("o", "b", 2, "{}", None, False, minute(0))]
        later = [("o", "b", 3, "{}", 1, False, minute(200)), ("o", "b", 4, "{}", 2, False, minute(600)), ("o", "b", 5, "{}", 3, False, minute(601)), ("o", "a", 6, "{}", None, True, minute(602))]
        for rows in (first, *([row] for row in later)):
            put(spark, rows, OP, tmp_path / "in")
        stream = spark.readStream.schema(OP).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = run(keyed.keyed_task_state(stream, "10 minutes", timedelta(hours=5)), tmp_path)
        rows = {(r.slot, r.seq, r.status, r.version) for r in got.collect()}
        # a's timer is at minute 300, and b's fourth write comes under a watermark of minute 590.
        assert ("a", None, "expired", 1) in rows and ("a", 6, "ok", 1) in rows
        assert {("a", 1, "ok", 1), ("b", 2, "ok", 1), ("b", 3, "ok", 2), ("b", 4, "ok", 3), ("b", 5, "ok", 4)} <= rows
        put(spark, [("o", "a", 7, "{}", 1, False, minute(0)), ("o", "c", 8, "{}", None, False, minute(0))], OP, tmp_path / "next")
        known = got.where("slot = 'a' AND status = 'expired'").select("scope", "slot", "version", F.lit(minute(0)).cast("timestamp").alias("created_at"))
        seeded = run(keyed.keyed_task_state(spark.readStream.schema(OP).parquet(str(tmp_path / "next")), versions=known), tmp_path / "second")
        assert {(r.slot, r.seq, r.status, r.version) for r in seeded.where("seq IS NOT NULL").collect()} == {("a", 7, "ok", 2), ("c", 8, "ok", 1)}


@pytest.mark.parametrize("frames", [1, 10_000])
def test_traces_are_checked_as_in_a_batch(spark, tmp_path, frames):
    kinds = ["search", "odd", "write", None]
    rows = [(i, ["t1", "t 2", "t3", "", None][i % 5], ["a", "b", None][i % 3], kinds[i % 4], minute(i)) for i in range(48)]
    rows.append(rows[7])  # once more
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, frames)
    try:
        with keyed.rocksdb(spark):
            put(spark, rows[:20], EVENT, tmp_path / "in")
            put(spark, rows[20:], EVENT, tmp_path / "in")
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            got = {r.event_id: r.status for r in run(keyed.keyed_ingest(stream), tmp_path).collect()}
    finally:
        spark.conf.unset(size)
    assert len(got) == 48
    batch = traces.ingest_traces(spark.createDataFrame(rows[:-1], EVENT).where("scope IS NOT NULL"))[1]
    want = {r.event_id: r.status for r in batch.collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[r[0]] == ("scope_denied" if r[1] in ("t1", "t3") and r[3] in ("search", "write") else "invalid") for r in rows if r[2] is None)
