"""Trace events: bundles, ids that events name, outcome and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of trace events.
KINDS = ("search", "inject", "write", "read", "outcome")


def ingest_traces(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, events with status): a trace's first event makes its parent; another scope's later events are denied."""
    good = F.col("trace_id").rlike("^[A-Za-z0-9_-]{1,128}$") & F.col("kind").isin(*KINDS)
    parents = events.where(good).groupBy("trace_id").agg(F.min_by("scope", F.struct("created_at", "event_id")).alias("scope"), F.min("created_at").alias("created_at"))
    joined = events.join(parents.select("trace_id", F.col("scope").alias("_scope")), "trace_id", "left")
    status = F.when(~F.coalesce(good, F.lit(False)), "invalid").when(F.col("scope") != F.col("_scope"), "scope_denied").otherwise("ok")
    return parents, joined.withColumn("status", status).drop("_scope")


def extract_memory_ids(events: DataFrame) -> DataFrame:
    """``events`` (payload: JSON, memory_ids?) with ids: what memory_ids, hits[].id, id, ops[].id and ops[].forgotten name, bare and prefixed."""
    j = F.from_json("payload", "id string, hits array<struct<id:string>>, ops array<struct<id:string,forgotten:string>>")
    rows = events.withColumn("_j", j)
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    named = F.concat(
        some(F.col("memory_ids")), some(F.transform("_j.hits", lambda x: x["id"])), F.array(F.col("_j.id")), some(F.transform("_j.ops", lambda x: x["id"])),
        some(F.transform("_j.ops", lambda x: x["forgotten"])),
    )
    bare = F.array_distinct(F.filter(F.transform(named, lambda x: F.regexp_replace(F.trim(x), "^memory:", "")), lambda x: x.isNotNull() & (x != "")))
    return rows.withColumn("ids", F.concat(bare, F.transform(bare, lambda x: F.concat(F.lit("memory:"), x)))).drop("_j")


def named_memories(events: DataFrame) -> DataFrame:
    """``events`` with a row for each memory_id that they name: in memory_ids or, where that is empty, in the payload."""
    if "memory_ids" not in events.columns:
        return events
    own = F.filter(F.transform("memory_ids", lambda x: F.regexp_replace(F.trim(x), "^memory:", "")), lambda x: x != "")
    rows = extract_memory_ids(events.withColumns({"_own": own, "memory_ids": F.lit(None).cast("array<string>")}))
    in_payload = F.filter("ids", lambda x: ~F.startswith(x, F.lit("memory:")))
    ids = F.when(F.size("_own") > 0, F.col("_own")).otherwise(in_payload)
    return rows.withColumn("memory_id", F.explode(F.array_distinct(ids))).drop("_own", "ids")


def filter_traces(parents: DataFrame, since: Column | None = None, until: Column | None = None, session_id: str | None = None, turn_id: str | None = None) -> DataFrame:
    """Parents (created_at, session_id?, turn_id?) within both times, of a session and of a turn; what isn't given allows all."""
    for value, test in (
        (since, lambda: F.col("created_at") >= since), (until, lambda: F.col("created_at") <= until),
        (session_id, lambda: F.col("session_id") == session_id), (turn_id, lambda: F.col("turn_id") == turn_id),
    ):
        if value is not None:
            parents = parents.where(test())
    return parents


def trace_parents(events: DataFrame) -> DataFrame:
    """(trace_id, created_at, and scope, session_id and turn_id where events have them) of the first event of each trace."""
    first = [F.min_by(c, F.struct("created_at", "event_id")).alias(c) for c in ("scope", "session_id", "turn_id") if c in events.columns]
    return events.groupBy("trace_id").agg(F.min("created_at").alias("created_at"), *first)


def traces_for_memory(
    events: DataFrame, memory_ids: DataFrame, limit: int = 32, since: Column | None = None, until: Column | None = None, session_id: str | None = None, turn_id: str | None = None
) -> DataFrame:
    """(memory_id, trace_id, kinds, outcome, note?, last_at, pos) of each memory's traces, newest first.

    kinds are those of the events that name the memory (see ``named_memories``), outcome and note the trace's
    latest for it; 1 to 128 traces a memory. The filters are those of ``filter_traces``, on the traces' parents.
    """
    limit = max(1, min(limit, 128))
    met = named_memories(events).join(memory_ids.select("memory_id").distinct(), "memory_id")
    if any(x is not None for x in (since, until, session_id, turn_id)):
        met = met.join(filter_traces(trace_parents(events), since, until, session_id, turn_id).select("trace_id"), "trace_id", "left_semi")
    told = F.when(F.col("outcome").isNotNull(), F.struct("created_at", "event_id"))
    notes = [F.max_by("note", told).alias("note")] if "note" in events.columns else []
    per = met.groupBy("memory_id", "trace_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("created_at").alias("last_at"), F.max_by("outcome", told).alias("outcome"), *notes)
    order = Window.partitionBy("memory_id").orderBy(F.desc("last_at"), "trace_id")
    return per.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def trace_bundles(events: DataFrame) -> DataFrame:
    """(trace_id, n, kinds in time order, first_scope)."""
    rows = events.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "event_id", "kind", "scope"))).alias("e"))
    return rows.select("trace_id", F.size("e").alias("n"), F.transform("e", lambda x: x["kind"]).alias("kinds"), F.element_at("e", 1)["scope"].alias("first_scope"))


def list_traces(parents: DataFrame, limit: int = 32, **filters) -> DataFrame:
    """Each scope's newest traces, 1 to 128, under the filters of ``filter_traces``."""
    order = Window.partitionBy("scope").orderBy(F.desc("created_at"), "trace_id")
    return filter_traces(parents, **filters).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= max(1, min(limit, 128)))


#: Outcomes of a trace.
OUTCOMES = ("helped", "harmed", "unknown", "skipped")


def outcome_stats(events: DataFrame) -> DataFrame:
    """(memory_id, evaluator if events have it, helped, harmed, unknown, skipped) counting the latest outcome of each trace."""
    by = ["memory_id", *["evaluator"] * ("evaluator" in events.columns)]
    told = events.where("outcome IS NOT NULL")
    last = told.groupBy("memory_id", "trace_id").agg(F.max_by(F.struct("outcome", *by[1:]), F.struct("created_at", "event_id")).alias("l")).select("memory_id", "l.*")
    return last.groupBy(*by).agg(*[F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES])


def usage_stats(events: DataFrame) -> DataFrame:
    """(memory_id, scanned, used) from search and inject events."""
    return events.groupBy("memory_id").agg(F.count_if(F.col("kind") == "search").alias("scanned"), F.count_if(F.col("kind") == "inject").alias("used"))


def hit_cards(hits: DataFrame, chars: int = 160) -> DataFrame:
    """``hits`` (query_id, rank1, id, text) as cards with rank0 and a preview."""
    from recollect.functions.text import preview

    return hits.select("query_id", (F.col("rank1") - 1).alias("rank0"), "id", preview(F.col("text"), chars).alias("preview"))


def usage_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(memory_id, start, searches, injects, outcomes) by tumbling windows; on a stream, rows later than ``late`` are dropped."""
    timed = events.withWatermark("created_at", late) if events.isStreaming else events
    kinds = {"searches": "search", "injects": "inject", "outcomes": "outcome"}
    counts = [F.count(F.when(F.col("kind") == kind, 1)).alias(name) for name, kind in kinds.items()]
    return timed.groupBy(F.window("created_at", width).alias("w"), "memory_id").agg(*counts).select("memory_id", F.col("w.start").alias("start"), *kinds)


def usage_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(memory_id, start, end, searches, injects, outcomes) by sessions: runs of a memory's events less than ``gap`` apart; end is the last event's time and the gap."""
    timed = events.withWatermark("created_at", late) if events.isStreaming else events
    kinds = {"searches": "search", "injects": "inject", "outcomes": "outcome"}
    counts = [F.count(F.when(F.col("kind") == kind, 1)).alias(name) for name, kind in kinds.items()]
    return timed.groupBy(F.session_window("created_at", gap).alias("w"), "memory_id").agg(*counts).select("memory_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *kinds)


def late_rows(events: DataFrame, arrivals: str = "batch_no", late: str = "1 hour") -> DataFrame:
    """(late, in_time): how many rows a stream with this watermark takes too late, for rows that tell in which trigger they came.

    A trigger's watermark is the latest time of the triggers before it, less ``late``.
    """
    per = events.groupBy(arrivals).agg(F.max("created_at").alias("most"))
    before = Window.orderBy(arrivals).rowsBetween(Window.unboundedPreceding, -1)  # a row a trigger
    marks = per.select(arrivals, (F.max("most").over(before) - F.expr(f"INTERVAL {late}")).alias("mark"))
    is_late = F.coalesce(F.col("created_at") < F.col("mark"), F.lit(False))
    return events.join(marks, arrivals).agg(F.count_if(is_late).alias("late"), F.count_if(~is_late).alias("in_time"))
