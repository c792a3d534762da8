"""Trace events derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.jobs.registry import query
from recollect.operators import traces
from recollect.sources.derived import TASK_STATE, TRACES, read, task_state_ops, trace_events
from recollect.sources.shared import shared_path
from recollect.streaming import keyed, late
from recollect.streaming import traces as streams


@query(f"""
    WITH {TRACES}, e AS (SELECT event_id, trace_id, CASE WHEN event_id % 50 = 0 THEN 'org/x' ELSE scope END AS scope, CASE WHEN event_id % 70 = 0 THEN 'odd' ELSE kind END AS kind, created_at FROM trace_events),
    p AS (SELECT trace_id, arg_min(scope, (created_at, event_id)) AS own FROM e WHERE kind <> 'odd' GROUP BY trace_id)
    SELECT event_id, trace_id, CASE WHEN kind = 'odd' THEN 'invalid' WHEN scope <> own THEN 'scope_denied' ELSE 'ok' END AS status FROM e LEFT JOIN p USING (trace_id)
""")
def ingest_traces(spark, sf_dir):
    e = F.col("event_id")
    events = trace_events(spark, sf_dir).withColumns({"scope": F.when(e % 50 == 0, "org/x").otherwise(F.col("scope")), "kind": F.when(e % 70 == 0, "odd").otherwise(F.col("kind"))})
    return traces.ingest_traces(events)[1].select("event_id", "trace_id", "status")


@query(f"WITH {TRACES} SELECT event_id, 'h' || (event_id % 5) || ',' || memory_id || ',memory:h' || (event_id % 5) || ',memory:' || memory_id AS ids FROM trace_events WHERE memory_id IS NOT NULL")
def extract_memory_ids(spark, sf_dir):
    rows = trace_events(spark, sf_dir).select(
        "event_id", F.concat(F.lit('{"hits":[{"id":" h'), F.col("event_id") % 5, F.lit('"},{"id":""}],"ops":[{"id":"memory:'), "memory_id", F.lit('"}]}')).alias("payload"),
        F.lit(None).cast("array<string>").alias("memory_ids"),
    )
    return traces.extract_memory_ids(rows).select("event_id", F.array_join("ids", ",").alias("ids"))


@query(f"""
    WITH {TRACES}, p AS (SELECT memory_id, trace_id, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, max(created_at) AS last_at,
        arg_max(outcome, (created_at, event_id)) FILTER (WHERE outcome IS NOT NULL) AS outcome FROM trace_events GROUP BY memory_id, trace_id)
    SELECT memory_id, trace_id, kinds, outcome, row_number() OVER (PARTITION BY memory_id ORDER BY last_at DESC, trace_id) AS pos FROM p QUALIFY pos <= 32
""")
def traces_for_memory(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    out = traces.traces_for_memory(events, events.select("memory_id"))
    return out.select("memory_id", "trace_id", F.array_join("kinds", ",").alias("kinds"), "outcome", "pos")


@query(f"""
    WITH {TRACES} SELECT trace_id, count(*) AS n, string_agg(kind, ',' ORDER BY created_at, event_id) AS kinds, arg_min(scope, (created_at, event_id)) AS first_scope FROM trace_events GROUP BY trace_id
""")
def trace_bundles(spark, sf_dir):
    return traces.trace_bundles(trace_events(spark, sf_dir)).withColumn("kinds", F.array_join("kinds", ","))


_SINCE, _UNTIL = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


@query(f"""
    WITH {TRACES}, p AS (SELECT trace_id, arg_min(scope, (created_at, event_id)) AS scope, min(created_at) AS began FROM trace_events GROUP BY trace_id)
    SELECT scope, trace_id, row_number() OVER (PARTITION BY scope ORDER BY began DESC, trace_id) AS pos FROM p WHERE began BETWEEN TIMESTAMP '{_SINCE}' AND TIMESTAMP '{_UNTIL}' QUALIFY pos <= 64
""")
def list_traces(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    parents, _ = traces.ingest_traces(trace_events(spark, sf_dir))
    return traces.list_traces(parents, 64, since=at(_SINCE), until=at(_UNTIL)).select("scope", "trace_id", "pos")


_TOLD = """
    told AS (SELECT *, list_extract(['helped', 'harmed', 'unknown', 'skipped'], event_id % 4 + 1) AS said, CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'auto' END AS evaluator, 's' || event_id % 5 AS session_id,
        CASE WHEN event_id % 2 = 0 THEN [memory_id, 'h' || event_id % 5] ELSE ['p' || event_id % 7] END AS ids FROM trace_events)"""


def _told(spark, sf_dir):
    """Trace events with every outcome, evaluators, sessions, and ids in lists or in payloads."""
    e = F.col("event_id")
    return trace_events(spark, sf_dir).withColumns(
        {"said": F.element_at(F.lit(["helped", "harmed", "unknown", "skipped"]), (e % 4 + 1).cast("int")), "evaluator": F.when(e % 3 == 0, "user").when(e % 3 == 1, "auto"), "session_id": F.concat(F.lit("s"), e % 5),
         "memory_ids": F.when(e % 2 == 0, F.array("memory_id", F.concat(F.lit("memory:h"), e % 5))).otherwise(F.array().cast("array<string>")),
         "payload": F.concat(F.lit('{"hits":[{"id":"memory:p'), e % 7, F.lit('"}]}'))}
    )


@query(f"""
    WITH {TRACES}, {_TOLD}, l AS (SELECT memory_id, arg_max({{'o': said, 'e': evaluator}}, (created_at, event_id)) AS l FROM told WHERE kind = 'outcome' GROUP BY memory_id, trace_id)
    SELECT memory_id, l.e AS evaluator, count(*) FILTER (WHERE l.o = 'helped') AS helped, count(*) FILTER (WHERE l.o = 'harmed') AS harmed, count(*) FILTER (WHERE l.o = 'unknown') AS unknown, count(*) FILTER (WHERE l.o = 'skipped') AS skipped FROM l GROUP BY ALL
""")
def outcome_stats(spark, sf_dir):
    return traces.outcome_stats(_told(spark, sf_dir).withColumn("outcome", F.when(F.col("kind") == "outcome", F.col("said"))))


@query(f"""
    WITH {TRACES}, {_TOLD}, parents AS (SELECT trace_id FROM told GROUP BY trace_id HAVING min(created_at) BETWEEN TIMESTAMP '{_SINCE}' AND TIMESTAMP '{_UNTIL}' AND arg_min(session_id, (created_at, event_id)) = 's3'),
    n AS (SELECT unnest(list_distinct(list_filter(ids, lambda x: x IS NOT NULL))) AS memory_id, trace_id, kind, outcome, created_at, event_id FROM told SEMI JOIN parents USING (trace_id)),
    p AS (SELECT memory_id, trace_id, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, max(created_at) AS last_at, arg_max(outcome, (created_at, event_id)) FILTER (WHERE outcome IS NOT NULL) AS outcome FROM n GROUP BY memory_id, trace_id)
    SELECT memory_id, trace_id, kinds, outcome, row_number() OVER (PARTITION BY memory_id ORDER BY last_at DESC, trace_id) AS pos FROM p QUALIFY pos <= 32
""")
def traces_of_session(spark, sf_dir):
    """Traces of every named memory, of one session and between two times."""
    events = _told(spark, sf_dir)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    ids = traces.named_memories(events).select("memory_id")
    out = traces.traces_for_memory(events, ids, since=at(_SINCE), until=at(_UNTIL), session_id="s3")
    return out.select("memory_id", "trace_id", F.array_join("kinds", ",").alias("kinds"), "outcome", "pos")


@query(f"""
    WITH {TRACES}, g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM trace_events WINDOW w AS (PARTITION BY memory_id ORDER BY created_at)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY memory_id ORDER BY created_at) AS no FROM g)
    SELECT memory_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(created_at) + INTERVAL 12 HOURS, '%Y-%m-%d %H:%M:%S') AS "end", count(*) FILTER (WHERE kind = 'search') AS searches, count(*) FILTER (WHERE kind = 'inject') AS injects,
        count(*) FILTER (WHERE kind = 'outcome') AS outcomes FROM s GROUP BY memory_id, no
""")
def usage_sessions(spark, sf_dir):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return traces.usage_sessions(trace_events(spark, sf_dir), "12 hours").select("memory_id", at("start"), at("end"), "searches", "injects", "outcomes")


@query(f"""
    WITH {TRACES}, b AS (SELECT *, event_id // 1000 AS batch_no FROM trace_events), p AS (SELECT batch_no, max(created_at) AS most FROM b GROUP BY batch_no),
    m AS (SELECT batch_no, max(most) OVER (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM p)
    SELECT count(*) FILTER (WHERE coalesce(created_at < mark, false)) AS late, count(*) FILTER (WHERE NOT coalesce(created_at < mark, false)) AS in_time FROM b JOIN m USING (batch_no)
""")
def late_rows(spark, sf_dir):
    events = trace_events(spark, sf_dir).withColumn("batch_no", F.floor(F.col("event_id") / 1000))
    return traces.late_rows(events)


@query(f"WITH {TRACES} SELECT memory_id, count(*) FILTER (WHERE kind = 'search') AS scanned, count(*) FILTER (WHERE kind = 'inject') AS used FROM trace_events GROUP BY memory_id")
def usage_stats(spark, sf_dir):
    return traces.usage_stats(trace_events(spark, sf_dir))


@query("SELECT item_id % 16 AS query_id, CAST(row_number() OVER (PARTITION BY item_id % 16 ORDER BY item_id) - 1 AS INTEGER) AS rank0, 'b' || item_id AS id, CASE WHEN length(text) > 160 THEN left(text, 160) || '…' ELSE text END AS preview FROM benchmark")
def hit_cards(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "benchmark").select((F.col("item_id") % 16).alias("query_id"), F.row_number().over(Window.partitionBy(F.col("item_id") % 16).orderBy("item_id")).alias("rank1"), F.concat(F.lit("b"), "item_id").alias("id"), "text")
    return traces.hit_cards(rows)


@query("""
    SELECT 'm' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS memory_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'view') AS searches,
        count(*) FILTER (WHERE event_type = 'click') AS injects, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS outcomes FROM events GROUP BY ALL
""")
def usage_windows(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    return traces.usage_windows(events).select("memory_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "searches", "injects", "outcomes")


def _stream(spark, sf_dir):
    """The events table as a stream of its files, with the columns of trace events."""
    raw = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    return raw.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id")).alias("trace_id"), F.concat(F.lit("org/u"), F.col("event_id") % 3).alias("scope"),
        F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "inject").when(F.col("event_type") == "signup", "write").otherwise("outcome").alias("kind"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("memory_id"), F.col("ts").cast("timestamp").alias("created_at"),
    )


@query("""
    WITH e AS (SELECT event_id, 'u' || user_id AS trace_id, 'org/u' || (event_id % 3) AS scope, ts FROM events)
    SELECT event_id, trace_id, CASE WHEN scope = first_value(scope) OVER (PARTITION BY trace_id ORDER BY ts, event_id) THEN 'ok' ELSE 'scope_denied' END AS status FROM e
""")
def ingest_trace_stream(spark, sf_dir):
    return streams.run_available(streams.ingest_stream(_stream(spark, sf_dir)))


@query(TASK_STATE)
def task_state_stream(spark, sf_dir):
    raw = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    return streams.run_available(streams.task_state_stream(task_state_ops(spark, sf_dir, raw)))


@query("""
    SELECT 'm' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS memory_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) FILTER (WHERE event_type = 'view') AS searches,
        count(*) FILTER (WHERE event_type = 'click') AS injects, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS outcomes FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY ALL
""")
def usage_windows_stream(spark, sf_dir):
    """Windows that the watermark has closed; the last ones stay open until later events come."""
    out = streams.run_available(traces.usage_windows(_stream(spark, sf_dir)))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


TRIGGERS = 4


@query(f"""
    WITH e AS (SELECT event_id % {TRIGGERS} AS trigger, ts FROM events), p AS (SELECT trigger, max(ts) AS most FROM e GROUP BY trigger),
    m AS (SELECT trigger, date_trunc('millisecond', max(most) OVER (ORDER BY trigger ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) - INTERVAL 10 DAYS AS mark FROM p)
    SELECT trigger, count(*) AS arrived, count(*) FILTER (WHERE coalesce(ts <= mark, false)) AS dropped FROM e JOIN m USING (trigger) GROUP BY trigger
""")
def late_stream_counts(spark, sf_dir):
    """Rows that a stream of four triggers drops behind its watermark, as its listener counts them."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    stream = streams.in_turn(rows, F.col("event_id") % TRIGGERS, TRIGGERS)
    _, counted = late.run_counted(late.in_time(stream, "10 days").select("event_id"))
    return late.counts(spark, counted).where("arrived > 0").select("trigger", "arrived", "dropped")


def _in_order(spark, sf_dir, rows):
    """``rows`` with event_id as a stream of three triggers, in order of event_id."""
    (most,) = read(spark, sf_dir, "events").agg(F.max("event_id")).first()
    return streams.in_turn(rows, F.least(F.floor(F.col("event_id") * 3 / F.lit(max(most or 0, 1))), F.lit(2)), 3)


@query("""
    WITH e AS (SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'bad id ' ELSE 'u' END || user_id AS trace_id, 'org/u' || (event_id % 3) AS scope, event_type <> 'signup' AND user_id % 13 <> 0 AS good FROM events),
    f AS (SELECT trace_id, arg_min(scope, event_id) AS own FROM e WHERE good GROUP BY trace_id)
    SELECT event_id, trace_id, CASE WHEN NOT good THEN 'invalid' WHEN scope = own THEN 'ok' ELSE 'scope_denied' END AS status FROM e LEFT JOIN f USING (trace_id)
""")
def ingest_keyed_stream(spark, sf_dir):
    """Events with bad ids and kinds over three triggers; a trace keeps the scope that an earlier trigger gave it."""
    user, at = F.col("user_id"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(event_id AS DOUBLE))")
    events = read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.when(user % 13 == 0, "bad id ").otherwise("u"), user).alias("trace_id"), F.concat(F.lit("org/u"), F.col("event_id") % 3).alias("scope"),
        F.when(F.col("event_type") == "signup", "odd").otherwise("search").alias("kind"), at.alias("created_at"),
    )
    with keyed.rocksdb(spark):
        out = streams.run_available(keyed.keyed_ingest(_in_order(spark, sf_dir, events)))
    return out.select("event_id", "trace_id", "status")


@query(TASK_STATE)
def task_state_keyed_stream(spark, sf_dir):
    """The batch's writes over three triggers, whose slots' versions are keyed state."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(event_id AS DOUBLE))")
    rows = task_state_ops(spark, sf_dir).withColumn("event_id", F.col("seq"))
    ops = _in_order(spark, sf_dir, rows.withColumn("created_at", at))
    with keyed.rocksdb(spark):
        return streams.run_available(keyed.keyed_task_state(ops))


@query(f"WITH {TRACES} SELECT event_id, trace_id, scope, kind, memory_id, md5(props) AS payload FROM trace_events")
def trace_stream(spark, sf_dir):
    """Trace events that arrive in a folder, as a stream reads them."""
    path = shared_path(spark, "events")
    rows = trace_events(spark, sf_dir).select("event_id", "trace_id", "scope", "kind", "memory_id", F.col("created_at").cast("timestamp").alias("created_at"), F.col("props").alias("payload"))
    rows.write.parquet(path)
    return streams.run_available(streams.trace_stream(spark, path)).select("event_id", "trace_id", "scope", "kind", "memory_id", F.md5("payload").alias("payload"))
