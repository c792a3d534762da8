"""Memory tables from the star schema and document tables, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("episodic", "semantic", "identity", "procedural", "uncertainty")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, embeddings: bool = False) -> DataFrame:
    """A memory for each document. With ``embeddings``, the vector of the same number where there is one."""
    docs = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    valid_from = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)")
    category = F.element_at(F.lit(list(CATEGORIES)), (n % 5 + 1).cast("int"))
    rows = docs.select(
        F.concat(F.lit("m"), n).alias("id"), n.alias("n"), F.concat_ws("/", F.lit("org"), "source", "lang").alias("scope"),
        category.alias("category"), "text", valid_from.alias("valid_from"), (n % 3 + 1).alias("version"),
    )
    rows = (
        rows.withColumn("valid_until", F.when(F.col("n") % 7 == 0, F.expr("valid_from + INTERVAL 30 DAYS")))
        .withColumn("known_at", F.expr("valid_from + make_dt_interval(0, CAST(n % 11 AS INT), 0, 0)"))
        .withColumn("sys_created", F.when(F.col("n") % 13 != 0, F.col("known_at")))
        .withColumn("sys_closed", F.col("valid_until"))
    )
    if embeddings:
        vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), "embedding")
        rows = rows.join(vectors, "n", "left")
    return rows


MEMORIES = """
    memories AS (
        SELECT 'm' || doc_id AS id, doc_id AS n, 'org/' || source || '/' || lang AS scope,
            list_extract(['episodic', 'semantic', 'identity', 'procedural', 'uncertainty'], doc_id % 5 + 1) AS category, text,
            TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS valid_from, doc_id % 3 + 1 AS version,
            CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + INTERVAL 30 DAYS END AS valid_until,
            TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_hours(doc_id % 11) AS known_at,
            CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_hours(doc_id % 11) END AS sys_created,
            CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + INTERVAL 30 DAYS END AS sys_closed
        FROM documents
    )"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version chains: a customer's orders in time, each superseding the one before."""
    from pyspark.sql import Window

    in_time = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = lambda c: F.concat(F.lit("o"), c)
    return read(spark, sf_dir, "orders").select(
        key(F.col("o_orderkey")).alias("id"), F.concat(F.lit("org/c"), "o_custkey").alias("scope"), F.col("o_orderstatus").alias("text"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"), key(F.lag("o_orderkey").over(in_time)).alias("supersedes"),
        key(F.lead("o_orderkey").over(in_time)).alias("superseded_by"),
        F.lead("o_orderdate").over(in_time).cast("timestamp_ntz").alias("valid_until"),
        F.row_number().over(in_time).cast("long").alias("version"),
    )


CHAINS = """
    chains AS (
        SELECT 'o' || o_orderkey AS id, 'org/c' || o_custkey AS scope, o_orderstatus AS text, o_orderdate AS valid_from,
            'o' || lag(o_orderkey) OVER w AS supersedes, 'o' || lead(o_orderkey) OVER w AS superseded_by,
            lead(o_orderdate) OVER w AS valid_until, row_number() OVER w AS version
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    )"""


def probes(spark: SparkSession, sf_dir: str, words: int = 3) -> DataFrame:
    """Queries from benchmark passages: their first words, with a scope, a match mode and a date each."""
    items = read(spark, sf_dir, "benchmark")
    n = F.col("item_id")
    return items.select(
        n.alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, words), " ").alias("query"),
        F.when(n % 2 == 0, F.lit("org")).otherwise(F.concat(F.lit("org/src"), n % 20)).alias("scope"), F.lit("prefix").alias("scope_match"),
        F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(CAST(item_id % 5 AS INT), 0, 0, 0)").alias("as_of"),
    )


PROBES = """
    probes AS (
        SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS query,
            CASE WHEN item_id % 2 = 0 THEN 'org' ELSE 'org/src' || (item_id % 20) END AS scope, 'prefix' AS scope_match,
            TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST(item_id % 5 AS INTEGER)) AS as_of
        FROM benchmark
    )"""


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events: a user's day is a trace; the kind and the memory come from the event."""
    kinds = {"view": "search", "click": "inject", "purchase": "outcome", "error": "outcome", "signup": "write"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
    return read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"),
        F.concat(F.lit("org/u"), F.col("user_id") % 10).alias("scope"), kind.alias("kind"),
        F.when(F.col("event_type") == "purchase", "helped").when(F.col("event_type") == "error", "harmed").alias("outcome"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("memory_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), "props",
    )


TRACES = """
    trace_events AS (
        SELECT event_id, 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, 'org/u' || (user_id % 10) AS scope,
            CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'inject' WHEN 'purchase' THEN 'outcome'
                WHEN 'error' THEN 'outcome' WHEN 'signup' THEN 'write' END AS kind,
            CASE event_type WHEN 'purchase' THEN 'helped' WHEN 'error' THEN 'harmed' END AS outcome,
            'm' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS memory_id, ts AS created_at, props
        FROM events
    )"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship edges: customers and suppliers in nations, nations in regions, orders and parts through lines."""
    def of(df: DataFrame, s: str, sk: str, p: str, o: str, ok: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(s), sk).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(o), ok).alias("object"),
        ).distinct()

    t = lambda name: read(spark, sf_dir, name)
    return (
        of(t("customer"), "c", "c_custkey", "depends_on", "n", "c_nationkey")
        .unionByName(of(t("supplier"), "s", "s_suppkey", "depends_on", "n", "s_nationkey"))
        .unionByName(of(t("nation"), "n", "n_nationkey", "applies_to", "r", "n_regionkey"))
        .unionByName(of(t("lineitem"), "p", "l_partkey", "contradicts", "s", "l_suppkey"))
    )


EDGES = """
    edges AS (
        SELECT DISTINCT 'c' || c_custkey AS subject, 'depends_on' AS predicate, 'n' || c_nationkey AS object FROM customer
        UNION ALL SELECT DISTINCT 's' || s_suppkey, 'depends_on', 'n' || s_nationkey FROM supplier
        UNION ALL SELECT DISTINCT 'n' || n_nationkey, 'applies_to', 'r' || n_regionkey FROM nation
        UNION ALL SELECT DISTINCT 'p' || l_partkey, 'contradicts', 's' || l_suppkey FROM lineitem
    )"""


def task_state_ops(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Compare-and-set writes: a user's events are writes of a slot, some with expected versions, some odd."""
    e = F.col("event_id")
    events = read(spark, sf_dir, "events") if events is None else events
    return events.select(
        F.concat(F.lit("org/u"), F.col("user_id") % 10).alias("scope"), F.concat(F.lit("s"), "user_id").alias("slot"), e.alias("seq"),
        F.when(e % 13 == 0, "[]").otherwise(F.col("props")).alias("body"), F.when(e % 3 == 0, e % 4).alias("expected_version"), (e % 7 == 0).alias("create_only"),
    )


_STATUS = "CASE WHEN NOT o.good THEN 'invalid_body' WHEN o.fresh AND f.version > 0 THEN 'exists' WHEN o.expected <> f.version THEN 'version_conflict' ELSE 'ok' END"
TASK_STATE = f"""
    WITH RECURSIVE ops AS (
        SELECT 'org/u' || (user_id % 10) AS scope, 's' || user_id AS slot, event_id AS seq, event_id % 13 <> 0 AND props LIKE '{{%' AS good,
            CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS expected, event_id % 7 = 0 AS fresh, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
        FROM events
    ), f AS (
        SELECT DISTINCT scope, slot, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS i FROM ops
        UNION ALL
        SELECT o.scope, o.slot, o.seq, {_STATUS}, f.version + CASE WHEN {_STATUS} = 'ok' THEN 1 ELSE 0 END, o.i
        FROM f JOIN ops o ON o.slot = f.slot AND o.i = f.i + 1
    )
    SELECT scope, slot, seq, status, version FROM f WHERE i > 0"""
