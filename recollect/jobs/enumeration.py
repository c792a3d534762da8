"""Lenses, scopes, enumeration and validation over the derived memory table."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.scopes import normalize_scope, scope_match, scope_reason
from recollect.jobs.registry import query
from recollect.operators import lenses, manifest, pages, validation
from recollect.sources.derived import MEMORIES, PROBES, memories, probes, read

AT = "2024-02-01 12:00:00"


def now():
    return F.lit(AT).cast("timestamp_ntz")
SCOPES = ("org/src0/en", " org/src1 ", "org//x", "/org", "org/a b", "", "org/ü", "a" * 513)


@query(f"WITH {MEMORIES} SELECT id FROM memories WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AT}')")
def as_of(spark, sf_dir):
    return lenses.as_of(memories(spark, sf_dir), now()).select("id")


@query(f"WITH {MEMORIES} SELECT id FROM memories WHERE known_at <= TIMESTAMP '{AT}'")
def known_as_of(spark, sf_dir):
    return lenses.known_as_of(memories(spark, sf_dir), now()).select("id")


@query(
    f"WITH {MEMORIES} SELECT id FROM memories WHERE coalesce(sys_created, known_at) <= TIMESTAMP '{AT}' "
    f"AND (sys_closed IS NULL OR sys_closed > TIMESTAMP '{AT}')"
)
def sys_as_of(spark, sf_dir):
    return lenses.sys_as_of(memories(spark, sf_dir), now()).select("id")


@query(f"WITH {MEMORIES} SELECT category, count(*) AS n FROM memories WHERE category IN ('semantic', 'identity') GROUP BY category")
def categories(spark, sf_dir):
    return lenses.in_categories(memories(spark, sf_dir), ["semantic", "identity"]).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""
    WITH {MEMORIES}, s AS (SELECT DISTINCT 'org/src' || (n_nationkey % 20) AS scope FROM nation)
    SELECT s.scope, count(*) FILTER (WHERE m.scope = s.scope) AS exact, count(*) AS prefix
    FROM s JOIN memories m ON m.scope = s.scope OR starts_with(m.scope, s.scope || '/') GROUP BY s.scope
""")
def scope_prefix_join(spark, sf_dir):
    rows = memories(spark, sf_dir)
    scopes = read(spark, sf_dir, "nation").select(F.concat(F.lit("org/src"), F.col("n_nationkey") % 20).alias("scope"))
    met = lenses.scope_prefix_join(rows, scopes).join(rows.select("id", "scope"), "id")
    exact = scope_match(F.col("scope"), F.col("asked"), F.lit("exact"))
    return met.groupBy(F.col("asked").alias("scope")).agg(F.count_if(exact).alias("exact"), F.count("*").alias("prefix"))


_SCOPE_ROWS = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, '{s}' AS scope" for i, s in enumerate(SCOPES))


@query(f"""
    WITH s AS ({_SCOPE_ROWS}), t AS (
        SELECT source AS raw, trim(source) AS s FROM (SELECT DISTINCT 'org/' || source || '/' || lang AS source FROM documents
        UNION ALL SELECT scope FROM s)
    ) SELECT raw, s AS scope, CASE WHEN s = '' THEN 'empty' WHEN strlen(s) > 512 THEN 'too_long' WHEN regexp_matches(s, '\\s') THEN 'white_space'
        WHEN contains(s, '//') OR starts_with(s, '/') OR ends_with(s, '/') THEN 'empty_segment'
        WHEN NOT regexp_full_match(s, '[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*') THEN 'bad_character' END AS reason FROM t
""")
def valid_scope(spark, sf_dir):
    known = memories(spark, sf_dir).select(F.col("scope").alias("raw")).distinct()
    rows = known.unionByName(spark.createDataFrame([(s,) for s in SCOPES], "raw string"))
    return rows.select("raw", normalize_scope(F.col("raw")).alias("scope"), scope_reason(F.col("raw")).alias("reason"))


@query(f"""
    WITH {MEMORIES}, {PROBES}
    SELECT query_id, id FROM probes p JOIN memories m ON (m.scope = p.scope OR (p.scope_match = 'prefix' AND starts_with(m.scope, p.scope || '/')))
        AND valid_from <= as_of AND (valid_until IS NULL OR valid_until > as_of)
""")
def as_of_join(spark, sf_dir):
    return lenses.as_of_join(probes(spark, sf_dir), memories(spark, sf_dir)).select("query_id", "id")


@query(f"""
    WITH {MEMORIES}, r AS (SELECT event_id AS request_id, 'm' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS id,
        'org/src' || (event_id % 20) || '/en' AS scope FROM events)
    SELECT request_id, m.id, CASE WHEN m.scope = r.scope THEN 'ok' ELSE 'scope_denied' END AS status, version FROM r JOIN memories m ON m.id = r.id
""")
def read_by_ids(spark, sf_dir):
    requests = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("memory:m"), F.get_json_object("props", "$.k")).alias("id"),
        F.concat(F.lit("org/src"), F.col("event_id") % 20, F.lit("/en")).alias("scope"),
    )
    return lenses.read_by_ids(memories(spark, sf_dir), requests)


@query(f"""
    WITH {MEMORIES}, page AS (SELECT * FROM memories WHERE starts_with(scope, 'org/src0/') ORDER BY valid_from DESC, id DESC LIMIT 50),
    c AS (SELECT valid_from, id FROM page ORDER BY valid_from, id LIMIT 1)
    SELECT 1 AS page, id FROM page UNION ALL SELECT 2, id FROM (
        SELECT m.id FROM memories m, c WHERE starts_with(scope, 'org/src0/') AND (m.valid_from < c.valid_from OR (m.valid_from = c.valid_from AND m.id < c.id))
        ORDER BY m.valid_from DESC, m.id DESC LIMIT 50)
""")
def list_memories(spark, sf_dir):
    rows = memories(spark, sf_dir).where(F.col("scope").startswith("org/src0/"))
    first, after = lenses.list_memories(rows, 50)
    out = first.select(F.lit(1).alias("page"), "id")
    cursor = after.first()
    if cursor is not None:
        second, _ = lenses.list_memories(rows, 50, (cursor.valid_from, cursor.id))
        out = out.unionByName(second.select(F.lit(2).alias("page"), "id"))
    return out


@query(f"WITH {MEMORIES} SELECT count(*) AS n FROM memories WHERE starts_with(scope, 'org/src0/')")
def count_memories(spark, sf_dir):
    return lenses.count_memories(memories(spark, sf_dir).where(F.col("scope").startswith("org/src0/")))


@query(f"""
    WITH {MEMORIES}, r AS (SELECT n AS request_id, list_extract(['org', 'org/' || split_part(scope, '/', 2), scope], n % 3 + 1) AS scope, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 5 = 0 THEN 600 ELSE n % 7 + 1 END AS most,
        CASE WHEN n % 4 > 0 THEN valid_from END AS after_from, CASE WHEN n % 4 > 0 THEN id || CASE WHEN n % 2 = 0 THEN '' ELSE '!' END END AS after_id FROM memories WHERE n % 4 < 3),
    m AS (SELECT r.*, least(coalesce(most, 64), 512) AS size, m.id, row_number() OVER (PARTITION BY request_id ORDER BY m.valid_from DESC, m.id DESC) AS pos, count(*) OVER (PARTITION BY request_id) AS n_left
        FROM r JOIN memories m ON (m.scope = r.scope OR starts_with(m.scope, r.scope || '/')) AND (after_id IS NULL OR m.valid_from < after_from OR (m.valid_from = after_from AND m.id < after_id)))
    SELECT request_id, pos, id, n_left > size AS more FROM m WHERE pos <= size
""")
def list_pages(spark, sf_dir):
    """A page for each of three quarters of the memories, of scopes at all levels, from cursors of rows that are there or aren't."""
    n, rows = F.col("n"), memories(spark, sf_dir)
    scope = F.element_at(F.array(F.lit("org"), F.concat(F.lit("org/"), F.element_at(F.split("scope", "/"), 2)), F.col("scope")), (n % 3 + 1).cast("int"))
    asked = rows.where(n % 4 < 3).select(
        n.alias("request_id"), scope.alias("scope"), F.when(n % 11 == 0, None).when(n % 5 == 0, 600).otherwise(n % 7 + 1).alias("limit"),
        F.when(n % 4 > 0, F.col("valid_from")).alias("after_from"), F.when(n % 4 > 0, F.concat("id", F.when(n % 2 == 0, "").otherwise("!"))).alias("after_id"),
    )
    return pages.pages(rows, asked)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf_dir):
    return lenses.table_counts({t: read(spark, sf_dir, t) for t in _TABLES})


_CHANGED = {"documents": "changed", "orders": "rows_lost", "labels": "rows_added"}


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS stored_n, count(*) + {({'rows_lost': -1, 'rows_added': 1}).get(_CHANGED.get(t), 0)} AS found_n, '{_CHANGED.get(t, 'ok')}' AS status FROM {t}" for t in _TABLES
))
def compare_manifests(spark, sf_dir):
    """All tables against copies of which one has a changed row, one a row less and one a row twice."""
    stored = {t: read(spark, sf_dir, t) for t in _TABLES}
    least = lambda t, c: stored[t].agg(F.min(c)).first()[0]
    found = dict(stored)
    found["documents"] = stored["documents"].withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") == least("documents", "doc_id"), 1).otherwise(0))
    found["orders"] = stored["orders"].where(F.col("o_orderkey") != least("orders", "o_orderkey"))
    found["labels"] = stored["labels"].unionByName(stored["labels"].where(F.col("doc_id") == least("labels", "doc_id")))
    return manifest.compare_manifests(manifest.manifest(stored), manifest.manifest(found))


@query("""
    WITH p AS (
        SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'org//x' ELSE 'org/' || source END AS scope, CASE WHEN doc_id % 4 = 0 THEN 'trace' ELSE 'semantic' END AS category,
            CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE text END AS text, doc_id / 500.0 - 0.1 AS confidence, CASE WHEN doc_id % 23 = 0 THEN ' ' WHEN doc_id % 2 = 0 THEN source END AS key,
            doc_id % 29 = 0 AS reversed FROM documents)
    SELECT doc_id, CASE WHEN scope = 'org//x' THEN 'bad_scope' WHEN strlen(text) > 8192 THEN 'text_too_large'
        WHEN category <> 'trace' AND trim(coalesce(text, '')) = '' THEN 'blank_text' WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range'
        WHEN (SELECT count(*) FROM embeddings e WHERE e.vec_id = p.doc_id AND len(e.embedding) <> 64) > 0 THEN 'embedding_dimension'
        WHEN trim(key) = '' THEN 'bad_key' WHEN reversed THEN 'interval_reversed' END AS reason FROM p
""")
def validate_puts(spark, sf_dir):
    n = F.col("doc_id")
    puts = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(n % 17 == 0, "org//x").otherwise(F.concat(F.lit("org/"), "source")).alias("scope"),
        F.when(n % 4 == 0, "trace").otherwise("semantic").alias("category"), F.when(n % 19 == 0, " ").otherwise(F.col("text")).alias("text"),
        F.lit(None).cast("string").alias("attrs"), (n / 500.0 - 0.1).alias("confidence"), F.when(n % 23 == 0, " ").when(n % 2 == 0, F.col("source")).alias("key"),
        F.lit(AT).cast("timestamp_ntz").alias("valid_from"), F.when(n % 29 == 0, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).alias("valid_until"),
    )
    puts = puts.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return validation.validate_puts(puts).select("doc_id", "reason")


@query("""
    WITH o AS (SELECT conv_id AS batch_id, turn AS idx, CASE turn % 4 WHEN 0 THEN 'put' WHEN 1 THEN 'forget' WHEN 2 THEN 'supersede' ELSE 'noop' END AS op,
        CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'org/other' ELSE 'org/c' END AS scope, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN ' ' ELSE text END AS text,
        CASE WHEN conv_id % 11 = 0 THEN '' ELSE 'm' || turn END AS id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 1 END AS expected_version FROM conversations),
    c AS (SELECT *, CASE WHEN op <> 'noop' AND scope <> 'org/c' THEN 'foreign_scope' WHEN op IN ('put', 'supersede') AND trim(coalesce(text, '')) = '' THEN 'blank_text'
        WHEN op IN ('supersede', 'forget') AND trim(id) = '' THEN 'blank_id' WHEN op = 'forget' AND expected_version IS NULL THEN 'version_required' END AS reason FROM o)
    SELECT batch_id, idx, reason, max(reason) OVER (PARTITION BY batch_id) IS NULL AS batch_ok FROM c
""")
def preflight_ops(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    ops = read(spark, sf_dir, "conversations").select(
        c.alias("batch_id"), t.alias("idx"), F.when(t % 4 == 0, "put").when(t % 4 == 1, "forget").when(t % 4 == 2, "supersede").otherwise("noop").alias("op"),
        F.when((c % 7 == 0) & (t == 2), "org/other").otherwise("org/c").alias("scope"), F.lit("org/c").alias("active_scope"),
        F.when((c % 5 == 0) & (t == 0), " ").otherwise(F.col("text")).alias("text"), F.when(c % 11 == 0, "").otherwise(F.concat(F.lit("m"), t)).alias("id"),
        F.when(c % 3 != 0, F.lit(1)).alias("expected_version"),
    )
    return validation.preflight_ops(ops).select("batch_id", "idx", "reason", "batch_ok")


@query("""
    WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN left(text, turn + 3) ELSE text END AS text, turn = 3 AS force FROM conversations)
    SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN NOT force AND length(trim(text)) < 12 THEN 'short'
        WHEN NOT force AND len(regexp_split_to_array(trim(text), '\\s+')) <= 2 AND strlen(trim(text)) < 16 THEN 'chatter' ELSE 'stored' END AS status FROM t
""")
def checkpoint_filter(spark, sf_dir):
    t = F.col("turn")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t % 3 == 0, F.substr("text", F.lit(1), t + 3)).otherwise(F.col("text")).alias("text"), (t == 3).alias("force"))
    return validation.checkpoint_filter(rows).select("conv_id", "turn", "status")
