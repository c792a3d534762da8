"""Belief revision over the version chains of orders and over keyed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.jobs.registry import query
from recollect.operators import lenses, revise
from recollect.sources.derived import CHAINS, MEMORIES, TASK_STATE, chains, memories, read, task_state_ops

AT = "2024-02-01 12:00:00"


def now():
    return F.lit(AT).cast("timestamp_ntz")


@query(f"WITH {MEMORIES} SELECT scope, category, valid_from = known_at AS at_once, count(*) AS n, CAST(sum(version) AS BIGINT) AS versions FROM (SELECT scope, category, valid_from, known_at, version FROM memories "
       f"UNION ALL SELECT 'org/puts', 'episodic', CASE WHEN turn % 2 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '{AT}' END, TIMESTAMP '{AT}', 1 FROM conversations) GROUP BY ALL")
def apply_puts(spark, sf_dir):
    at = F.when(F.col("turn") % 2 == 0, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    puts = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("org/puts").alias("scope"), F.lit("episodic").alias("category"), "text",
        at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("known_at"),
    )
    rows, _ = revise.apply_puts(memories(spark, sf_dir), puts, now())
    return rows.groupBy("scope", "category", (F.col("valid_from") == F.col("known_at")).alias("at_once")).agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query("""
    WITH p AS (SELECT doc_id AS seq, 'org/' || source AS scope, source || '-' || (n_chars % 7) AS key, n_chars % 14 AS identity FROM documents),
    s AS (SELECT DISTINCT scope, key, 3 AS identity, ends_with(key, '-4') AS erased FROM p WHERE ends_with(key, '-3') OR ends_with(key, '-4')),
    f AS (SELECT p.*, s.identity AS slot, erased, first_value(p.identity) OVER w AS fi, min(seq) OVER w AS fs FROM p LEFT JOIN s USING (scope, key) WINDOW w AS (PARTITION BY scope, key ORDER BY seq))
    SELECT seq, scope, key, CASE WHEN identity <> coalesce(slot, fi) THEN 'idempotency_conflict' WHEN coalesce(erased, false) THEN 'unavailable' WHEN slot IS NULL AND seq = fs THEN 'created' ELSE 'replayed' END AS status,
        CASE WHEN slot IS NULL THEN fs END AS first_seq FROM f
""")
def apply_keyed_puts(spark, sf_dir):
    puts = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("org/"), "source").alias("scope"), F.concat("source", F.lit("-"), F.col("n_chars") % 7).alias("key"),
        (F.col("n_chars") % 14).cast("string").alias("identity"),
    )
    slots = puts.where(F.col("key").endswith("-3") | F.col("key").endswith("-4")).select("scope", "key").distinct()
    slots = slots.select("scope", "key", F.lit("3").alias("identity"), F.col("key").endswith("-4").alias("erased"))
    return revise.keyed_put_outcomes(puts, slots)


def _keyed(spark, sf_dir):
    puts = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("org/"), "source").alias("scope"), F.concat("source", F.lit("-"), F.col("n_chars") % 7).alias("key"),
        (F.col("n_chars") % 14).cast("string").alias("identity"), F.lit("semantic").alias("category"), "text",
    )
    slots = puts.where(F.col("key").endswith("-3")).select("scope", "key").distinct().select("scope", "key", F.lit("3").alias("identity"), F.lit(False).alias("erased"))
    return revise.apply_keyed_puts(memories(spark, sf_dir), puts, slots, now())


_KEYED = """
    WITH p AS (SELECT doc_id AS seq, 'org/' || source AS scope, source || '-' || (n_chars % 7) AS key, CAST(n_chars % 14 AS VARCHAR) AS identity, text FROM documents),
    c AS (SELECT * FROM p WHERE NOT ends_with(key, '-3') QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY seq) = 1)
"""


@query(f"{_KEYED} SELECT DISTINCT scope, key, '3' AS identity FROM p WHERE ends_with(key, '-3') UNION ALL SELECT scope, key, identity FROM c")
def keyed_slots(spark, sf_dir):
    return _keyed(spark, sf_dir)[1].select("scope", "key", "identity")


@query(f"{_KEYED} SELECT scope, sha256(text) AS text, 1 AS version FROM c UNION ALL SELECT 'org/' || source || '/' || lang, sha256(text), doc_id % 3 + 1 FROM documents")
def keyed_table(spark, sf_dir):
    return _keyed(spark, sf_dir)[0].select("scope", F.sha2("text", 256).alias("text"), "version")


_REQUESTS = """
    requests AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'o' || l_orderkey AS prior_id, CASE WHEN l_partkey % 11 = 0 THEN 'org/x' ELSE scope END AS scope,
        CASE WHEN l_suppkey % 5 = 0 THEN version + 1 ELSE version END AS expected_version, CASE WHEN l_linenumber = 3 THEN TIMESTAMP '1990-01-01 00:00:00' END AS close_at, chains.*  EXCLUDE (scope)
        FROM lineitem JOIN chains ON id = 'o' || l_orderkey)"""


def _requests(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("id", F.concat(F.lit("o"), "l_orderkey"))
    rows = lines.join(chains(spark, sf_dir).select("id", "scope", "version"), "id")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("id").alias("prior_id"), F.when(F.col("l_partkey") % 11 == 0, "org/x").otherwise(F.col("scope")).alias("scope"),
        F.when(F.col("l_suppkey") % 5 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("expected_version"),
        F.when(F.col("l_linenumber") == 3, F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")).alias("close_at"), F.lit(None).cast("timestamp_ntz").alias("new_valid_from"), F.lit("new").alias("text"),
    )


def _heads(spark, sf_dir):
    return chains(spark, sf_dir).withColumn("sys_closed", F.col("valid_until"))


_OUTCOMES = f"""
    checked AS (SELECT *, CASE WHEN scope <> (SELECT 'org/c' || o_custkey FROM orders WHERE 'o' || o_orderkey = prior_id) THEN 'scope_denied' WHEN expected_version <> version THEN 'version_conflict'
        WHEN valid_until IS NOT NULL OR superseded_by IS NOT NULL THEN 'already_closed' WHEN coalesce(close_at, TIMESTAMP '{AT}') < valid_from THEN 'invalid_interval' END AS reason FROM requests),
    outcomes AS (SELECT seq, prior_id, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY prior_id ORDER BY reason IS NOT NULL, seq) = 1 THEN 'ok' ELSE 'conflict' END) AS status FROM checked)"""


@query(f"WITH {CHAINS}, {_REQUESTS}, {_OUTCOMES} SELECT * FROM outcomes")
def apply_supersedes(spark, sf_dir):
    _, outcomes = revise.apply_supersedes(_requests(spark, sf_dir), _heads(spark, sf_dir), now())
    return outcomes.select("seq", "prior_id", "status")


@query(f"""
    WITH {CHAINS}, {_REQUESTS}, {_OUTCOMES}, won AS (SELECT prior_id, seq FROM outcomes WHERE status = 'ok')
    SELECT id, version + (seq IS NOT NULL)::BIGINT AS version, coalesce(superseded_by, prior_id || '+' || seq) AS superseded_by, valid_until IS NULL AND seq IS NULL AS open FROM chains LEFT JOIN won ON id = prior_id
    UNION ALL SELECT prior_id || '+' || seq, 1, NULL, true FROM won
""")
def superseded_table(spark, sf_dir):
    rows, _ = revise.apply_supersedes(_requests(spark, sf_dir), _heads(spark, sf_dir), now())
    return rows.select("id", "version", "superseded_by", F.col("valid_until").isNull().alias("open"))


@query(f"""
    WITH {CHAINS}, {_REQUESTS}, c AS (SELECT *, CASE WHEN scope <> (SELECT 'org/c' || o_custkey FROM orders WHERE 'o' || o_orderkey = prior_id) THEN 'scope_denied' WHEN expected_version <> version THEN 'version_conflict'
        WHEN valid_until IS NOT NULL THEN 'already_closed' WHEN coalesce(close_at, TIMESTAMP '{AT}') < valid_from THEN 'invalid_interval' END AS reason FROM requests),
    o AS (SELECT seq, id, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY reason IS NOT NULL, seq) = 1 THEN 'ok' ELSE 'conflict' END) AS status FROM c),
    w AS (SELECT id FROM o WHERE status = 'ok')
    SELECT scope, count(*) AS n, count(*) FILTER (WHERE valid_until IS NOT NULL OR w.id IS NOT NULL) AS closed, CAST(sum(version + (w.id IS NOT NULL)::BIGINT) AS BIGINT) AS versions FROM chains LEFT JOIN w USING (id) GROUP BY scope
""")
def apply_soft_forgets(spark, sf_dir):
    asked = _requests(spark, sf_dir).withColumnRenamed("prior_id", "id").withColumn("at", F.coalesce("close_at", now()))
    rows, _ = revise.apply_soft_forgets(asked, _heads(spark, sf_dir))
    return rows.groupBy("scope").agg(F.count("*").alias("n"), F.count("valid_until").alias("closed"), F.sum("version").alias("versions"))


_LINKS = "links AS (SELECT id AS subject, 'derived_from' AS predicate, supersedes AS object, 'active' AS state FROM chains WHERE supersedes IS NOT NULL)"


def _links(spark, sf_dir):
    return chains(spark, sf_dir).where(F.col("supersedes").isNotNull()).select(F.col("id").alias("subject"), F.lit("derived_from").alias("predicate"), F.col("supersedes").alias("object"), F.lit("active").alias("state"))


@query(f"WITH {CHAINS}, {_LINKS}, gone AS (SELECT id FROM chains WHERE text = 'F') SELECT subject, object, CASE WHEN subject IN (SELECT id FROM gone) OR object IN (SELECT id FROM gone) THEN 'purged' ELSE state END AS state, "
       "CASE WHEN subject IN (SELECT id FROM gone) OR object IN (SELECT id FROM gone) THEN 'endpoint_erased' END AS state_reason FROM links")
def apply_hard_erases(spark, sf_dir):
    rows = chains(spark, sf_dir)
    _, edges, _ = revise.apply_hard_erases(rows, _links(spark, sf_dir), rows.where("text = 'F'"))
    return edges.select("subject", "object", "state", "state_reason")


@query(f"WITH {CHAINS}, {_LINKS} SELECT subject, object, CASE WHEN s OR o THEN 'stale' ELSE state END AS state, CASE WHEN s OR o THEN 'endpoint_superseded' END AS state_reason FROM "
       "(SELECT *, subject IN (SELECT id FROM chains WHERE text = 'O') AS s, object IN (SELECT id FROM chains WHERE text = 'O') AS o FROM links)")
def stale_edges(spark, sf_dir):
    return revise.stale_edges(_links(spark, sf_dir), chains(spark, sf_dir).where("text = 'O'")).select("subject", "object", "state", "state_reason")


@query(f"WITH {CHAINS} SELECT DISTINCT c.id FROM chains c JOIN chains p ON c.supersedes = p.id AND p.text = 'O' AND c.scope = p.scope")
def stale_dependents(spark, sf_dir):
    rows = chains(spark, sf_dir)
    derived = rows.where(F.col("supersedes").isNotNull()).select("id", F.col("supersedes").alias("source"))
    return revise.stale_dependents(rows, derived, rows.where("text = 'O'"))


@query(f"WITH {CHAINS} SELECT a.id AS asked, b.id, CAST(b.version - a.version AS INTEGER) AS pos FROM chains a JOIN chains b ON a.scope = b.scope AND a.text = 'P' AND abs(b.version - a.version) <= 64")
def history(spark, sf_dir):
    rows = chains(spark, sf_dir)
    return revise.history(rows, rows.where("text = 'P'").select("id"))


@query(f"WITH {CHAINS}, {_REQUESTS} SELECT seq, prior_id AS id, expected_version AS expected, version AS found FROM requests WHERE expected_version <> version")
def version_conflicts(spark, sf_dir):
    return revise.version_conflicts(_requests(spark, sf_dir).withColumnRenamed("prior_id", "id"), chains(spark, sf_dir))


_ANNOTATED = """
    WITH m AS (SELECT 'm' || doc_id AS id, 'org/' || doc_id % 2 AS scope, CASE doc_id % 6 WHEN 4 THEN NULL WHEN 5 THEN '[1]' ELSE '{"a":"' || source || '","b":1,"o":{"p":[' || doc_id || ',null]}}' END AS attrs,
        doc_id % 3 + 1 AS version, CAST(0.5 AS DOUBLE) AS confidence, doc_id FROM documents),
    r AS (SELECT conv_id * 100 + turn AS seq, CASE WHEN conv_id % 11 = 0 THEN 'zz' ELSE 'm' END || conv_id AS id, 'org/' || CASE WHEN turn % 5 = 4 THEN 'x' ELSE '' END || conv_id % 2 AS scope, CASE WHEN turn % 3 = 0 THEN 1 END AS expected, turn,
        CASE WHEN turn % 4 = 3 THEN NULL ELSE '{"b":' || turn || ',"t":true,"z":null,"o":{"q":1.5}' || CASE WHEN turn % 6 = 5 THEN ',"l":"' || repeat('x', 5000) || '"' ELSE '' END || '}' END AS attrs FROM conversations),
    c AS (SELECT r.seq, r.id, r.turn, m.version, r.attrs, CASE WHEN m.id IS NULL THEN 'not_found' WHEN r.scope <> m.scope THEN 'scope_denied' WHEN expected <> m.version THEN 'version_conflict' WHEN turn % 12 = 5 THEN 'attrs_too_large' END AS reason
        FROM r LEFT JOIN m USING (id)),
    o AS (SELECT *, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY reason IS NOT NULL, seq) = 1 THEN 'ok' ELSE 'conflict' END) AS status FROM c)
"""


def _annotated(spark, sf_dir):
    """Documents as memories with attrs of every JSON type; turns of conversations as requests, some of them bad."""
    d, turn, conv = F.col("doc_id"), F.col("turn"), F.col("conv_id")
    attrs = F.when(d % 6 == 5, "[1]").when(d % 6 != 4, F.concat(F.lit('{"a":"'), "source", F.lit('","b":1,"o":{"p":['), d, F.lit(",null]}}")))
    rows = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), d).alias("id"), F.concat(F.lit("org/"), d % 2).alias("scope"), attrs.alias("attrs"), (d % 3 + 1).alias("version"), F.lit(0.5).alias("confidence")
    )
    long = F.when(turn % 6 == 5, F.concat(F.lit(',"l":"'), F.repeat(F.lit("x"), F.lit(5000)), F.lit('"'))).otherwise("")
    asked = read(spark, sf_dir, "conversations").select(
        (conv * 100 + turn).alias("seq"), F.concat(F.when(conv % 11 == 0, "zz").otherwise("m"), conv).alias("id"),
        F.concat(F.lit("org/"), F.when(turn % 5 == 4, "x").otherwise(""), conv % 2).alias("scope"), F.when(turn % 3 == 0, 1).alias("expected_version"),
        F.when(turn % 4 != 3, F.concat(F.lit('{"b":'), turn, F.lit(',"t":true,"z":null,"o":{"q":1.5}'), long, F.lit("}"))).alias("attrs"),
        F.when(turn % 2 == 0, 0.75).alias("confidence"), F.lit(None).cast("string").alias("provenance_source"), F.lit(None).cast("string").alias("provenance_kind"), (turn % 4 != 3).alias("bump_version"),
    )
    return revise.apply_annotations(asked, rows, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


@query(f"""{_ANNOTATED}
    SELECT m.id, m.scope, CASE WHEN w.attrs IS NULL THEN m.attrs WHEN doc_id % 6 >= 4 THEN w.attrs
            ELSE (json_object('a', m.attrs->>'a', 'b', turn)::VARCHAR)[:-2] || ',"o":{{"q":1.5}},"t":true,"z":null}}' END AS attrs,
        m.version + CASE WHEN w.turn % 4 <> 3 THEN 1 ELSE 0 END AS version, CASE WHEN w.turn % 2 = 0 THEN CAST(0.75 AS DOUBLE) ELSE confidence END AS confidence
    FROM m LEFT JOIN (SELECT id, turn, attrs FROM o WHERE status = 'ok') w USING (id)
""")
def apply_annotations(spark, sf_dir):
    return _annotated(spark, sf_dir)[0]


@query(f"{_ANNOTATED} SELECT seq, id, status FROM o")
def annotation_outcomes(spark, sf_dir):
    return _annotated(spark, sf_dir)[1]


@query(f"{_ANNOTATED} SELECT id AS memory_id, 'annotate' AS kind, version + CASE WHEN turn % 4 <> 3 THEN 1 ELSE 0 END AS version, turn % 4 <> 3 AS bump FROM o WHERE status = 'ok'")
def annotation_events(spark, sf_dir):
    return _annotated(spark, sf_dir)[2].select("memory_id", "kind", "version", "bump")


@query("""
    SELECT 'm' || k AS memory_id, event_id, kind, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS pos FROM (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CASE event_type WHEN 'view' THEN 'assert' WHEN 'click' THEN 'annotate' WHEN 'purchase' THEN 'supersede' ELSE 'other' END AS kind FROM events) WHERE kind <> 'other'
""")
def belief_events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "view", "assert").when(F.col("event_type") == "click", "annotate").when(F.col("event_type") == "purchase", "supersede").otherwise("other")
    events = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("memory:m"), k).alias("memory_id"), kind.alias("kind"), F.col("ts").alias("at_sys"))
    ids = events.select(F.regexp_replace("memory_id", "^memory:", "").alias("id"))
    return revise.belief_events(events, ids, ("assert", "annotate", "supersede")).select("memory_id", "event_id", "kind", "pos")


@query("""
    WITH o AS (SELECT conv_id AS batch_id, turn AS idx, CASE turn % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'forget' ELSE 'noop' END AS op, conv_id % 2 = 0 AS hard, (conv_id + turn) % 6 = 5 AS failed FROM conversations),
    f AS (SELECT *, min(CASE WHEN failed THEN idx END) OVER (PARTITION BY batch_id) AS first FROM o)
    SELECT batch_id, idx, CASE WHEN first IS NULL OR idx < first THEN 'ok' WHEN idx = first THEN 'failed' ELSE 'not_attempted' END AS status,
        CASE WHEN first IS NULL OR idx < first THEN CASE WHEN op = 'forget' THEN 'soft_forget' ELSE op END END AS applied FROM f
""")
def apply_ops(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    ops = read(spark, sf_dir, "conversations").select(c.alias("batch_id"), t.alias("idx"), F.when(t % 3 == 0, "put").when(t % 3 == 1, "forget").otherwise("noop").alias("op"), (c % 2 == 0).alias("hard"), ((c + t) % 6 == 5).alias("failed"))
    return revise.op_outcomes(ops).select("batch_id", "idx", "status", "applied")


_BATCHES = """
    WITH m AS (SELECT 'm' || doc_id AS id, 'org/' || doc_id % 2 AS scope, text, doc_id % 3 + 1 AS version, doc_id % 13 = 0 AS closed FROM documents),
    o AS (SELECT conv_id AS batch_id, turn AS idx, list_extract(['put', 'forget', 'supersede', 'noop', 'odd'], (conv_id + turn * turn) % 31 % 5 + 1) AS op, (conv_id // 3 + turn * 2) AS d, turn % 2 = 0 AS hard,
        CASE WHEN turn % 7 = 6 THEN ' ' ELSE text END AS text FROM conversations),
    t AS (SELECT o.* EXCLUDE (d), 'm' || d AS id, 'org/' || CASE WHEN (batch_id + idx) % 17 = 0 THEN 'x' ELSE '' END || d % 2 AS scope, CASE WHEN idx % 3 = 0 THEN d % 3 + CASE WHEN batch_id % 19 = 0 THEN 2 ELSE 1 END END AS expected FROM o),
    r AS (SELECT t.*, m.version, op IN ('supersede', 'forget') AS targets, CASE WHEN op = 'odd' THEN 'unknown_op' WHEN op IN ('put', 'supersede') AND trim(t.text) = '' THEN 'empty_text' WHEN op IN ('supersede', 'forget') THEN
        CASE WHEN m.id IS NULL THEN 'not_found' WHEN t.scope <> m.scope THEN 'scope_denied' WHEN expected <> m.version THEN 'version_conflict' WHEN closed THEN 'already_closed' END END AS why FROM t LEFT JOIN m USING (id)),
    h AS (SELECT *, coalesce(why, CASE WHEN targets AND row_number() OVER (PARTITION BY id, targets, why IS NULL ORDER BY batch_id, idx) > 1 THEN 'conflict' END) AS reason FROM r),
    f AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN idx END) OVER (PARTITION BY batch_id) AS first FROM h),
    s AS (SELECT *, CASE WHEN first IS NULL OR idx < first THEN 'ok' WHEN idx = first THEN 'failed' ELSE 'not_attempted' END AS status FROM f),
    a AS (SELECT *, CASE WHEN status = 'ok' THEN CASE WHEN op = 'forget' AND hard THEN 'hard_forget' WHEN op = 'forget' THEN 'soft_forget' ELSE op END END AS applied, 'b' || batch_id || '-' || idx AS new_id FROM s)
"""


def _batches(spark, sf_dir):
    """Documents as memories; conversations as batches whose turns put, forget and supersede, some of them badly."""
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    closed = F.when(d % 13 == 0, now())
    rows = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), d).alias("id"), F.concat(F.lit("org/"), d % 2).alias("scope"), "text", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"), closed.alias("valid_until"),
        closed.alias("sys_closed"), none.alias("superseded_by"), none.alias("supersedes"), (d % 3 + 1).alias("version"),
    )
    c, t = F.col("conv_id"), F.col("turn")
    n = F.floor(c / 3) + t * 2
    ops = read(spark, sf_dir, "conversations").select(
        c.alias("batch_id"), t.alias("idx"), F.element_at(F.lit(["put", "forget", "supersede", "noop", "odd"]), ((c + t * t) % 31 % 5 + 1).cast("int")).alias("op"), F.concat(F.lit("m"), n).alias("id"),
        F.concat(F.lit("org/"), F.when((c + t) % 17 == 0, "x").otherwise(""), n % 2).alias("scope"), F.when(t % 7 == 6, " ").otherwise(F.col("text")).alias("text"),
        F.when(t % 3 == 0, n % 3 + F.when(c % 19 == 0, 2).otherwise(1)).alias("expected_version"), (t % 2 == 0).alias("hard"),
    )
    return revise.apply_ops(rows, ops, now(), hard_allowed=True)


@query(f"{_BATCHES} SELECT batch_id, idx, status, reason, applied FROM a")
def batch_outcomes(spark, sf_dir):
    return _batches(spark, sf_dir)[1]


@query(f"""{_BATCHES}, w AS (SELECT id, applied, new_id FROM a WHERE targets AND applied IS NOT NULL)
    SELECT m.id, scope, sha256(text) AS text, version + (applied IS NOT NULL)::BIGINT AS version, closed OR applied IS NOT NULL AS closed, CASE WHEN applied = 'supersede' THEN new_id END AS superseded_by, NULL AS supersedes
    FROM m LEFT JOIN w USING (id) WHERE applied IS NULL OR applied <> 'hard_forget'
    UNION ALL SELECT new_id, scope, sha256(text), 1, false, NULL, CASE WHEN op = 'supersede' THEN id END FROM a WHERE applied IN ('put', 'supersede')
""")
def batch_table(spark, sf_dir):
    rows = _batches(spark, sf_dir)[0]
    return rows.select("id", "scope", F.sha2("text", 256).alias("text"), "version", F.col("valid_until").isNotNull().alias("closed"), "superseded_by", "supersedes")


@query(f"""{_BATCHES}
    SELECT scope, new_id AS memory_id, 'assert' AS kind, 1 AS version FROM a WHERE applied IN ('put', 'supersede')
    UNION ALL SELECT scope, id, CASE applied WHEN 'supersede' THEN 'supersede' WHEN 'soft_forget' THEN 'forget' ELSE 'erase' END, version + (applied <> 'hard_forget')::BIGINT FROM a WHERE targets AND applied IS NOT NULL
""")
def batch_events(spark, sf_dir):
    return _batches(spark, sf_dir)[2].select("scope", "memory_id", "kind", "version")


LATER = "2024-03-02 12:00:00"
_SEEN_LATER = f"""
    seen AS (SELECT id, category, version, supersedes FROM every WHERE coalesce(sys_created, known_at) <= TIMESTAMP '{LATER}' AND (sys_closed IS NULL OR sys_closed > TIMESTAMP '{LATER}') AND known_at <= TIMESTAMP '{LATER}'
        AND valid_from <= TIMESTAMP '{LATER}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{LATER}'))
    SELECT * FROM seen
"""


def _seen_later(rows):
    """What a request a month later sees under all three times."""
    t = F.lit(LATER).cast("timestamp_ntz")
    return lenses.as_of(lenses.known_as_of(lenses.sys_as_of(rows, t), t), t).select("id", "category", "version", "supersedes")


def _linked_memories(spark, sf_dir):
    none = F.lit(None).cast("string")
    return memories(spark, sf_dir).drop("n").withColumns({"superseded_by": none, "supersedes": none})


@query(f"""
    WITH {MEMORIES}, r AS (SELECT conv_id * 1000 + turn AS seq, 'm' || conv_id AS id, conv_id % 3 + 1 AS expected, CASE WHEN turn % 2 = 1 THEN 'identity' END AS category, CASE WHEN turn % 3 = 2 THEN TIMESTAMP '{LATER}' + INTERVAL 1 DAY END AS known FROM conversations),
    w AS (SELECT r.*, m.category AS prior FROM r JOIN memories m USING (id) WHERE valid_until IS NULL AND sys_closed IS NULL AND TIMESTAMP '{AT}' >= valid_from QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
    every AS (SELECT id, m.category, version + (w.id IS NOT NULL)::BIGINT AS version, NULL AS supersedes, valid_from, CASE WHEN w.id IS NULL THEN valid_until ELSE TIMESTAMP '{AT}' END AS valid_until, known_at, sys_created,
            CASE WHEN w.id IS NULL THEN sys_closed ELSE TIMESTAMP '{AT}' END AS sys_closed FROM memories m LEFT JOIN w USING (id)
        UNION ALL SELECT id || '+' || seq, coalesce(category, prior), 1, id, TIMESTAMP '{AT}', NULL, coalesce(known, TIMESTAMP '{AT}'), TIMESTAMP '{AT}', NULL FROM w),
    {_SEEN_LATER}
""")
def superseded_seen_later(spark, sf_dir):
    """Memories after turns of conversations superseded them, as all time lenses show them a month later."""
    rows = _linked_memories(spark, sf_dir)
    c, t = F.col("conv_id"), F.col("turn")
    at = F.lit(LATER).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    none = F.lit(None).cast("timestamp_ntz")
    asked = read(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("seq"), F.concat(F.lit("m"), c).alias("prior_id"), (c % 3 + 1).alias("expected_version"), none.alias("close_at"), none.alias("new_valid_from"),
        F.when(t % 3 == 2, at).alias("new_known_at"), F.when(t % 2 == 1, "identity").alias("category"), "text",
    )
    asked = asked.join(rows.select(F.col("id").alias("prior_id"), "scope"), "prior_id")
    return _seen_later(revise.apply_supersedes(asked, rows, now())[0])


@query(f"""
    WITH {MEMORIES}, o AS (SELECT conv_id AS batch_id, turn AS idx, list_extract(['put', 'forget', 'supersede'], (conv_id + turn) % 3 + 1) AS op, 'm' || (conv_id * 3 + turn) AS id, CASE WHEN turn % 2 = 0 THEN 'procedural' END AS category FROM conversations WHERE trim(text) <> ''),
    r AS (SELECT o.*, m.category AS prior, op <> 'put' AS targets, CASE WHEN op = 'put' THEN NULL WHEN m.id IS NULL THEN 'not_found' WHEN valid_until IS NOT NULL OR sys_closed IS NOT NULL THEN 'already_closed' END AS why FROM o LEFT JOIN memories m USING (id)),
    h AS (SELECT *, coalesce(why, CASE WHEN targets AND row_number() OVER (PARTITION BY id, targets, why IS NULL ORDER BY batch_id, idx) > 1 THEN 'conflict' END) AS reason FROM r),
    d AS (SELECT * FROM h QUALIFY coalesce(idx < min(CASE WHEN reason IS NOT NULL THEN idx END) OVER (PARTITION BY batch_id), true)),
    w AS (SELECT id FROM d WHERE targets),
    every AS (SELECT id, m.category, version + (w.id IS NOT NULL)::BIGINT AS version, NULL AS supersedes, valid_from, CASE WHEN w.id IS NULL THEN valid_until ELSE TIMESTAMP '{AT}' END AS valid_until, known_at, sys_created,
            CASE WHEN w.id IS NULL THEN sys_closed ELSE TIMESTAMP '{AT}' END AS sys_closed FROM memories m LEFT JOIN w USING (id)
        UNION ALL SELECT 'b' || batch_id || '-' || idx, CASE WHEN op = 'put' THEN category ELSE coalesce(category, prior) END, 1, CASE WHEN op = 'supersede' THEN id END, TIMESTAMP '{AT}', NULL, TIMESTAMP '{AT}', TIMESTAMP '{AT}', NULL FROM d WHERE op IN ('put', 'supersede')),
    {_SEEN_LATER}
""")
def batches_seen_later(spark, sf_dir):
    """Memories after batches of puts, forgets and supersedes, as all time lenses show them a month later."""
    rows = _linked_memories(spark, sf_dir)
    c, t = F.col("conv_id"), F.col("turn")
    ops = read(spark, sf_dir, "conversations").where(F.trim("text") != "").select(
        c.alias("batch_id"), t.alias("idx"), F.element_at(F.lit(["put", "forget", "supersede"]), ((c + t) % 3 + 1).cast("int")).alias("op"), F.concat(F.lit("m"), c * 3 + t).alias("id"),
        F.when(t % 2 == 0, "procedural").alias("category"), "text", F.lit(None).cast("long").alias("expected_version"), F.lit(False).alias("hard"),
    )
    ops = ops.join(rows.select("id", "scope"), "id", "left").withColumn("scope", F.coalesce("scope", F.lit("org")))
    return _seen_later(revise.apply_ops(rows, ops, now())[0])


@query(TASK_STATE)
def fold_task_state(spark, sf_dir):
    return revise.fold_task_state(task_state_ops(spark, sf_dir))
