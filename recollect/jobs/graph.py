"""Relationship edges over customers, suppliers, nations and parts, and links of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.jobs.registry import query
from recollect.jobs.retrieval import VISIBLE, _asked, _top, bm25_sql
from recollect.operators import graph, lexical
from recollect.sources.derived import EDGES, MEMORIES, PROBES, edges, memories, read
from recollect.sources.shared import saved


VISITED, MOST_EDGES = 24, 40


def _level(n: int) -> str:
    """One level of the walk, from the frontier f{n - 1} and the nodes n{n - 1} seen so far."""
    return f"""
    a{n} AS (SELECT seed, s.b, scanned + row_number() OVER (PARTITION BY seed ORDER BY rank, s.id, s.b) AS pos, scanned, seen, list_append(path, s.id) AS path FROM f{n - 1} JOIN steps s ON s.a = node),
    b{n} AS (SELECT seed, b AS node, min(pos) AS pos FROM a{n} WHERE pos <= {MOST_EDGES} AND NOT EXISTS (SELECT 1 FROM n{n - 1} x WHERE x.seed = a{n}.seed AND x.node = b) GROUP BY seed, b),
    c{n} AS (SELECT b{n}.seed, node, b{n}.pos, path, seen, row_number() OVER (PARTITION BY b{n}.seed ORDER BY b{n}.pos) AS rank FROM b{n} JOIN a{n} ON a{n}.seed = b{n}.seed AND a{n}.pos = b{n}.pos),
    d{n} AS (SELECT * FROM c{n} WHERE rank <= {VISITED} - seen),
    e{n} AS (SELECT seed, max(pos) AS pos, max(scanned) AS before, max(seen) AS seen, (SELECT count(*) FROM d{n} d WHERE d.seed = a{n}.seed) AS found, (SELECT max(pos) FROM d{n} d WHERE d.seed = a{n}.seed) AS last FROM a{n} GROUP BY seed),
    g{n} AS (SELECT seed, seen + found AS seen, least(pos, {MOST_EDGES}) AS scanned, pos >= {MOST_EDGES} AS by_edges, seen + found >= {VISITED} AND least(pos, {MOST_EDGES}) > coalesce(last, before) AS by_visited FROM e{n}),
    f{n} AS (SELECT d.seed, d.node, d.path, d.rank, g.scanned, g.seen FROM d{n} d JOIN g{n} g USING (seed) WHERE NOT by_edges AND NOT by_visited),
    n{n} AS (SELECT seed, node, depth, path FROM n{n - 1} UNION ALL SELECT seed, node, {n}, path FROM d{n})"""


_WALK = f"""
    WITH {EDGES}, named AS (SELECT *, subject || '|' || predicate || '|' || object AS id FROM edges),
    moves AS (SELECT subject AS a, object AS b, id FROM named UNION SELECT object, subject, id FROM named WHERE predicate = 'contradicts'),
    steps AS (SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY a ORDER BY id, b) <= {MOST_EDGES} + 1),
    f0 AS (SELECT DISTINCT 'p' || p_partkey AS seed, 'p' || p_partkey AS node, CAST([] AS VARCHAR[]) AS path, 1 AS rank, 0 AS scanned, 1 AS seen FROM part),
    n0 AS (SELECT seed, node, 0 AS depth, path FROM f0), {_level(1)}, {_level(2)}"""


def _walk(spark, sf_dir):
    seeds = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.traverse(edges(spark, sf_dir), seeds, 2, "out", VISITED, MOST_EDGES)


@query(f"{_WALK} SELECT seed, node, depth, array_to_string(path, '>') AS path FROM n2")
def traverse(spark, sf_dir):
    return _walk(spark, sf_dir)[0].withColumn("path", F.array_join("path", ">"))


@query(f"""{_WALK},
    m AS (SELECT seed, 'depth' AS mark FROM f2 WHERE node IN (SELECT a FROM steps) UNION SELECT seed, 'edges' FROM g1 WHERE by_edges UNION SELECT seed, 'edges' FROM g2 WHERE by_edges UNION SELECT seed, 'visited' FROM g1 WHERE by_visited UNION SELECT seed, 'visited' FROM g2 WHERE by_visited)
    SELECT f0.seed, greatest(1, coalesce(g1.seen, 1), coalesce(g2.seen, 1)) AS visited, greatest(coalesce(g1.scanned, 0), coalesce(g2.scanned, 0)) AS edges_scanned, (SELECT max(depth) FROM n2 WHERE n2.seed = f0.seed) AS depth_reached,
        coalesce((SELECT string_agg(mark, ',' ORDER BY mark) FROM m WHERE m.seed = f0.seed), '') AS truncated FROM f0 LEFT JOIN g1 ON g1.seed = f0.seed LEFT JOIN g2 ON g2.seed = f0.seed
""")
def traverse_stats(spark, sf_dir):
    return _walk(spark, sf_dir)[1].withColumn("truncated", F.array_join("truncated", ","))


_REGISTRY = ", ".join(f"('{p}', {list(s)}, {list(o)}, {str(r).lower()})" for p, s, o, _, r in graph.PREDICATES)
_KINDS = ("memory", "entity", "span", "artifact")


@query(f"""
    WITH reg(predicate, sk, ok, reserved) AS (VALUES {_REGISTRY}),
    e AS (SELECT o_orderkey, list_extract([{", ".join(repr(p[0]) for p in graph.PREDICATES)}, 'unheard_of'], o_orderkey % 11 + 1) AS predicate,
        list_extract({list(_KINDS)}, o_custkey % 4 + 1) AS s, list_extract({list(_KINDS)}, o_orderkey // 11 % 4 + 1) AS o FROM orders)
    SELECT o_orderkey, CASE WHEN reserved IS NULL THEN 'unknown_predicate' WHEN reserved THEN 'reserved_predicate' WHEN NOT list_contains(sk, s) THEN 'subject_kind' WHEN NOT list_contains(ok, o) THEN 'object_kind' END AS reason
    FROM e LEFT JOIN reg USING (predicate)
""")
def validate_edges(spark, sf_dir):
    names, kinds = F.lit([p[0] for p in graph.PREDICATES] + ["unheard_of"]), F.lit(list(_KINDS))
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        k, F.element_at(names, (k % 11 + 1).cast("int")).alias("predicate"), F.element_at(kinds, (F.col("o_custkey") % 4 + 1).cast("int")).alias("subject_kind"),
        F.element_at(kinds, (F.floor(k / 11) % 4 + 1).cast("int")).alias("object_kind"),
    )
    return graph.validate_edges(rows).select("o_orderkey", "reason")


@query("""
    WITH e AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1000000 ELSE 0 END AS object, o_orderkey % 3 AS scope FROM orders)
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'object_not_found' WHEN c_custkey % 3 <> scope THEN 'object_scope_denied' END AS reason FROM e LEFT JOIN customer ON c_custkey = object
""")
def dangling_endpoints(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        k, F.lit("order").alias("subject_kind"), F.concat(F.lit("o"), k).alias("subject"), F.lit("customer").alias("object_kind"),
        F.concat(F.lit("c"), F.col("o_custkey") + F.when(k % 9 == 0, 1000000).otherwise(0)).alias("object"), (k % 3).alias("scope"),
    )
    orders = rows.select(F.lit("order").alias("kind"), F.col("subject").alias("id"), "scope")
    people = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.concat(F.lit("c"), "c_custkey").alias("id"), (F.col("c_custkey") % 3).cast("long").alias("scope"))
    return graph.dangling_endpoints(rows, orders.unionByName(people)).select("o_orderkey", "reason")


@query("""
    WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'p' || l_partkey % 50 AS subject, 's' || l_suppkey AS object, l_linenumber % 2 AS payload FROM lineitem),
    h AS (SELECT DISTINCT subject, object, 1 AS held FROM n WHERE object LIKE '%7'),
    f AS (SELECT n.*, held, first_value(payload) OVER w AS fp, min(seq) OVER w AS fs FROM n LEFT JOIN h USING (subject, object) WINDOW w AS (PARTITION BY subject, object ORDER BY seq))
    SELECT seq, CASE WHEN payload <> coalesce(held, fp) THEN 'conflict' WHEN held IS NULL AND seq = fs THEN 'created' ELSE 'replayed' END AS status FROM f
""")
def dedupe_edges(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("org").alias("scope"), F.lit("contradicts").alias("predicate"),
        F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("subject"), F.concat(F.lit("s"), "l_suppkey").alias("object"), (F.col("l_linenumber") % 2).cast("int").alias("payload"),
    )
    held = rows.where(F.col("object").endswith("7")).select("scope", "predicate", "subject", "object").distinct().withColumns({"payload": F.lit(1), "state": F.lit("active")})
    return graph.dedupe_edges(rows, held).select("seq", "status")


@query("""
    WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'closed' ELSE 'active' END AS state, c_custkey % 3 + 1 AS version FROM customer),
    r AS (SELECT o_orderkey AS seq, o_custkey AS id, o_orderkey % 3 + 1 AS expected, CASE o_orderkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'active' WHEN 2 THEN 'stale' ELSE 'purged' END AS state, CASE WHEN o_orderkey % 5 > 0 THEN 'why' END AS reason FROM orders),
    c AS (SELECT r.seq, r.id, CASE WHEN e.id IS NULL THEN 'not_found' WHEN expected <> version THEN 'version_conflict' WHEN r.state = 'purged' THEN 'not_allowed' WHEN e.state <> 'active' AND r.state = 'active' THEN 'cannot_reopen'
        WHEN r.state IN ('closed', 'stale') AND reason IS NULL THEN 'reason_required' END AS why FROM r LEFT JOIN e USING (id))
    SELECT seq, id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY why IS NOT NULL, seq) = 1 THEN 'ok' ELSE 'conflict' END) AS status FROM c
""")
def update_edges(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    rows = read(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 4 == 0, "closed").otherwise("active").alias("state"), (c % 3 + 1).alias("version"))
    asked = read(spark, sf_dir, "orders").select(
        k.alias("seq"), F.col("o_custkey").alias("id"), (k % 3 + 1).alias("expected_version"),
        F.when(k % 4 == 0, "closed").when(k % 4 == 1, "active").when(k % 4 == 2, "stale").otherwise("purged").alias("state"), F.when(k % 5 > 0, "why").alias("reason"),
    )
    return graph.update_edges(rows, asked)[1]


_JOURNAL = """
    WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'closed' WHEN c_custkey % 9 = 0 THEN 'purged' ELSE 'active' END AS state, CASE WHEN c_custkey % 4 = 0 THEN 'old' END AS state_reason, c_custkey % 3 + 1 AS version,
        'asserted' AS epistemic, c_mktsegment AS evidence, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS valid_until FROM customer),
    r AS (SELECT o_orderkey AS seq, o_custkey AS id, o_custkey % 3 + 1 + (o_orderkey % 7 = 0)::BIGINT AS expected, CASE o_orderkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'stale' END AS state, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS reason,
        CASE WHEN o_orderkey % 2 = 0 THEN 'inferred' END AS epistemic, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS evidence, CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS valid_until FROM orders),
    w AS (SELECT r.* FROM r JOIN e USING (id) WHERE expected = version AND e.state <> 'purged' AND NOT (r.state IS NOT NULL AND reason IS NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
    n AS (SELECT id, coalesce(w.state, e.state) AS state, CASE WHEN w.state IS NULL THEN e.state_reason ELSE w.reason END AS state_reason, version + 1 AS version, coalesce(w.epistemic, e.epistemic) AS epistemic,
        coalesce(w.evidence, e.evidence) AS evidence, coalesce(w.valid_until, e.valid_until) AS valid_until FROM e JOIN w USING (id))
"""


def _journal(spark, sf_dir):
    """Customers as edges; orders as changes of their states, epistemics, evidence and ends."""
    c, k, o = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    rows = read(spark, sf_dir, "customer").select(
        c.alias("id"), F.when(c % 4 == 0, "closed").when(c % 9 == 0, "purged").otherwise("active").alias("state"), F.when(c % 4 == 0, "old").alias("state_reason"), (c % 3 + 1).alias("version"),
        F.lit("asserted").alias("epistemic"), F.col("c_mktsegment").alias("evidence"), F.when(c % 5 == 0, at("2024-02-01 00:00:00")).alias("valid_until"),
    )
    asked = read(spark, sf_dir, "orders").select(
        k.alias("seq"), o.alias("id"), (o % 3 + 1 + F.when(k % 7 == 0, 1).otherwise(0)).alias("expected_version"), F.when(k % 4 == 0, "closed").when(k % 4 == 1, "stale").alias("state"),
        F.when(k % 5 > 0, F.col("o_orderpriority")).alias("reason"), F.when(k % 2 == 0, "inferred").alias("epistemic"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("evidence"),
        F.when(k % 11 == 0, at("2024-03-01 00:00:00")).alias("valid_until"),
    )
    return rows, *graph.update_edges(rows, asked, at("2024-04-01 00:00:00"))


@query(f"{_JOURNAL} SELECT * FROM n UNION ALL SELECT * FROM e WHERE id NOT IN (SELECT id FROM n)")
def updated_edges(spark, sf_dir):
    return _journal(spark, sf_dir)[1]


@query(f"{_JOURNAL} SELECT * FROM e UNION ALL SELECT * FROM n")
def edges_at_version(spark, sf_dir):
    """Every edge as it was at its first version, and every changed one as it is now."""
    rows, changed, _, events = _journal(spark, sf_dir)
    asked = rows.select("id", "version").unionByName(rows.select("id", (F.col("version") + 1).alias("version")))
    return graph.edges_at_version(changed, events, asked)


@query("SELECT 's' || s_suppkey AS subject, 'n' || s_nationkey AS object FROM supplier WHERE s_nationkey = 3 ORDER BY s_suppkey % 7 DESC, 's' || s_suppkey LIMIT 128")
def list_edges(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.lit("depends_on").alias("predicate"), F.concat(F.lit("n"), "s_nationkey").alias("object"), F.lit("active").alias("state"), (F.col("s_suppkey") % 7).alias("valid_from")
    )
    return graph.list_edges(rows, F.lit("n3"), "depends_on").select("subject", "object")


_PAIRS = """pairs AS (SELECT 'm' || doc_id AS subject, 'contradicts' AS predicate, 'm' || (doc_id * 7 % (SELECT count(*) FROM documents)) AS object, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 100) AS valid_from,
        CASE WHEN doc_id % 9 = 0 THEN TIMESTAMP '2024-01-04 00:00:00' END AS valid_until FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT 'm' || doc_id, 'supports', 'm' || (doc_id % 30), TIMESTAMP '2024-01-01 00:00:00', NULL FROM documents WHERE doc_id % 3 = 0)"""


def _spread(n: int) -> str:
    """One level of expansion from the frontier f{n - 1}; c{n} has all candidates so far."""
    before = f"AND NOT EXISTS (SELECT 1 FROM c{n - 1} x WHERE x.query_id = a.query_id AND x.id = a.id)" if n > 1 else ""
    return f"""
    a{n} AS (SELECT f.query_id, s.b AS id, f.origin, s.predicate, f.found, f.scanned + row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank, s.id, s.b) AS pos, {n} AS depth
        FROM f{n - 1} f JOIN steps s ON s.a = f.node JOIN probes p USING (query_id) WHERE valid_from <= as_of AND (valid_until IS NULL OR valid_until > as_of)),
    w{n} AS (SELECT * FROM a{n} WHERE pos <= 256),
    b{n} AS (SELECT a.query_id, a.id, min(pos) AS pos, arg_min(origin, pos) AS origin, max(found) AS found, row_number() OVER (PARTITION BY a.query_id ORDER BY min(pos)) AS rank FROM w{n} a
        WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.query_id = a.query_id AND x.id = a.id) {before} GROUP BY a.query_id, a.id),
    g{n} AS (SELECT query_id, least(max(pos), 256) AS scanned, least(coalesce((SELECT max(rank + b.found) FROM b{n} b WHERE b.query_id = a{n}.query_id), max(found)), 32) AS found, max(pos) >= 256 AS by_edges,
        coalesce((SELECT max(rank + b.found) FROM b{n} b WHERE b.query_id = a{n}.query_id), 0) > 32 AS by_candidates FROM a{n} GROUP BY query_id),
    c{n} AS (SELECT query_id, id, {n} AS depth, pos FROM b{n} WHERE rank + found <= 32 {f"UNION ALL SELECT * FROM c{n - 1}" if n > 1 else ""}),
    f{n} AS (SELECT b.query_id, b.id AS node, b.origin, b.rank, g.scanned, g.found FROM b{n} b JOIN g{n} g USING (query_id) WHERE b.rank + b.found <= 32 AND NOT by_edges AND NOT by_candidates)"""


_EXPANDED = f"""
    WITH {MEMORIES}, {PROBES}, {VISIBLE}, {bm25_sql()}, hits AS ({_top('scored SEMI JOIN visible USING (query_id, id)', 8)}), {_PAIRS}, named AS (SELECT *, subject || '|' || predicate || '|' || object AS id FROM pairs),
    steps AS (SELECT DISTINCT * FROM (SELECT subject AS a, object AS b, predicate, id, valid_from, valid_until FROM named UNION ALL SELECT object, subject, predicate, id, valid_from, valid_until FROM named) WHERE a <> b),
    f0 AS (SELECT query_id, id AS node, id AS origin, rank1 AS rank, 0 AS scanned, 0 AS found FROM hits WHERE rank1 <= 8), {_spread(1)}, {_spread(2)},
    met AS (SELECT query_id, id, origin, predicate, pos, depth FROM w1 UNION ALL SELECT query_id, id, origin, predicate, pos, depth FROM w2),
    o AS (SELECT query_id, id, array_to_string(list(origin ORDER BY p)[1:3], ',') AS f FROM (SELECT query_id, id, origin, min(pos) AS p FROM met GROUP BY ALL) GROUP BY query_id, id),
    v AS (SELECT query_id, id, array_to_string(list(predicate ORDER BY p)[1:3], ',') AS via FROM (SELECT query_id, id, predicate, min(pos) AS p FROM met GROUP BY ALL) GROUP BY query_id, id),
    led AS (SELECT query_id, id, min(depth) AS depth, any_value(f) AS f, any_value(via) AS via FROM met JOIN o USING (query_id, id) JOIN v USING (query_id, id) GROUP BY query_id, id),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, pos) + (SELECT max(rank1) FROM hits h WHERE h.query_id = c2.query_id) AS rank1 FROM c2 SEMI JOIN visible USING (query_id, id)),
    rows_ AS (SELECT query_id, id, rank1, score, false AS expanded FROM hits UNION ALL SELECT query_id, id, rank1, 1 / (60.0::DOUBLE + rank1), true FROM kept)"""


def _expanded(spark, sf_dir):
    asked, rows = _asked(spark, sf_dir)
    hits = lexical.bm25_search(asked, rows, 8, "any")
    docs = read(spark, sf_dir, "documents")
    n, d = docs.count(), F.col("doc_id")
    m = lambda c: F.concat(F.lit("m"), c)
    none = F.lit(None).cast("timestamp_ntz")
    began = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    pairs = docs.where(d % 2 == 0).select(
        m(d).alias("subject"), F.lit("contradicts").alias("predicate"), m(d * 7 % n).alias("object"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 100 AS INT), 0, 0)").alias("valid_from"),
        F.when(d % 9 == 0, F.lit("2024-01-04 00:00:00").cast("timestamp_ntz")).alias("valid_until"),
    )
    hubs = docs.where(d % 3 == 0).select(m(d).alias("subject"), F.lit("supports").alias("predicate"), m(d % 30).alias("object"), began.alias("valid_from"), none.alias("valid_until"))
    return graph.graph_expand(hits, pairs.unionByName(hubs), asked, rows, depth=2)


@query(f"{_EXPANDED} SELECT query_id, id, rank1, round(score, 6) AS score, expanded, f AS \"from\", via, depth FROM rows_ LEFT JOIN led USING (query_id, id)")
def graph_expand(spark, sf_dir):
    out = _expanded(spark, sf_dir)[0]
    return out.withColumns({"score": F.round("score", 6), "from": F.array_join("from", ","), "via": F.array_join("via", ",")})


@query(f"""{_EXPANDED},
    t AS (SELECT query_id, 'depth' AS mark FROM f2 WHERE node IN (SELECT a FROM steps) UNION SELECT query_id, 'edges' FROM g1 WHERE by_edges UNION SELECT query_id, 'edges' FROM g2 WHERE by_edges UNION SELECT query_id, 'candidates' FROM g1 WHERE by_candidates UNION SELECT query_id, 'candidates' FROM g2 WHERE by_candidates)
    SELECT query_id, count(*) AS seeds, coalesce(greatest((SELECT scanned FROM g1 WHERE g1.query_id = f0.query_id), (SELECT scanned FROM g2 WHERE g2.query_id = f0.query_id)), 0) AS edges_scanned, (SELECT count(*) FROM c2 WHERE c2.query_id = f0.query_id) AS candidates_found,
        (SELECT count(*) FROM kept WHERE kept.query_id = f0.query_id) AS candidates_added, coalesce((SELECT string_agg(mark, ',' ORDER BY mark) FROM t WHERE t.query_id = f0.query_id), '') AS truncated FROM f0 GROUP BY query_id
""")
def expansion_stats(spark, sf_dir):
    return _expanded(spark, sf_dir)[1].withColumn("truncated", F.array_join("truncated", ","))


@query("""
    WITH r AS (SELECT o_orderkey AS seq, 'e' || o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS name, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 END AS expected FROM orders),
    e AS (SELECT 'e' || c_custkey AS id, c_name AS name, c_custkey % 3 + 1 AS version FROM customer WHERE c_custkey % 2 = 0),
    c AS (SELECT r.*, CASE WHEN version IS NOT NULL AND expected <> version THEN 'version_conflict' WHEN version IS NULL AND coalesce(r.name, '') = '' THEN 'name_required' END AS why FROM r LEFT JOIN e USING (id)),
    o AS (SELECT *, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY why IS NOT NULL, seq) = 1 THEN 'ok' ELSE 'conflict' END) AS status FROM c),
    w AS (SELECT id, name FROM o WHERE status = 'ok')
    SELECT coalesce(e.id, w.id) AS id, coalesce(w.name, e.name) AS name, coalesce(version, 0) + (w.id IS NOT NULL)::BIGINT AS version FROM e FULL JOIN w ON e.id = w.id
""")
def upsert_entities(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    rows = read(spark, sf_dir, "customer").where(c % 2 == 0).select(F.concat(F.lit("e"), c).alias("id"), F.lit("person").alias("kind"), F.col("c_name").alias("name"), (c % 3 + 1).alias("version"))
    asked = read(spark, sf_dir, "orders").select(
        k.alias("seq"), F.concat(F.lit("e"), "o_custkey").alias("id"), F.lit(None).cast("string").alias("kind"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("name"), F.when(k % 4 == 0, k % 5).alias("expected_version")
    )
    return graph.upsert_entities(rows, asked)[0].select("id", "name", "version")


@query("""
    WITH l AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1000000 ELSE 0 END AS m, user_id + CASE WHEN event_id % 15 = 0 THEN 1000000 ELSE 0 END AS s FROM events)
    SELECT event_id, CASE WHEN doc_id IS NULL THEN 'memory_not_found' WHEN c_custkey IS NULL THEN 'source_not_found' WHEN doc_id % 3 <> c_custkey % 3 THEN 'scope_denied' END AS reason FROM l LEFT JOIN documents ON doc_id = m LEFT JOIN customer ON c_custkey = s
""")
def link_derived_from(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        e, (F.get_json_object("props", "$.k").cast("long") + F.when(e % 10 == 0, 1000000).otherwise(0)).alias("id"), F.lit("artifact").alias("source_kind"), (F.col("user_id") + F.when(e % 15 == 0, 1000000).otherwise(0)).alias("source")
    )
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("scope"))
    of = read(spark, sf_dir, "customer").select(F.lit("artifact").alias("kind"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("scope"))
    return graph.link_derived_from(rows, own, of).select("event_id", "reason")


def _sections(spark, sf_dir, most_chars=1200):
    """Sections of a Markdown document for each document: its sentences are lines, some of them headings, some with requirements and links."""
    d = F.col("doc_id")
    req = lambda n: F.concat(F.lit("REQ-"), F.lpad((n % 1000).cast("string"), 3, "0"))
    tail = F.concat(F.lit(" **"), req(d), F.lit("** after "), req(d * 3), F.lit(" see [it](../docs/d"), d * 5 % 1000, F.lit(".md#part) or [that](d"), d * 7 % 500, F.lit(".txt)"))
    line = lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).when(i % 5 == 4, F.concat(F.lit("### "), x)).when(i % 4 == 1, F.concat(x, tail)).otherwise(x)
    text = F.array_join(F.transform(F.split("text", r"\. ", -1), line), "\n")
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), d).alias("doc"), text.alias("text"))
    return graph.split_sections(docs, most_chars)


def _sections_sql(most_chars=1200):
    return rf"""
    md AS (SELECT 'd' || doc_id AS doc, array_to_string(list_transform(string_split(text, '. '), lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN '## ' || x WHEN (i - 1) % 5 = 4 THEN '### ' || x WHEN (i - 1) % 4 = 1 THEN
        x || ' **REQ-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '** after REQ-' || lpad(CAST(doc_id * 3 % 1000 AS VARCHAR), 3, '0') || ' see [it](../docs/d' || (doc_id * 5 % 1000) || '.md#part) or [that](d' || (doc_id * 7 % 500) || '.txt)' ELSE x END), chr(10)) AS text FROM documents WHERE text IS NOT NULL),
    ln AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM md),
    numbered AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') OR starts_with(line, '### ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY no) AS section FROM ln),
    cut AS (SELECT doc, CAST(section AS BIGINT) AS section, substr(regexp_replace(string_agg(line, chr(10) ORDER BY no), '^\s+|\s+$', '', 'g'), 1, {most_chars}) AS text FROM numbered GROUP BY doc, section),
    headed AS (SELECT *, regexp_replace(regexp_replace(split_part(text, chr(10), 1), '^#+', ''), '^\s+|\s+$', '', 'g') AS heading FROM cut WHERE text <> ''),
    slugged AS (SELECT *, CASE WHEN section = 0 THEN '00-preamble' ELSE substr(regexp_replace(lower(regexp_replace(heading, '[^A-Za-z0-9]+', '-', 'g')), '^-|-$', '', 'g'), 1, 40) END AS slug FROM headed),
    sections AS (SELECT doc, section, doc || '::' || slug || CASE WHEN row_number() OVER same > 1 THEN '-' || row_number() OVER same ELSE '' END AS label, heading, text FROM slugged WINDOW same AS (PARTITION BY doc, slug ORDER BY section))"""


_SECTIONS = rf"""{_sections_sql()},
    defs AS (SELECT req, arg_min(label, (doc, section)) AS object FROM (SELECT doc, section, label, unnest(regexp_extract_all(text, '\*\*([A-Z]+-[0-9]+)', 1)) AS req FROM sections) WHERE length(req) = 7 GROUP BY req),
    uses AS (SELECT label AS subject, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9-])(REQ-[0-9]+)', 1)) AS req FROM sections),
    linked AS (SELECT label AS subject, regexp_extract(split_part(unnest(regexp_extract_all(text, '\]\(([^)]*)', 1)), '#', 1), '([^/]+)\.md$', 1) AS doc FROM sections),
    mined AS (SELECT DISTINCT subject, 'derived_from' AS predicate, object FROM uses JOIN defs USING (req) WHERE subject <> object
        UNION ALL SELECT DISTINCT subject, 'depends_on', label FROM linked JOIN sections USING (doc) WHERE section = 0 AND subject <> label)"""


@query(f"WITH {_SECTIONS} SELECT * FROM mined")
def mine_edges(spark, sf_dir):
    return graph.mine_edges(_sections(spark, sf_dir))


_STOP = ", ".join(f"'{w}'" for w in graph.HEADING_STOP_WORDS)
_WORDS = f"list_distinct(list_filter(regexp_split_to_array(translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})))"


@query(f"""
    WITH {_SECTIONS}, q AS (SELECT label, heading AS query, {_WORDS.format('heading')} AS q FROM sections), pairs AS (SELECT DISTINCT subject AS label, object FROM mined),
    asked AS (SELECT * FROM q WHERE len(q) >= 2 AND label IN (SELECT label FROM pairs)), b AS (SELECT label AS object, {_WORDS.format('text')} AS w FROM sections),
    far AS (SELECT DISTINCT a.label, b.object FROM pairs a JOIN pairs b ON a.object = b.label WHERE b.object <> a.label AND (a.label, b.object) NOT IN (SELECT (label, object) FROM pairs)),
    t AS (SELECT label, list_sort(list(object)) AS g FROM pairs GROUP BY label),
    g1 AS (SELECT label, list_sort(list(object)) AS g FROM asked JOIN pairs USING (label) JOIN b USING (object) WHERE NOT list_has_any(q, w) GROUP BY label),
    g2 AS (SELECT label, list_sort(list(object)) AS g FROM asked JOIN far USING (label) JOIN b USING (object) WHERE NOT list_has_any(q, w) GROUP BY label)
    SELECT label || '::' || CASE WHEN g1.g IS NOT NULL THEN 'd1' WHEN g2.g IS NOT NULL THEN 'd2' ELSE 'lex' END AS name, query, array_to_string(coalesce(g1.g, g2.g, t.g), ',') AS gold,
        CASE WHEN g1.g IS NULL AND g2.g IS NOT NULL THEN label || ',' || array_to_string(t.g, ',') ELSE label END AS seeds, CASE WHEN g1.g IS NOT NULL THEN 1 WHEN g2.g IS NOT NULL THEN 2 ELSE 0 END AS min_depth
    FROM asked JOIN t USING (label) LEFT JOIN g1 USING (label) LEFT JOIN g2 USING (label)
""")
def mine_probes(spark, sf_dir):
    sections = saved(_sections(spark, sf_dir), "sections")
    probes = graph.mine_probes(sections, graph.mine_edges(sections))
    return probes.select("name", "query", F.array_join("gold", ",").alias("gold"), F.array_join("seeds", ",").alias("seeds"), "min_depth")


@query(f"WITH {_sections_sql(1 << 30)} SELECT label, section, heading, md5(text) AS text FROM sections")
def split_sections(spark, sf_dir):
    return _sections(spark, sf_dir, 1 << 30).select("label", "section", "heading", F.md5("text").alias("text"))
