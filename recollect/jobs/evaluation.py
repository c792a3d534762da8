"""Evaluation, packing and insertion audit over the probes and derived tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.jobs.registry import query
from recollect.jobs.retrieval import VISIBLE, _asked, _top, bm25_sql
from recollect.operators import evaluate, lexical, packs
from recollect.operators import text_gold as by_text
from recollect.sources.derived import MEMORIES, PROBES, read

_HITS = f"{MEMORIES}, {PROBES}, {VISIBLE}, {bm25_sql()}, hits AS (SELECT h.*, text, version FROM ({_top('scored SEMI JOIN visible USING (query_id, id)', 8)}) h JOIN memories USING (id))"


def _hits(spark, sf_dir):
    asked, rows = _asked(spark, sf_dir)
    return asked, lexical.bm25_search(asked, rows, 8, "any").join(rows.select("id", "text", "version"), "id")


_P = """
    p AS (SELECT item_id AS probe, CASE WHEN item_id % 8 = 0 THEN [] ELSE ['m' || (item_id * 7 % 100), 'm' || item_id] END AS expect, ['m' || (item_id * 3 % 50)] AS forbid, item_id % 8 = 0 AS abstain, item_id % 3 AS tag FROM benchmark),
    k AS (SELECT user_id AS probe, 'm' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank1 FROM events WHERE event_type = 'view'),
    s AS (SELECT p.*, (SELECT list(DISTINCT key) FROM k WHERE k.probe = p.probe AND rank1 <= 20) AS keys, (SELECT count(*) FROM k WHERE k.probe = p.probe AND rank1 <= 20) AS n_hits FROM p),
    c AS (SELECT *, len(list_intersect(expect, coalesce(keys, []))) AS found, len(expect) AS expected, len(list_intersect(forbid, coalesce(keys, []))) AS leaked FROM s)"""


def _probe_rows(spark, sf_dir):
    n = F.col("item_id")
    m = lambda c: F.concat(F.lit("m"), c)
    probes = read(spark, sf_dir, "benchmark").select(
        n.alias("probe"), F.when(n % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(m(n * 7 % 100), m(n))).alias("expect"), F.array(m(n * 3 % 50)).alias("forbid"), (n % 8 == 0).alias("abstain"), (n % 3).alias("tag")
    )
    views = read(spark, sf_dir, "events").where("event_type = 'view'").select(
        F.col("user_id").alias("probe"), m(F.get_json_object("props", "$.k")).alias("key"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank1")
    )
    return probes, views


@query(f"WITH {_P} SELECT probe, n_hits, found, expected, leaked FROM c")
def search_to_gold(spark, sf_dir):
    probes, views = _probe_rows(spark, sf_dir)
    return evaluate.search_to_gold(views, probes, 20).select("probe", "n_hits", "found", "expected", "leaked")


_SCORED = f"{_P}, r AS (SELECT *, leaked = 0 AND CASE WHEN abstain THEN n_hits = 0 ELSE found = expected END AS hit, CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE found / expected::DOUBLE END AS recall FROM c)"


@query(f"WITH {_SCORED} SELECT probe, hit, recall FROM r")
def score_probes(spark, sf_dir):
    probes, views = _probe_rows(spark, sf_dir)
    return evaluate.score_probes(views, probes, 20).select("probe", "hit", "recall")


@query(f"WITH {_SCORED} SELECT 'views' AS system, tag, count(*) FILTER (WHERE probe % 5 > 0) AS n, count(*) FILTER (WHERE probe % 5 > 0 AND hit) AS hits, count(*) FILTER (WHERE probe % 5 = 0) AS skipped FROM r GROUP BY tag")
def tag_summary(spark, sf_dir):
    probes, views = _probe_rows(spark, sf_dir)
    rows = evaluate.score_probes(views, probes, 20).select(F.lit("views").alias("system"), "tag", "hit", (F.col("probe") % 5 == 0).alias("skipped"))
    return evaluate.tag_summary(rows)


@query("""
    WITH v AS (SELECT event_type AS system, list_sort(list(value)) AS v FROM events GROUP BY event_type)
    SELECT system, 'round' AS method, v[least(CAST(floor(0.5::DOUBLE * (len(v) - 1) + 0.5) AS BIGINT), len(v) - 1) + 1] AS p50, v[least(CAST(floor(0.95::DOUBLE * (len(v) - 1) + 0.5) AS BIGINT), len(v) - 1) + 1] AS p95, v[len(v)] AS max FROM v
    UNION ALL SELECT system, 'floor', v[len(v) // 2 + 1], v[len(v) * 95 // 100 + 1], v[len(v)] FROM v
""")
def latency_percentiles(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("system"), F.col("value").alias("ms"))
    one = lambda m: evaluate.latency_percentiles(rows, m).withColumn("method", F.lit(m))
    return one("round").unionByName(one("floor"))


@query("""
    WITH a AS (SELECT o_custkey AS scenario, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE AS precision, count(*) FILTER (WHERE o_orderstatus = 'O') / count(*)::DOUBLE AS recall, count(*) > 14 AS invented FROM orders GROUP BY o_custkey)
    SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, count(*) FILTER (WHERE invented) AS invented FROM a
""")
def macro_precision_recall(spark, sf_dir):
    share = lambda s: F.count_if(F.col("o_orderstatus") == s) / F.count("*")
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(share("F").alias("precision"), share("O").alias("recall"), (F.count("*") > 14).alias("invented"))
    return evaluate.macro_precision_recall(rows).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "invented")


@query("""
    WITH h AS (SELECT event_type AS strategy, user_id AS probe, 'm' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS key, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rank1 FROM events),
    p AS (SELECT item_id AS probe, ['m' || (item_id * 7 % 100), 'm' || item_id] AS gold, ['m' || (item_id % 10)] AS seeds, item_id % 3 AS min_depth FROM benchmark),
    x AS (SELECT s.strategy, p.*, coalesce((SELECT list(DISTINCT key) FROM h WHERE h.strategy = s.strategy AND h.probe = p.probe), []) AS a, coalesce((SELECT list(DISTINCT key) FROM h WHERE h.strategy = s.strategy AND h.probe = p.probe AND rank1 <= 6), []) AS t
        FROM p, (SELECT DISTINCT strategy FROM h) s),
    y AS (SELECT strategy, unnest(['overall', CASE WHEN min_depth > 0 THEN 'graph' ELSE 'lexical' END]) AS kind, len(list_intersect(list_distinct(gold), a)) / len(gold)::DOUBLE AS recall,
        len(list_filter(t, lambda k: NOT list_contains(gold, k) AND NOT list_contains(seeds, k))) AS noise FROM x)
    SELECT strategy, kind, round(avg(recall), 6) AS recall, round(avg(noise), 6) AS noise, count(*) AS n FROM y GROUP BY strategy, kind
""")
def expand_scores(spark, sf_dir):
    n = F.col("item_id")
    m = lambda c: F.concat(F.lit("m"), c)
    hits = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("strategy"), F.col("user_id").alias("probe"), m(F.get_json_object("props", "$.k")).alias("key"),
        F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")).alias("rank1"),
    )
    probes = read(spark, sf_dir, "benchmark").select(n.alias("probe"), F.array(m(n * 7 % 100), m(n)).alias("gold"), F.array(m(n % 10)).alias("seeds"), (n % 3).alias("min_depth"))
    out = evaluate.expand_scores(hits, probes, 6)
    return out.select("strategy", "kind", F.round("recall", 6).alias("recall"), F.round("noise", 6).alias("noise"), "n")


def _answers(spark, sf_dir):
    n, t = F.col("conv_id"), F.col("turn")
    mark = (
        F.when(t == 0, F.concat(F.lit("USED: [b"), n, F.lit(", b1] and more"))).when(t == 1, "ABSTAIN: none").when(t == 2, F.concat(F.lit("used b"), n)).otherwise("Used the block above.")
    )
    return read(spark, sf_dir, "conversations").select((n * 1000 + t).alias("probe"), F.concat("text", F.lit("\n"), mark).alias("raw"))


_ANSWERS = """
    answers AS (SELECT conv_id * 1000 + turn AS probe, text, CASE turn WHEN 0 THEN 'b' || conv_id || ',b1' WHEN 2 THEN 'b' || conv_id ELSE '' END AS used, turn = 1 AS abstained,
        trim(text || CASE WHEN turn > 2 THEN chr(10) || 'Used the block above.' ELSE '' END, chr(10) || ' ') AS body FROM conversations)"""


@query(f"WITH {_ANSWERS} SELECT probe, used, abstained, length(body) AS body_chars FROM answers")
def parse_citations(spark, sf_dir):
    out = evaluate.parse_citations(_answers(spark, sf_dir))
    return out.select("probe", F.array_join("used", ",").alias("used"), "abstained", F.length("body").cast("long").alias("body_chars"))


_NORM = "trim(regexp_replace(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')), '\\s+', ' ', 'g'))"
_BIG = "list_distinct(list_filter(string_split({}, ' '), lambda w: strlen(w) > 3))"


def _match_sql(a: str, b: str) -> str:
    x, y = _NORM.format(a), _NORM.format(b)
    wx, wy = _BIG.format(x), _BIG.format(y)
    return f"coalesce({a} <> '' AND {b} <> '' AND (contains({x}, {y}) OR contains({y}, {x}) OR (len({wx}) > 0 AND len({wy}) > 0 AND 2 * len(list_intersect({wx}, {wy})) >= least(len({wx}), len({wy})))), false)"


@query(f"SELECT a.conv_id, a.turn, {_match_sql('a.text', 'b.text')} AS matched FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def text_match(spark, sf_dir):
    from recollect.functions.text import text_match as match

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", match(F.col("text"), F.col("after")).alias("matched"))


@query(f"""
    WITH {_ANSWERS}, blocks AS (SELECT conv_id * 1000 + turn AS probe, 'b' || conv_id AS block_id, text FROM conversations), gold AS (SELECT conv_id * 1000 + turn AS probe, text, turn % 4 = 3 AS forbidden FROM conversations),
    r AS (SELECT a.probe, probe % 1000 = 1 AS want, abstained, CASE WHEN used LIKE '%,b1' AND used <> 'b1,b1' THEN 'b1' ELSE '' END AS fraud, CASE WHEN used <> '' AND NOT forbidden AND {_match_sql('g.text', 'b.text')} THEN 1 ELSE 0 END AS gold_supported,
        CASE WHEN forbidden THEN 0 ELSE 1 END AS n_gold, strlen(b.text) // 4 AS est_tokens, NOT forbidden AND {_match_sql('g.text', 'a.body')} AS asserts, forbidden AND {_match_sql('g.text', 'a.body')} AS bad
        FROM answers a JOIN blocks b USING (probe) JOIN gold g USING (probe))
    SELECT probe, fraud, gold_supported, n_gold, est_tokens, NOT want AND asserts AND gold_supported > 0 AS fact_hit, NOT want AND asserts AND gold_supported = 0 AS leak, CASE WHEN want THEN abstained AND NOT asserts AND NOT (NOT asserts AND bad) END AS abstain_ok,
        NOT asserts AND bad AS forbidden_asserted, fraud = '' AND NOT (NOT asserts AND bad) AND CASE WHEN want THEN abstained AND NOT asserts AND NOT bad WHEN n_gold = 0 THEN true ELSE asserts AND gold_supported > 0 END AS passed FROM r
""")
def score_citations(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("probe", F.col("conv_id") * 1000 + F.col("turn"))
    answers = evaluate.parse_citations(_answers(spark, sf_dir)).withColumn("expect_abstain", F.col("probe") % 1000 == 1)
    blocks = rows.select("probe", F.concat(F.lit("b"), "conv_id").alias("block_id"), "text")
    gold = rows.select("probe", "text", (F.col("turn") % 4 == 3).alias("forbidden"))
    return evaluate.score_citations(answers, blocks, gold).drop("n_presented").withColumn("fraud", F.array_join("fraud", ","))


@query(f"WITH b AS (SELECT conv_id AS probe, string_agg(text, ' ' ORDER BY turn, text) AS blob FROM conversations GROUP BY conv_id), f AS (SELECT conv_id + turn % 2 AS probe, text FROM conversations) SELECT probe, count(*) FILTER (WHERE contains({_NORM.format('blob')}, {_NORM.format('f.text')})) AS leaks FROM b JOIN f USING (probe) GROUP BY probe")
def leak_check(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    blobs = rows.groupBy(F.col("conv_id").alias("probe")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("blob"))
    return evaluate.leak_check(blobs, rows.select((F.col("conv_id") + F.col("turn") % 2).alias("probe"), "text"))


_W = "list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) > 3))"


@query(f"""
    WITH e AS (SELECT conv_id AS scenario, text FROM conversations WHERE turn = 0), g AS (SELECT conv_id AS scenario, turn AS idx, CASE turn % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'supersede' ELSE 'forget' END AS op, text FROM conversations),
    w AS (SELECT g.*, {_W.format(_NORM.format('g.text'))} AS w, {_W.format(_NORM.format('e.text'))} AS ew FROM g JOIN e USING (scenario))
    SELECT scenario, idx, CASE WHEN op IN ('put', 'supersede') THEN CASE WHEN len(list_intersect(w, ew)) >= 3 OR 2 * len(list_intersect(w, ew)) >= len(w) THEN 'put' ELSE 'noop' END ELSE op END AS op FROM w
""")
def extract_gold(spark, sf_dir):
    t = F.col("turn")
    rows = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "scenario")
    gold = rows.select("scenario", t.alias("idx"), F.when(t % 3 == 0, "put").when(t % 3 == 1, "supersede").otherwise("forget").alias("op"), "text")
    return evaluate.extract_gold(gold, rows.where("turn = 0").select("scenario", "text")).select("scenario", "idx", "op")


@query(f"""
    WITH RECURSIVE p AS (SELECT conv_id AS scenario, turn AS p, text AS said FROM conversations), g AS (SELECT conv_id AS scenario, turn AS g, text AS want FROM conversations WHERE turn % 2 = 0),
    o AS MATERIALIZED (SELECT scenario, g, p, row_number() OVER (PARTITION BY scenario ORDER BY g, p) AS i FROM g JOIN p USING (scenario) WHERE {_match_sql('want', 'said')}),
    f AS (SELECT DISTINCT scenario, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ps FROM p
        UNION ALL SELECT f.scenario, o.i, CASE WHEN list_contains(gs, g) OR list_contains(ps, p) THEN gs ELSE list_append(gs, g) END, CASE WHEN list_contains(gs, g) OR list_contains(ps, p) THEN ps ELSE list_append(ps, p) END
        FROM f JOIN o ON o.scenario = f.scenario AND o.i = f.i + 1),
    m AS (SELECT scenario, max(len(gs)) AS matched FROM f GROUP BY scenario), n AS (SELECT scenario, count(*) AS n_pred, (SELECT count(*) FROM g WHERE g.scenario = p.scenario) AS n_gold FROM p GROUP BY scenario)
    SELECT scenario, matched, n_pred, n_gold, CASE WHEN n_pred = 0 THEN 1.0::DOUBLE ELSE matched / n_pred::DOUBLE END AS precision, CASE WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE matched / n_gold::DOUBLE END AS recall FROM n JOIN m USING (scenario)
""")
def score_extraction(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scenario"), F.col("turn").alias("idx"), F.lit("put").alias("op"), "text")
    gold = rows.where("idx % 2 = 0")
    return evaluate.score_extraction(rows, gold)


@query("""
    WITH c AS (SELECT DISTINCT conv_id AS s FROM conversations), m AS (SELECT conv_id AS s, 'k' || turn % 5 AS key, list_extract(['episodic', 'semantic', 'odd'], turn % 3 + 1) AS category, CASE WHEN turn % 4 = 3 THEN 'soon' ELSE '2024-01-0' || (turn % 9 + 1) END AS since FROM conversations),
    p AS (SELECT conv_id AS s, 'p' || turn // 2 AS probe, 'k' || turn % 7 AS key, turn % 6 = 5 AS abstain FROM conversations),
    v AS (SELECT s, 'repeated_scenario' AS violation FROM c WHERE s % 10 = 0 UNION SELECT s, 'repeated_key' FROM m GROUP BY s, key HAVING count(*) > 1 UNION SELECT s, 'repeated_probe' FROM p GROUP BY s, probe HAVING count(*) > 1
        UNION SELECT s, 'unknown_key' FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = p.s AND m.key = p.key) UNION SELECT s, 'abstain_expects' FROM p WHERE abstain UNION SELECT s, 'unknown_category' FROM m WHERE category = 'odd'
        UNION SELECT s, 'bad_valid_from' FROM m WHERE since = 'soon' UNION SELECT NULL, 'no_exemplar:echo')
    SELECT s AS scenario, violation FROM v
""")
def validate_scenarios(spark, sf_dir):
    s, t = F.col("conv_id").alias("scenario"), F.col("turn")
    rows = read(spark, sf_dir, "conversations")
    scenarios = rows.select(s, F.lit("drift").alias("pattern")).distinct()
    scenarios = scenarios.unionByName(scenarios.where("scenario % 10 = 0"))
    key = lambda n: F.concat(F.lit("k"), t % n)
    gold = rows.select(s, key(5).alias("key"), F.element_at(F.lit(["episodic", "semantic", "odd"]), (t % 3 + 1).cast("int")).alias("category"), F.when(t % 4 == 3, "soon").otherwise(F.concat(F.lit("2024-01-0"), t % 9 + 1)).alias("valid_from"))
    probes = rows.select(s, F.concat(F.lit("p"), F.floor(t / 2)).alias("probe"), F.array(key(7)).alias("expect"), F.array().cast("array<string>").alias("forbid"), (t % 6 == 5).alias("abstain"))
    return evaluate.validate_scenarios(scenarios, gold, probes, ("drift", "echo"))


def _packed_sql(source: str, cost: str) -> str:
    """CTE packed (query_id, rank1, id, form, used) over hits: first whole cards in rank order, then stubs, each step with the room that is left."""
    return f"""
    c AS MATERIALIZED (SELECT query_id, rank1, id, {cost} AS cost, row_number() OVER (PARTITION BY query_id ORDER BY rank1) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM {source}),
    f AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST(4800 AS BIGINT) AS room, CAST([] AS BIGINT[]) AS cards, CAST([] AS BIGINT[]) AS stubs FROM c
        UNION ALL SELECT f.query_id, i + 1, room - CASE WHEN len(cards) + len(stubs) >= 8 THEN 0 WHEN i < n AND cost <= room THEN cost WHEN i >= n AND NOT list_contains(cards, place) AND room >= 64 THEN 64 ELSE 0 END,
            CASE WHEN len(cards) + len(stubs) < 8 AND i < n AND cost <= room THEN list_append(cards, place) ELSE cards END,
            CASE WHEN len(cards) + len(stubs) < 8 AND i >= n AND NOT list_contains(cards, place) AND room >= 64 THEN list_append(stubs, place) ELSE stubs END
        FROM f JOIN c ON c.query_id = f.query_id AND c.place = i % n + 1 WHERE i < 2 * n),
    packed AS (SELECT c.query_id, rank1, id, CASE WHEN list_contains(cards, place) THEN 'card' ELSE 'stub' END AS form, CASE WHEN list_contains(cards, place) THEN cost ELSE 64 END AS used
        FROM c JOIN f ON f.query_id = c.query_id AND f.i = 2 * n WHERE list_contains(cards, place) OR list_contains(stubs, place))"""


@query(f"WITH RECURSIVE {_HITS}, {_packed_sql('hits', 'strlen(text)')} SELECT * FROM packed")
def pack_context(spark, sf_dir):
    _, hits = _hits(spark, sf_dir)
    return packs.pack_context(hits)


@query(f"""
    WITH RECURSIVE {_HITS}, {_packed_sql('hits', 'strlen(text)')}, per AS (SELECT query_id, count(*) AS cards, CAST(ceil(sum(used) / 4.0) AS BIGINT) AS est_tokens FROM packed GROUP BY query_id)
    SELECT query_id, coalesce(cards, 0) AS cards, coalesce(est_tokens, 0) AS est_tokens, cards IS NULL AS abstained FROM probes LEFT JOIN per USING (query_id)
""")
def pack_summary(spark, sf_dir):
    asked, hits = _hits(spark, sf_dir)
    return packs.pack_summary(asked, packs.pack_context(hits))


@query(f"""
    WITH {_HITS}, inv AS (SELECT query_id, id, CASE WHEN query_id % 2 = 0 THEN version END AS v FROM hits WHERE rank1 % 3 = 0)
    SELECT query_id, id, rank1, CASE WHEN inv.id IS NOT NULL THEN 'already_in_context' WHEN score < 3 THEN 'below_floor' ELSE 'candidate' END AS disposition FROM hits LEFT JOIN inv USING (query_id, id)
""")
def dispositions(spark, sf_dir):
    _, hits = _hits(spark, sf_dir)
    inventory = hits.where("rank1 % 3 = 0").select("query_id", "id", F.when(F.col("query_id") % 2 == 0, F.col("version")).alias("version"))
    return packs.dispositions(hits, inventory, 3.0).select("query_id", "id", "rank1", "disposition")


@query(f"""
    WITH RECURSIVE {_HITS}, able AS (SELECT * FROM hits WHERE rank1 % 3 <> 0 AND score >= 1), {_packed_sql('able', 'strlen(text) + 64')},
    blocks AS (SELECT query_id, rank1, sha256(id || '|' || version || '|' || sha256(CASE WHEN form = 'card' THEN text ELSE '' END)) AS block_id FROM packed JOIN hits USING (query_id, id, rank1)),
    per AS (SELECT query_id, count(*) AS n_blocks, sha256(string_agg(block_id, ',' ORDER BY rank1)) AS proposal_id FROM blocks GROUP BY query_id),
    counts AS (SELECT query_id, count(*) AS n_hits, count(*) FILTER (WHERE rank1 % 3 <> 0 AND score >= 1) AS n_able FROM hits GROUP BY query_id)
    SELECT query_id, n_hits, n_able, coalesce(n_blocks, 0) AS n_blocks, proposal_id,
        CASE WHEN n_able = 0 THEN 'insufficient_evidence' WHEN n_blocks IS NULL THEN 'budget_exhausted' WHEN n_blocks < n_able THEN 'partial' ELSE 'ready' END AS status FROM counts LEFT JOIN per USING (query_id)
""")
def prepare_context(spark, sf_dir):
    _, hits = _hits(spark, sf_dir)
    inventory = hits.where("rank1 % 3 = 0").select("query_id", "id", "version")
    return packs.prepare_context(hits, inventory, 1.0)[1]


@query(f"WITH {_HITS} SELECT query_id, string_agg(CASE WHEN rank1 % 2 = 0 THEN text ELSE '' END, chr(10) || chr(10) ORDER BY rank1) AS text FROM hits GROUP BY query_id")
def render_blocks(spark, sf_dir):
    _, hits = _hits(spark, sf_dir)
    return packs.render_blocks(hits.select("query_id", "rank1", F.when(F.col("rank1") % 2 == 0, F.col("text")).otherwise("").alias("excerpt")))


@query("""
    WITH a AS (SELECT o_orderkey AS seq, o_custkey AS p, CASE WHEN o_orderkey % 5 = 0 THEN ['b0'] WHEN o_orderkey % 11 = 0 THEN ['zz'] ELSE ['b0', 'b1'] END AS i FROM orders),
    c AS (SELECT *, CASE WHEN p % 4 = 0 THEN 'unknown_proposal' WHEN i = ['zz'] THEN 'fabricated_block' END AS reason FROM a),
    f AS (SELECT *, row_number() OVER w AS n, first_value(i) OVER w AS first FROM c WINDOW w AS (PARTITION BY p, reason IS NULL ORDER BY seq))
    SELECT seq, p AS proposal_id, coalesce(reason, CASE WHEN n = 1 THEN 'accepted' WHEN i = first THEN 'replayed' ELSE 'conflict' END) AS status FROM f
""")
def verify_insertions(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf_dir, "orders")
    acks = rows.select(k.alias("seq"), p.alias("proposal_id"), F.when(k % 5 == 0, F.array(F.lit("b0"))).when(k % 11 == 0, F.array(F.lit("zz"))).otherwise(F.array(F.lit("b0"), F.lit("b1"))).alias("inserted"))
    selected = rows.where(p % 4 != 0).select(p.alias("proposal_id"), F.explode(F.array(F.lit("b0"), F.lit("b1"), F.lit("b2"))).alias("block_id")).distinct()
    return packs.verify_insertions(acks, selected)


@query(f"WITH {MEMORIES} SELECT item_id AS probe, id AS key FROM benchmark b JOIN memories m ON contains(m.text, b.text)")
def passage_gold(spark, sf_dir):
    from recollect.sources.derived import memories

    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("probe"), F.col("text").alias("query"))
    return evaluate.passage_gold(passages, memories(spark, sf_dir))


@query(f"""
    WITH {MEMORIES}, {PROBES}, {VISIBLE}, {bm25_sql()}, h AS ({_top('scored SEMI JOIN visible USING (query_id, id)', 8)}), g AS (SELECT item_id AS query_id, id FROM benchmark b JOIN memories m ON contains(m.text, b.text)),
    s AS (SELECT query_id, (SELECT count(*) FROM h WHERE h.query_id = p.query_id) AS n, (SELECT count(*) FROM h JOIN g USING (query_id, id) WHERE h.query_id = p.query_id) AS found, (SELECT count(*) FROM g WHERE g.query_id = p.query_id) AS expected FROM probes p)
    SELECT query_id AS probe, CASE WHEN expected = 0 THEN n = 0 ELSE found = expected END AS hit, CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE round(found / expected::DOUBLE, 6) END AS recall FROM s
""")
def run_probes(spark, sf_dir):
    asked, rows = _asked(spark, sf_dir)
    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("probe"), F.col("text").alias("query"))
    out = evaluate.run_probes(asked, rows, evaluate.passage_gold(passages, rows), 8)
    return out.select("probe", "hit", F.round("recall", 6).alias("recall"))


@query("""
    WITH v AS (SELECT event_type AS system, list_sort(list(value)) AS v, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS passed, count(*) FILTER (WHERE user_id % 3 = 0) AS fact_hits FROM events GROUP BY event_type)
    SELECT system, n, passed, fact_hits, v[len(v) // 2 + 1] AS p50, v[len(v) * 95 // 100 + 1] AS p95, v[len(v)] AS max FROM v
""")
def system_stats(spark, sf_dir):
    u = F.col("user_id")
    return evaluate.system_stats(read(spark, sf_dir, "events").select(F.col("event_type").alias("system"), F.col("value").alias("ms"), (u % 2 == 0).alias("passed"), (u % 3 == 0).alias("fact_hit")))


_NORMAL = r"trim(regexp_replace(lower(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}}\s]', '', 'g')), '\s+', ' ', 'g'))"
_BY_TEXT = f"""
    a AS (SELECT doc_id, {_NORMAL.format('text')} AS a FROM documents), b AS (SELECT item_id, {_NORMAL.format('text')} AS b FROM benchmark),
    t AS (SELECT doc_id, 'b' || min(item_id) AS key FROM a JOIN b ON a <> '' AND (contains(a, b) OR contains(b, a)) GROUP BY doc_id)
"""


def _passages(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("b"), "item_id").alias("key"), "text")


@query(f"WITH {_BY_TEXT} SELECT doc_id AS hit, key FROM t")
def text_gold(spark, sf_dir):
    """The first benchmark passage that each document contains, or is contained in."""
    return by_text.text_gold(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("hit"), "text"), _passages(spark, sf_dir))


@query(f"""
    WITH {_BY_TEXT}, h AS (SELECT doc_id, doc_id // 10 AS probe, doc_id % 10 + 1 AS rank1, CASE WHEN doc_id % 3 = 0 THEN 'b' || doc_id % 40 ELSE key END AS key FROM documents LEFT JOIN t USING (doc_id)),
    p AS (SELECT DISTINCT probe, 'b' || probe % 40 AS expect, 'b' || (probe + 1) % 40 AS forbid, probe % 11 = 0 AS abstain, CASE WHEN probe % 7 = 0 THEN 'multi_hop' ELSE 'exact' END AS tag FROM h),
    g AS (SELECT probe, list(key) FILTER (WHERE key IS NOT NULL) AS keys FROM h WHERE rank1 <= 8 GROUP BY probe),
    c AS (SELECT p.*, list_contains(coalesce(keys, []), expect) AS found, list_contains(coalesce(keys, []), forbid) AS leaked FROM p JOIN g USING (probe))
    SELECT probe, tag = 'multi_hop' AS skipped, tag <> 'multi_hop' AND NOT leaked AND NOT abstain AND found AS hit, CASE WHEN tag <> 'multi_hop' AND found THEN 1.0::DOUBLE ELSE 0 END AS recall FROM c
""")
def score_by_text(spark, sf_dir):
    """Runs of ten documents as hits, two of three without a key, scored against passages."""
    d, p = F.col("doc_id"), F.col("probe")
    b = lambda n: F.array(F.concat(F.lit("b"), n % 40))
    hits = read(spark, sf_dir, "documents").select(F.floor(d / 10).alias("probe"), (d % 10 + 1).alias("rank1"), F.when(d % 3 == 0, F.concat(F.lit("b"), d % 40)).alias("key"), "text")
    probes = hits.select("probe").distinct().select(p, b(p).alias("expect"), b(p + 1).alias("forbid"), (p % 11 == 0).alias("abstain"), F.when(p % 7 == 0, "multi_hop").otherwise("exact").alias("tag"))
    return by_text.score_by_text(hits, probes, _passages(spark, sf_dir), 8).select("probe", "skipped", "hit", "recall")
