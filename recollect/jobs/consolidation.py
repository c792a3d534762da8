"""Consolidation and ingest over the derived memories and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.text import FACT_CUES, NEGATIONS, STOP_WORDS, WRITER_CUES
from recollect.jobs.registry import query
from recollect.operators import consolidate, ingest
from recollect.sources.derived import MEMORIES, TRACES, memories, read, trace_events

AT = "2024-02-01 12:00:00"


def now():
    return F.lit(AT).cast("timestamp_ntz")
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_any = lambda text, cues: " OR ".join(f"contains({text}, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues)


def _small(spark, sf_dir):
    """Memories in fewer, larger scopes: near-duplicates share a language."""
    return memories(spark, sf_dir).withColumn("scope", F.concat(F.lit("org/"), F.substring_index("scope", "/", -1))).withColumn("category", F.when(F.col("n") % 5 == 4, "uncertainty").otherwise("semantic"))


_PAIRS = f"""
    t AS (SELECT id, n, 'org/' || string_split(scope, '/')[3] AS scope, text, valid_from, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_quoted(STOP_WORDS)})))) AS tokens FROM memories WHERE n % 5 <> 4),
    s AS (SELECT *, first_value(id) OVER w AS rep FROM t WHERE len(tokens) > 0 WINDOW w AS (PARTITION BY scope, tokens ORDER BY strlen(text) DESC, valid_from DESC, id DESC)),
    r AS (SELECT * FROM s WHERE id = rep), x AS (SELECT id, scope, unnest(tokens) AS token FROM r),
    c AS (SELECT a.id AS ia, b.id AS ib, count(*) AS common FROM x a JOIN x b ON a.token = b.token AND a.scope = b.scope AND a.id < b.id GROUP BY a.id, b.id),
    j AS (SELECT a.*, b.id AS id_b, b.text AS text_b, b.valid_from AS from_b, common / (len(a.tokens) + len(b.tokens) - common)::DOUBLE AS jaccard FROM c JOIN t a ON a.id = ia JOIN t b ON b.id = ib),
    p AS (SELECT scope, CASE WHEN k THEN id ELSE id_b END AS keep, CASE WHEN k THEN id_b ELSE id END AS drop, jaccard, CASE WHEN valid_from > from_b OR (valid_from = from_b AND id > id_b) THEN id ELSE id_b END AS earlier
        FROM (SELECT *, strlen(text) > strlen(text_b) OR (strlen(text) = strlen(text_b) AND (valid_from > from_b OR (valid_from = from_b AND id > id_b))) AS k FROM j WHERE jaccard >= 0.6)
        UNION ALL SELECT s.scope, s.rep, s.id, 1.0, CASE WHEN s.valid_from > r.valid_from OR (s.valid_from = r.valid_from AND s.id > s.rep) THEN s.id ELSE s.rep END FROM s JOIN r ON r.id = s.rep WHERE s.id <> s.rep)"""


@query(f"WITH {MEMORIES}, {_PAIRS} SELECT keep, drop, round(jaccard, 6) AS jaccard FROM p")
def near_duplicates(spark, sf_dir):
    return consolidate.near_duplicates(_small(spark, sf_dir)).select("keep", "drop", F.round("jaccard", 6).alias("jaccard"))


_neg = lambda text: "(" + _any(f"(' ' || lower({text}) || ' ')", NEGATIONS) + ")"
_val = lambda text: f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: regexp_matches(w, '[0-9]'))))"


@query(f"""
    WITH p AS (SELECT a.conv_id, a.turn, a.text || CASE WHEN a.turn % 3 = 0 THEN ' do not 30s' ELSE ' 60s' END AS a, b.text || ' 60s' AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, {_neg('a')} <> {_neg('b')} OR (len({_val('a')}) > 0 AND len({_val('b')}) > 0 AND {_val('a')} <> {_val('b')}) AS conflict FROM p
""")
def possible_conflict(spark, sf_dir):
    from recollect.functions.text import contradicts

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.concat("text", F.lit(" 60s")).alias("b"))
    a = F.concat("text", F.when(F.col("turn") % 3 == 0, " do not 30s").otherwise(" 60s"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", contradicts(a, F.col("b")).alias("conflict"))


@query(f"""
    WITH RECURSIVE {MEMORIES}, {_PAIRS}, o AS MATERIALIZED (SELECT scope || '|semantic' AS grp, row_number() OVER (PARTITION BY scope ORDER BY earlier, keep, drop) AS pos, keep, drop FROM p),
    f AS (SELECT grp, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS kept, CAST([] AS VARCHAR[]) AS dropped FROM (SELECT DISTINCT grp FROM o)
        UNION ALL SELECT f.grp, o.pos, CASE WHEN list_contains(kept, drop) OR list_contains(dropped, keep) OR list_contains(dropped, drop) THEN kept ELSE list_append(kept, keep) END,
            CASE WHEN list_contains(kept, drop) OR list_contains(dropped, keep) OR list_contains(dropped, drop) THEN dropped ELSE list_append(dropped, drop) END FROM f JOIN o ON o.grp = f.grp AND o.pos = f.pos + 1),
    l AS (SELECT grp, kept, dropped FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY pos DESC) = 1), u AS (SELECT grp, unnest(kept) AS keep, unnest(dropped) AS drop FROM l)
    SELECT u.grp AS "group", pos, u.keep, u.drop FROM u JOIN o ON o.grp = u.grp AND o.keep = u.keep AND o.drop = u.drop
""")
def select_proposals(spark, sf_dir):
    pairs = consolidate.near_duplicates(_small(spark, sf_dir)).withColumn("group", F.concat_ws("|", "scope", "category"))
    return consolidate.select_proposals(consolidate.numbered(pairs))


@query(f"WITH {MEMORIES} SELECT id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS preview FROM memories WHERE category = 'episodic' AND valid_from <= DATE '2024-02-01' - INTERVAL 31 DAYS")
def age_out(spark, sf_dir):
    return consolidate.age_out(memories(spark, sf_dir), now(), 31).select("id", "preview")


@query(f"WITH {MEMORIES} SELECT 'age_out_episodic' AS op, id, 'review' AS reason FROM memories WHERE category = 'episodic'")
def sleep_report(spark, sf_dir):
    return consolidate.sleep_report(memories(spark, sf_dir), now(), None)[0]


@query(f"WITH {MEMORIES} SELECT scope, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE strlen(text) > 1024) AS oversized, count(*) > 512 OR sum(strlen(text)) > 262144 AS over FROM memories WHERE valid_until IS NULL GROUP BY scope")
def capacity_report(spark, sf_dir):
    return consolidate.capacity_report(memories(spark, sf_dir))


@query(f"WITH {MEMORIES} SELECT category AS scope, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS identity, count(*) AS n, min(id) AS first_id FROM memories WHERE valid_until IS NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_identities(spark, sf_dir):
    return consolidate.duplicate_identities(memories(spark, sf_dir).withColumn("scope", F.col("category")))


@query(f"WITH {MEMORIES}, {TRACES}, u AS (SELECT memory_id FROM trace_events WHERE kind = 'inject') SELECT id, 'soft_forget' AS kind FROM memories WHERE valid_until IS NULL AND valid_from + INTERVAL 7 DAYS <= TIMESTAMP '{AT}' AND id NOT IN (SELECT memory_id FROM u)")
def prune_probation(spark, sf_dir):
    from recollect.operators.traces import usage_stats

    return consolidate.prune_probation(memories(spark, sf_dir), usage_stats(trace_events(spark, sf_dir)), now())


@query(f"""
    WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'identity' END AS given, turn % 4 = 1 AS episodic, text || CASE WHEN turn % 4 = 2 THEN ' We always use it' ELSE '' END AS text FROM conversations),
    c AS (SELECT *, coalesce(given, CASE WHEN episodic THEN 'episodic' WHEN {_any('lower(text)', FACT_CUES)} THEN 'semantic' ELSE 'episodic' END) AS category FROM r)
    SELECT conv_id, turn, category, CASE WHEN turn = 3 THEN 'fact_update' WHEN category IN ('semantic', 'identity') THEN 'fact' ELSE 'episode' END AS kind FROM c
""")
def infer_category(spark, sf_dir):
    t = F.col("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.when(t % 4 == 2, " We always use it").otherwise("")))
    rows = rows.withColumn("category", ingest.infer_category(F.when(t % 4 == 0, "identity"), t % 4 == 1, F.col("text")))
    return rows.select("conv_id", "turn", "category", ingest.provenance_kind(F.col("category"), t == 3).alias("kind"))


_EPISODES = "episodes AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)"


@query(f"WITH {_EPISODES} SELECT conv_id, text FROM episodes")
def episodes_from_turns(spark, sf_dir):
    return ingest.episodes_from_turns(read(spark, sf_dir, "conversations"))


@query(f"""
    WITH {_EPISODES}, l AS (SELECT conv_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM episodes), x AS (SELECT conv_id, unnest(range(len(l))) AS idx, unnest(l) AS text FROM l)
    SELECT conv_id AS episode_id, CAST(idx AS INTEGER) AS idx, 'put' AS op, text, NOT ({_any('lower(text)', WRITER_CUES)}) AS episodic, 0.85::DOUBLE AS confidence FROM x
""")
def extract_ops(spark, sf_dir):
    return ingest.extract_ops(ingest.episodes_from_turns(read(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "episode_id"))


@query()
def parse_ops_text(spark, sf_dir):
    """Raw model texts around each turn: bare JSON, a fence, prose, an unknown field, none."""
    t, n = F.col("text"), F.col("turn") % 5
    put = F.to_json(F.struct(F.lit("put").alias("op"), F.lit("org/c").alias("scope"), t.alias("text")))
    odd = F.to_json(F.struct(F.lit("put").alias("op"), t.alias("extra")))
    raw = F.when(n == 0, F.concat(F.lit("["), put, F.lit("]"))).when(n == 1, F.concat(F.lit("Sure:\n```json\n"), put, F.lit("\n```"))).when(n == 2, F.concat(F.lit("I would "), put, F.lit(" then stop"))).when(n == 3, odd).otherwise(t)
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), raw.alias("text"))
    return ingest.parse_ops_text(rows)


@query(f"""
    WITH {_EPISODES}, l AS (SELECT conv_id, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS n, conv_id % 9 > 0 AND len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) <= 128 AS ok FROM episodes)
    SELECT conv_id AS batch_id, 'write' AS kind, n AS n_ops, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) <= 128 AS ok FROM episodes JOIN l USING (conv_id)
""")
def ingest_compaction(spark, sf_dir):
    episodes = ingest.episodes_from_turns(read(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("episode_id"), F.lit("org/c").alias("scope"), "text")
    summaries = episodes.select("episode_id", F.substring("text", 1, 40).alias("text"))
    return ingest.ingest_compaction(episodes, summaries)[1]
