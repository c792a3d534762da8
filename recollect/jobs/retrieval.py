"""Lexical, vector and hybrid retrieval of the probes over the derived memory table."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.text import QUERY_STOP_WORDS
from recollect.jobs.registry import query
from recollect.operators import fusion, lenses, lexical, neighbour_lists, vectors
from recollect.sources.derived import MEMORIES, PROBES, memories, probes, read
from recollect.sources.shared import saved

_FOLD = "lower(strip_accents({}))"
_TOKENS = "regexp_extract_all(lower(strip_accents({})), '\\p{{L}}+|\\p{{N}}+')"
VISIBLE = """
    visible AS (SELECT query_id, id FROM probes p JOIN memories m ON starts_with(m.scope, p.scope || '/')
        AND valid_from <= as_of AND (valid_until IS NULL OR valid_until > as_of))"""


def bm25_sql(queries: str = "probes", prefix: str = "") -> str:
    """CTEs ``{prefix}scored`` (query_id, id, score, matched, n_terms) over a relation of queries."""
    return f"""
    {prefix}asked AS (SELECT query_id, unnest(list_distinct(t)) AS term, len(list_distinct(t)) AS n_terms FROM (SELECT query_id, {_TOKENS.format('query')} AS t FROM {queries})),
    {prefix}docs AS (SELECT id, {_TOKENS.format('text')} AS t FROM memories),
    {prefix}stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_length FROM {prefix}docs),
    {prefix}tf AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM {prefix}docs)
        WHERE term IN (SELECT term FROM {prefix}asked) GROUP BY id, term),
    {prefix}df AS (SELECT term, count(*) AS df FROM {prefix}tf GROUP BY term),
    {prefix}scored AS (SELECT query_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score,
        count(*) AS matched, any_value(n_terms) AS n_terms FROM {prefix}asked JOIN {prefix}tf USING (term) JOIN {prefix}df USING (term), {prefix}stats GROUP BY query_id, id)"""


def _top(source: str, k: int, where: str = "TRUE") -> str:
    return f"""SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank1
        FROM {source} WHERE {where} QUALIFY rank1 <= {k}"""


def _asked(spark, sf_dir):
    return probes(spark, sf_dir), memories(spark, sf_dir)


@query(f"WITH {MEMORIES}, {PROBES}, {VISIBLE}, {bm25_sql()} SELECT query_id, id, round(score, 6) AS score, rank1 FROM ({_top('scored SEMI JOIN visible USING (query_id, id)', 8, 'matched = n_terms')})")
def bm25_search(spark, sf_dir):
    asked, rows = _asked(spark, sf_dir)
    return lexical.bm25_search(asked, rows, 8).select("query_id", "id", F.round("score", 6).alias("score"), "rank1")


@query(f"WITH {MEMORIES}, {PROBES}, {bm25_sql()} SELECT query_id, id, round(score, 6) AS score, rank1 FROM ({_top('scored', 20)})")
def bm25_any(spark, sf_dir):
    found = lexical.bm25_search(probes(spark, sf_dir).select("query_id", "query"), memories(spark, sf_dir), 20, "any")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank1")


_CATEGORIES = "CASE query_id % 3 WHEN 0 THEN ['semantic', 'identity'] WHEN 1 THEN ['episodic', 'procedural', 'uncertainty'] END"


@query(f"""
    WITH {MEMORIES}, p AS (SELECT item_id AS query_id, text AS query, {_CATEGORIES.replace('query_id', 'item_id')} AS categories, CASE WHEN item_id % 4 <> 3 THEN item_id % 4 + 1 END AS most FROM benchmark),
    visible AS (SELECT query_id, id, most FROM p JOIN memories m ON (categories IS NULL OR list_contains(categories, category)) AND valid_from <= TIMESTAMP '2024-01-20 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20 00:00:00')),
    {bm25_sql('p')}
    SELECT query_id, id, round(score, 6) AS score, rank1 FROM (SELECT query_id, id, score, most, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank1 FROM scored JOIN visible USING (query_id, id)) WHERE rank1 <= coalesce(most, 8)
""")
def bm25_by_category(spark, sf_dir):
    """Whole benchmark passages as queries, each with categories and a limit of its own, as of the present."""
    n = F.col("item_id")
    categories = F.when(n % 3 == 0, F.lit(["semantic", "identity"])).when(n % 3 == 1, F.lit(["episodic", "procedural", "uncertainty"]))
    asked = read(spark, sf_dir, "benchmark").select(n.alias("query_id"), F.col("text").alias("query"), categories.alias("categories"), F.when(n % 4 != 3, n % 4 + 1).alias("limit"))
    asked = lenses.at_present(asked, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return lexical.bm25_search(asked, memories(spark, sf_dir), 8, "any").select("query_id", "id", F.round("score", 6).alias("score"), "rank1")


@query(f"WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, array_to_string(t[1:12], ' ') AS first_tokens FROM t")
def analyze(spark, sf_dir):
    from recollect.functions.text import analyze as tokens

    rows = read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.slice("t", 1, 12), " ").alias("first_tokens"))


@query(f"""
    WITH {MEMORIES}, t AS (SELECT id, unnest({_TOKENS.format('text')}) AS term FROM memories), p AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term)
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most FROM p GROUP BY term
""")
def build_postings(spark, sf_dir):
    postings = lexical.build_postings(memories(spark, sf_dir))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


def _vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), "vec_id").alias("id"), "vec_id", "embedding")
    return rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), rows


@query("""
    WITH s AS (SELECT q.vec_id AS query_id, 'm' || e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
        FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank1 FROM s QUALIFY rank1 <= 10
""")
def knn_search(spark, sf_dir):
    asked, rows = _vectors(spark, sf_dir)
    return vectors.knn_search(asked, rows, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank1")


_NEAREST = """
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank1 FROM s QUALIFY rank1 <= 10
"""
_MIXED = """
    e AS (SELECT vec_id, 'm' || vec_id AS id, ['x', 'y', 'x/z'][vec_id % 3 + 1] AS scope, CAST(embedding AS DOUBLE[])[:CASE vec_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 3 ELSE 64 END] AS embedding FROM embeddings WHERE vec_id % 50 <> 7)
"""


@query(f"""
    WITH {_MIXED}, s AS (SELECT q.vec_id AS query_id, e.id, list_cosine_similarity(q.embedding, e.embedding) AS score FROM e q JOIN e ON q.vec_id % 30 < 2 AND len(q.embedding) = len(e.embedding)
        AND (e.scope = q.scope OR starts_with(e.scope, q.scope || '/')))
    {_NEAREST}
""")
def knn_search_mixed(spark, sf_dir):
    """Vectors of three dimensions, searched by queries of all three in their own scopes."""
    v = F.col("vec_id")
    scope = F.element_at(F.lit(["x", "y", "x/z"]), (v % 3 + 1).cast("int"))
    dim = F.when(v % 4 == 0, 16).when(v % 4 == 1, 3).otherwise(64)
    rows = read(spark, sf_dir, "embeddings").where(v % 50 != 7).select(v, F.concat(F.lit("m"), v).alias("id"), scope.alias("scope"), F.slice("embedding", F.lit(1), dim).alias("embedding"))
    asked = rows.where(v % 30 < 2).select(v.alias("query_id"), "embedding", "scope")
    return vectors.knn_search(asked, rows, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank1")


@query("""
    WITH s AS (SELECT q.vec_id AS query_id, 'm' || e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
        FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0)
    """ + _NEAREST)
def knn_search_blocked(spark, sf_dir):
    """By lists where there are enough vectors for them, else exact."""
    asked, rows = _vectors(spark, sf_dir)
    return neighbour_lists.knn_search_lists(asked, rows, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank1")


CLUSTERS = 200


def _clustered(spark, sf_dir):
    """A vector for each document, near one of 200 centres: means of the embeddings, dealt by number."""
    each = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % CLUSTERS).alias("centre"), F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("centre", "i").agg(F.avg("x").alias("x")).groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e"))
    centres = means.select("centre", vectors.unit(F.transform("e", lambda c: c["x"])).alias("e"))
    noise = lambda i: (F.pmod(F.xxhash64("doc_id", i), F.lit(2001)) - 1000) / 1000.0
    near = F.transform("e", lambda x, i: x + noise(i) * 0.1)
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % CLUSTERS).alias("centre"))
    rows = docs.join(F.broadcast(centres), "centre").select(F.concat(F.lit("m"), "doc_id").alias("id"), "doc_id", near.alias("embedding"))  # 200 rows
    return rows.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "embedding"), rows.drop("doc_id")


@query()
def knn_recall(spark, sf_dir):
    """Each query's recall by lists on clustered vectors, against the exact search, and the share of all rows that it was scored against."""
    asked, rows = _clustered(spark, sf_dir)
    asked, rows = saved(asked, "asked"), saved(rows, "clustered")
    lists = neighbour_lists.Lists(rows, rows.select(F.max(F.size("embedding"))).first()[0])
    recall = vectors.knn_recall(lists.search(asked, 10), vectors.knn_search(asked, rows, 10))
    return recall.join(lists.scored_pairs(asked), "query_id").select("query_id", "recall", (F.col("scored") / F.col("rows")).alias("share"))


@query()
def hash_embed(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", vectors.hash_embed(F.col("text"), 32).alias("v"))
    return rows.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x.cast("double"), 4)), ",").alias("vector"))


@query("SELECT vec_id, CASE WHEN embedding IS NULL THEN NULL WHEN len(embedding) = 0 THEN 'embedding_empty' WHEN len(embedding) <> 64 THEN 'embedding_dimension' "
       "WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'embedding_not_finite' END AS reason FROM embeddings")
def check_vectors(spark, sf_dir):
    return vectors.check_vectors(read(spark, sf_dir, "embeddings"), 64).select("vec_id", "reason")


@query("""
    WITH r AS (SELECT o_custkey AS query_id, o_orderkey % 3 AS list_no, 'd' || (o_orderkey % 40) AS id, o_orderdate, o_orderkey FROM orders),
    k AS (SELECT query_id, list_no, id, min(o_orderkey) AS k FROM r GROUP BY ALL),
    l AS (SELECT query_id, list_no, id, row_number() OVER (PARTITION BY query_id, list_no ORDER BY k) AS rank1 FROM k),
    f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank1)) AS score, min({'a': list_no, 'b': rank1}) AS first FROM l GROUP BY query_id, id)
    SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id) AS rank1 FROM f
""")
def rrf_fuse(spark, sf_dir):
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), (key % 3).alias("list_no"), F.concat(F.lit("d"), key % 40).alias("id"), key)
    rows = rows.groupBy("query_id", "list_no", "id").agg(F.min("o_orderkey").alias("k"))
    ranked = rows.withColumn("rank1", F.row_number().over(Window.partitionBy("query_id", "list_no").orderBy("k")))
    return fusion.rrf_fuse(ranked).select("query_id", "id", F.round("score", 9).alias("score"), "rank1")


_HYBRID = f"""
    WITH {MEMORIES}, {PROBES}, {VISIBLE}, {bm25_sql()},
    lex AS ({_top('scored SEMI JOIN visible USING (query_id, id)', 32, 'matched = n_terms')}),
    nears AS (SELECT v.query_id, v.id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
        FROM visible v JOIN embeddings q ON q.vec_id = v.query_id JOIN embeddings e ON v.id = 'm' || e.vec_id),
    near AS ({_top('nears', 32)}),
    both_ AS (SELECT query_id, id, rank1, 0 AS l FROM lex UNION ALL SELECT query_id, id, rank1, 1 FROM near),
    f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank1)) AS score, min({{'a': l, 'b': rank1}}) AS first, bool_or(l = 0) AS bm25, bool_or(l = 1) AS vector FROM both_ GROUP BY query_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id) AS rank1 FROM f)
    SELECT query_id, id, round(score, 9) AS score, rank1, bm25, vector FROM r WHERE rank1 <= 8
"""


@query(_HYBRID)
def hybrid_search(spark, sf_dir):
    asked, _ = _asked(spark, sf_dir)
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = asked.join(v.withColumnRenamed("vec_id", "query_id"), "query_id", "inner")
    rows = memories(spark, sf_dir, embeddings=True)
    return fusion.search(asked, rows, 8).select("query_id", "id", F.round("score", 9).alias("score"), "rank1", "bm25", "vector")


@query("""
    WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN ' ' ELSE text END AS query, e.embedding FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id AND b.item_id % 2 = 0)
    SELECT query_id, CASE WHEN trim(query) <> '' AND embedding IS NOT NULL THEN 'hybrid' WHEN trim(query) <> '' THEN 'bm25' WHEN embedding IS NOT NULL THEN 'knn' ELSE 'invalid' END AS channel FROM q
""")
def search_dispatch(spark, sf_dir):
    n = F.col("item_id")
    v = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("item_id"), "embedding")
    rows = read(spark, sf_dir, "benchmark").withColumn("query", F.when(n % 3 == 0, " ").otherwise(F.col("text"))).join(v, "item_id", "left")
    return rows.select(n.alias("query_id"), fusion.search_reason(F.col("query"), F.col("embedding")).alias("channel"))


_STOP = ", ".join(f"'{w}'" for w in QUERY_STOP_WORDS)
_REWRITE = f"""
    w AS (SELECT query_id, trim(query) AS q, list_filter(regexp_split_to_array(trim(query), '[^A-Za-z0-9]+'), lambda t: length(t) > 2 AND lower(t) NOT IN ({_STOP})) AS words FROM long_probes WHERE trim(query) <> ''),
    l AS (SELECT query_id, q, words, list_max(list_transform(words, lambda t, i: {{'n': length(t), 'i': i, 't': t}})) AS longest FROM w),
    vv AS (SELECT query_id, q, CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') END AS bag, CASE WHEN longest.n >= 6 THEN longest.t END AS long FROM l),
    v3 AS (SELECT query_id, list_filter([q, CASE WHEN bag <> q THEN bag END, CASE WHEN long <> q AND (bag IS NULL OR long <> bag) THEN long END], lambda x: x IS NOT NULL) AS v FROM vv),
    variants AS (SELECT query_id, unnest(range(len(v))) AS pass, unnest(v) AS query FROM v3)"""


@query(f"WITH long_probes AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_REWRITE} SELECT query_id, CAST(pass AS INTEGER) AS pass, query FROM variants")
def rewrite_queries(spark, sf_dir):
    return fusion.rewrite_queries(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


_HARD = f"""
    WITH {MEMORIES}, {PROBES}, {VISIBLE}, long_probes AS (SELECT * FROM probes), {_REWRITE}, keyed AS (SELECT query_id || '#' || pass AS query_id, query_id AS qid, pass, query FROM variants),
    {bm25_sql('keyed')}, sq AS (SELECT k.qid, k.pass, s.* FROM scored s JOIN keyed k USING (query_id) JOIN visible v ON v.query_id = k.qid AND v.id = s.id WHERE matched = n_terms),
    ranked AS (SELECT qid, pass, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank1 FROM sq),
    kept AS (SELECT * FROM ranked WHERE rank1 <= CASE WHEN pass = 0 THEN 8 ELSE 12 END),
    f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank1)) AS score, min({{'a': pass, 'b': rank1}}) AS first, max(score) AS pre FROM kept GROUP BY qid, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, id) AS rank1, FROM f), u AS (SELECT qid, count(DISTINCT pass) AS passes FROM kept GROUP BY qid),
    hits AS (SELECT qid AS query_id, id, rank1, CASE WHEN passes > 1 THEN score ELSE pre END AS score, pre AS pre_score FROM r JOIN u USING (qid) WHERE rank1 <= 8)"""


@query(f"{_HARD} SELECT query_id, id, rank1, round(score, 6) AS score, round(pre_score, 6) AS pre_score FROM hits")
def hard_recall(spark, sf_dir):
    asked, rows = _asked(spark, sf_dir)
    out = fusion.hard_recall(asked, rows)
    return out.select("query_id", "id", "rank1", F.round("score", 6).alias("score"), F.round("pre_score", 6).alias("pre_score"))


@query(f"{_HARD}, p AS (SELECT query_id, count(*) AS n, max(pre_score) AS best FROM hits GROUP BY query_id) SELECT query_id, coalesce(n, 0) AS n_hits, round(best, 6) AS best, coalesce(n, 0) < 1 OR coalesce(best, 0) < 2.0 AS abstained FROM probes LEFT JOIN p USING (query_id)")
def abstain(spark, sf_dir):
    asked, rows = _asked(spark, sf_dir)
    hits = fusion.hard_recall(asked, rows)
    return fusion.abstain(asked, hits, 1, 2.0, "pre_score").withColumn("best", F.round("best", 6))


@query(f"""
    WITH {MEMORIES}, {PROBES}, {VISIBLE}, {bm25_sql()}, r1 AS ({_top('scored SEMI JOIN visible USING (query_id, id)', 6)}),
    extra AS (SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 4)))[1:4], ' ') AS extra FROM r1 JOIN memories USING (id) WHERE rank1 = 1),
    again AS (SELECT query_id, query || ' ' || extra AS query FROM probes JOIN extra USING (query_id)), {bm25_sql('again', 'b_')},
    r2 AS ({_top('b_scored SEMI JOIN visible USING (query_id, id)', 6)}), u AS (SELECT query_id, id, 1 AS round, rank1 FROM r1 UNION ALL SELECT query_id, id, 2, rank1 FROM r2),
    m AS (SELECT query_id, id, min({{'a': round, 'b': rank1}}) AS place FROM u GROUP BY query_id, id)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank1, place.a AS round FROM m QUALIFY rank1 <= 6
""")
def iterative_requery(spark, sf_dir):
    asked, rows = _asked(spark, sf_dir)
    return fusion.iterative_requery(asked, rows, 6)


@query(f"""
    WITH h AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank1, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 1e6 WHEN o_orderkey % 4 = 1 THEN 0.0 END AS rrf,
        CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1e3 END AS bm25, CASE WHEN o_orderkey % 5 = 0 THEN 0.25 END AS distance, o_orderkey FROM orders)
    SELECT o_orderkey, round(coalesce(nullif(rrf, 0), nullif(bm25, 0), 1 / (1 + distance), 1.0::DOUBLE / (60 + rank1)), 9) AS score,
        CASE WHEN nullif(rrf, 0) IS NULL AND nullif(bm25, 0) IS NULL AND distance IS NULL THEN 'rank_fallback' ELSE 'engine' END AS score_kind,
        distance IS NOT NULL AS vector, bm25 IS NOT NULL AS lexical FROM h
""")
def label_scores(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    hits = read(spark, sf_dir, "orders").select(
        k, F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).alias("rank1"), F.when(k % 4 == 0, F.col("o_totalprice") / 1e6).when(k % 4 == 1, 0.0).alias("rrf"),
        F.when(k % 3 == 0, F.col("o_totalprice") / 1e3).alias("bm25"), F.when(k % 5 == 0, F.lit(0.25)).alias("distance"),
    )
    out = lexical.label_scores(hits)
    return out.select("o_orderkey", F.round("score", 9).alias("score"), "score_kind", F.col("distance").isNotNull().alias("vector"), F.col("bm25").isNotNull().alias("lexical"))


@query("""
    WITH h AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS rrf, o_orderkey % 3 = 0 AS bm25, o_orderkey % 5 = 0 AS distance FROM orders)
    SELECT o_orderkey, distance OR (rrf AND NOT bm25 AND NOT distance AND o_orderkey % 7 > 2) AS vector, bm25 OR (rrf AND NOT bm25 AND NOT distance) AS lexical FROM h
""")
def channel_signals(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n: F.when(k % n == 0, F.lit(0.5))
    hits = read(spark, sf_dir, "orders").select(k, some(2).alias("rrf"), some(3).alias("bm25"), some(5).alias("distance"))
    return fusion.channel_signals(hits, k % 7 > 2, F.lit(True)).select("o_orderkey", "vector", "lexical")


@query(f"""
    WITH {MEMORIES}, {PROBES}, v AS (SELECT query_id, id FROM probes p JOIN memories m ON starts_with(m.scope, p.scope || '/') AND valid_from <= TIMESTAMP '2024-02-20 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-20 00:00:00')), {bm25_sql()}
    SELECT query_id, id, round(score, 6) AS score, rank1 FROM ({_top('scored SEMI JOIN v USING (query_id, id)', 8)})
""")
def find_candidates(spark, sf_dir):
    out = fusion.find_candidates(probes(spark, sf_dir), memories(spark, sf_dir), F.lit("2024-02-20 00:00:00").cast("timestamp_ntz"))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank1")
