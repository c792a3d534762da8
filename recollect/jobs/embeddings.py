"""Embedding generations and artifacts over the vectors and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.jobs.registry import query
from recollect.operators import artifacts, embedders, fusion, generations, vectors
from recollect.operators.vectors import hash_embed
from recollect.sources import tables
from recollect.sources.derived import MEMORIES, memories, read
from recollect.sources.shared import shared_path

_ITEMS = """
    items AS (SELECT vec_id AS seq, 1 AS generation, CASE WHEN vec_id % 9 = 0 THEN 'x' || vec_id ELSE 'm' || (vec_id // 2) END AS id, vec_id % 7 = 0 AS short FROM embeddings),
    known AS (SELECT 'm' || doc_id AS id FROM documents)"""


def _items(spark, sf_dir):
    v = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select(
        v.alias("seq"), F.lit(1).alias("generation"), F.when(v % 9 == 0, F.concat(F.lit("x"), v)).otherwise(F.concat(F.lit("m"), F.floor(v / 2))).alias("id"),
        F.when(v % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"),
    )
    return rows, memories(spark, sf_dir, embeddings=True)


@query(f"WITH {_ITEMS} SELECT seq, CASE WHEN k.id IS NULL THEN 'unknown_memory' WHEN short THEN 'embedding_dimension' ELSE 'staged' END AS status FROM items LEFT JOIN known k USING (id)")
def stage_embeddings(spark, sf_dir):
    items, rows = _items(spark, sf_dir)
    return generations.stage_embeddings(items.limit(0), items, rows, 64)[1].select("seq", "status")


_STAGED = f"{_ITEMS}, staged AS (SELECT DISTINCT id FROM items SEMI JOIN known USING (id) WHERE NOT short), embedded AS (SELECT 'm' || doc_id AS id FROM documents SEMI JOIN embeddings ON vec_id = doc_id)"


@query(f"WITH {_STAGED} SELECT id FROM embedded ANTI JOIN staged USING (id)")
def generation_coverage(spark, sf_dir):
    items, rows = _items(spark, sf_dir)
    vectors, _ = generations.stage_embeddings(items.limit(0), items, rows, 64)
    return generations.generation_coverage(rows, vectors, 1)


@query(f"WITH {_STAGED} SELECT 1 AS generation, count(s.id) AS embedded, count(*) AS expected, round(count(s.id) / count(*)::DOUBLE, 6) AS coverage FROM embedded LEFT JOIN staged s USING (id)")
def embedded_count(spark, sf_dir):
    items, rows = _items(spark, sf_dir)
    vectors, _ = generations.stage_embeddings(items.limit(0), items, rows, 64)
    return generations.embedded_count(rows, vectors).withColumn("coverage", F.round("coverage", 6))


@query("SELECT 'm' || doc_id AS id, 2 AS embedding_generation, list_reverse(embedding)[1] AS first FROM documents JOIN embeddings ON vec_id = doc_id")
def activate_generation(spark, sf_dir):
    rows = memories(spark, sf_dir, embeddings=True).withColumn("embedding_generation", F.lit(1).cast("long"))
    vectors = rows.where("embedding IS NOT NULL").select(F.lit(2).alias("generation"), "id", F.reverse("embedding").alias("vector"))
    states = vectors.select("generation").distinct().withColumn("status", F.lit("building"))
    out, _ = generations.activate_generation(rows, vectors, states, 2)
    return out.where("embedding IS NOT NULL").select("id", "embedding_generation", F.element_at("embedding", 1).alias("first"))


@query()
def reindex(spark, sf_dir):
    out = generations.reindex(memories(spark, sf_dir), lambda text: hash_embed(text, 16), ["org/src0", "org/src1"], 3)
    return out.select("generation", "id", F.array_join(F.transform("vector", lambda x: F.round(x.cast("double"), 4)), ",").alias("vector"))


@query("""
    WITH g AS (SELECT n_nationkey AS generation, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'f' || n_nationkey % 2 END AS model, n_nationkey % 2 AS embedded FROM nation), c AS (SELECT c_custkey AS claim, CAST(c_custkey % 30 AS INTEGER) AS generation, 'f' || (c_custkey % 2) AS model FROM customer)
    SELECT claim, c.generation, CASE WHEN embedded IS NULL THEN 'not_found' WHEN g.model IS NULL AND embedded = 0 THEN 'adoptable' WHEN g.model IS NULL THEN 'unknown_identity' WHEN c.model = g.model THEN 'compatible' ELSE 'incompatible' END AS status FROM c LEFT JOIN g USING (generation)
""")
def identity_compatible(spark, sf_dir):
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    known = n % 3 != 0
    full = lambda model, when: [F.when(when, F.lit(v)).alias(k) for k, v in (("family", "hash"), ("dimension", 64), ("normalization", "l2"), ("encoding", "f32"))] + [F.when(when, model).alias("model")]
    rows = read(spark, sf_dir, "nation").select(n.alias("generation"), (n % 2).alias("embedded"), *full(F.concat(F.lit("f"), n % 2), known))
    claims = read(spark, sf_dir, "customer").select(c.alias("claim"), (c % 30).cast("int").alias("generation"), *full(F.concat(F.lit("f"), c % 2), F.lit(True)))
    return generations.identity_compatible(rows, claims)


@query("SELECT doc_id AS seq, sha256(text) AS digest, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1 THEN 'created' ELSE 'replayed' END AS status FROM documents")
def ingest_artifacts(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("scope"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("media_type"))
    return artifacts.ingest_artifacts(files)[1].select("seq", "digest", "status")


@query("""
    WITH a AS (SELECT doc_id AS id, 'store/' || CASE WHEN doc_id % 10 = 0 THEN 'odd' ELSE sha256(text) END AS location, text FROM documents), c AS (SELECT DISTINCT sha256(text) AS d FROM documents WHERE doc_id % 3 > 0)
    SELECT id, CASE WHEN location = 'store/odd' OR c.d IS NULL THEN 'failed' ELSE 'copied' END AS outcome, CASE WHEN location = 'store/odd' THEN 'bad_location' WHEN c.d IS NULL THEN 'copy_missing' END AS reason FROM a LEFT JOIN c ON d = sha256(text)
""")
def relocate_report(spark, sf_dir):
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(d.alias("id"), F.concat(F.lit("store/"), F.when(d % 10 == 0, "odd").otherwise(F.sha2("text", 256))).alias("location"))
    files = docs.select(F.concat(F.lit("store/"), F.sha2("text", 256)).alias("location"), F.col("text").cast("binary").alias("content")).distinct()
    copies = docs.where(d % 3 > 0).select(F.col("text").cast("binary").alias("content"))
    return artifacts.relocate_report(rows, files, copies).select("id", "outcome", "reason")


_MOVES = """
    WITH m AS (SELECT doc_id AS id, n * 10 + doc_id % 3 AS seq, CASE WHEN doc_id % 4 = 0 AND n < 2 THEN 'gone' ELSE 'a/' || doc_id END AS expected, 'b' || n AS location
        FROM documents, (SELECT unnest([1, 2, 3]) AS n) WHERE doc_id % 2 = 0),
    o AS (SELECT *, CASE WHEN expected = 'gone' THEN 'guard_rejected' WHEN row_number() OVER (PARTITION BY id, expected = 'gone' ORDER BY seq) = 1 THEN 'rebound' ELSE 'conflict' END AS status FROM m)
"""


def _moves(spark, sf_dir):
    """Three moves for each second artifact, some with a location that isn't the present one."""
    d, n = F.col("id"), F.col("n")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("a/"), "doc_id").alias("location"))
    asked = rows.where(d % 2 == 0).withColumn("n", F.explode(F.lit([1, 2, 3])))
    expected = F.when((d % 4 == 0) & (n < 2), "gone").otherwise(F.col("location"))
    return artifacts.rebind_locations(rows, asked.select((n * 10 + d % 3).alias("seq"), "id", expected.alias("expected_location"), F.concat(F.lit("b"), n).alias("location")))


@query(f"{_MOVES} SELECT seq, id, status FROM o")
def rebind_locations(spark, sf_dir):
    return _moves(spark, sf_dir)[1]


@query(f"{_MOVES} SELECT doc_id AS id, coalesce(location, 'a/' || doc_id) AS location FROM documents LEFT JOIN (SELECT id, location FROM o WHERE status = 'rebound') ON id = doc_id")
def rebound_artifacts(spark, sf_dir):
    return _moves(spark, sf_dir)[0]


@query("""
    WITH s AS (SELECT event_id, user_id + CASE WHEN event_id % 8 = 0 THEN 1000000 ELSE 0 END AS artifact, event_id % 3 AS scope, event_id % 50 AS s, event_id % 50 + event_id % 7 - 1 AS e, list_extract(['byte', 'line', 'char', 'word'], event_id % 4 + 1) AS unit FROM events)
    SELECT event_id, CASE WHEN unit = 'word' THEN 'bad_unit' WHEN e < s THEN 'bad_range' WHEN c_custkey IS NULL THEN 'not_found' WHEN c_custkey % 3 <> scope THEN 'scope_denied' END AS reason FROM s LEFT JOIN customer ON c_custkey = artifact
""")
def ingest_spans(spark, sf_dir):
    e, c = F.col("event_id"), F.col("c_custkey")
    spans = read(spark, sf_dir, "events").select(
        e, (F.col("user_id") + F.when(e % 8 == 0, 1000000).otherwise(0)).alias("artifact"), (e % 3).alias("scope"), (e % 50).alias("start"), (e % 50 + e % 7 - 1).alias("end"),
        F.element_at(F.lit(["byte", "line", "char", "word"]), (e % 4 + 1).cast("int")).alias("unit"),
    )
    own = read(spark, sf_dir, "customer").select(c.alias("id"), (c % 3).alias("scope"))
    return artifacts.ingest_spans(spans, own).select("event_id", "reason")


@query(f"WITH {MEMORIES} SELECT doc_id AS hit, CASE WHEN doc_id % 4 > 0 THEN 'e' || (doc_id % 4) ELSE '' END AS links, doc_id % 4 > 0 AS graph FROM documents")
def attach_entities(spark, sf_dir):
    n = F.col("n")
    rows = memories(spark, sf_dir).select("id", F.when(n % 4 > 0, F.array(F.concat(F.lit("e"), n % 4))).alias("entity_links"))
    hits = memories(spark, sf_dir).select(n.alias("hit"), "id")
    return fusion.attach_entities(hits, rows).select("hit", F.coalesce(F.array_join("entity_links", ","), F.lit("")).alias("links"), "graph")


@query("""
    WITH a AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'signup')
    SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'missing', k FROM a WHERE k NOT IN (SELECT k FROM b)
""")
def set_operations(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    a, b = (rows.where(F.col("event_type") == t).select("k").distinct() for t in ("view", "signup"))
    return a.unionByName(b).dropDuplicates().select(F.lit("union").alias("op"), "k").unionByName(a.join(b, "k", "left_anti").select(F.lit("missing").alias("op"), "k"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _hashed(source: str, key: str, text: str, dim: int) -> str:
    """CTEs up to ``hashed`` (key, pos, value): the rows of the hashed vectors' places that aren't zero."""
    return f"""
    hw AS (SELECT {key} AS key, unnest({_WORDS.format(text)}) AS word FROM {source}), spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM hw)),
    fnv AS (SELECT word, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(len(h) // 2), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::UHUGEINT)),
        lambda c, b: xor(c, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS h FROM spelt),
    signed AS (SELECT key, (h % {dim})::INTEGER AS pos, sum(CASE WHEN (h // 4294967296::UHUGEINT) % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS n FROM hw JOIN fnv USING (word) GROUP BY key, pos),
    hashed AS (SELECT key, pos, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS FLOAT) AS DOUBLE) AS value FROM signed WHERE n <> 0)"""


@query(f"WITH {_hashed('documents', 'doc_id', 'text', 32)} SELECT key AS doc_id, pos, CAST(floor(value * 1000000) AS BIGINT) AS millionths FROM hashed")
def hash_embed_values(spark, sf_dir):
    """The hashed vectors of all documents by a plug-in, a row for each place that isn't zero."""
    rows = embedders.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), embedders.HashEmbedder(32))
    each = rows.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value <> 0")
    return each.select("doc_id", "pos", F.floor(F.col("value").cast("double") * 1000000).alias("millionths"))


@query("""
    SELECT item_id AS query_id, CASE WHEN item_id % 5 = 1 THEN 'identity_mismatch' ELSE 'ok' END AS status,
        CASE WHEN item_id % 5 = 1 THEN NULL WHEN item_id % 5 = 2 THEN 'knn' WHEN trim(text) = '' THEN 'invalid' ELSE 'hybrid' END AS channel FROM benchmark
""")
def embedded_queries(spark, sf_dir):
    """Which channels serve passages as queries, once those with text alone are embedded and foreign vectors refused."""
    n, hashing = F.col("item_id"), embedders.HashEmbedder(16)
    brings = F.when(n % 5 < 3, F.lit([0.25] * 16).cast("array<float>"))
    identity = F.when(n % 5 == 0, hashing.identity).when(n % 5 == 1, "other-model").when(n % 5 == 2, hashing.identity)
    asked = read(spark, sf_dir, "benchmark").select(n.alias("query_id"), F.when(n % 5 == 2, "").otherwise(F.col("text")).alias("query"), brings.alias("embedding"), identity.alias("embedding_identity"))
    rows = embedders.embedded_queries(asked, hashing)
    channel = F.when(F.col("status") == "ok", fusion.search_reason(F.col("query"), F.col("embedding")))
    return rows.select("query_id", "status", channel.alias("channel"))


@query(f"""
    WITH {_hashed("(SELECT 'm' || doc_id AS id, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark)", 'id', 'text', 32)}, own AS (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY key)) AS norm FROM hashed WHERE key NOT LIKE 'm%' OR CAST(key[2:] AS BIGINT) % 9 <> 4),
    s AS (SELECT q.key AS query, m.key AS id, sum(q.value * m.value) / (any_value(q.norm) * any_value(m.norm)) AS score FROM own q JOIN own m ON q.pos = m.pos AND q.key LIKE 'q%' AND m.key LIKE 'm%' GROUP BY ALL)
    SELECT CAST(query[2:] AS BIGINT) AS query_id, round(max(score), 5) AS best, count(*) FILTER (WHERE CAST(id[2:] AS BIGINT) % 9 = 4) AS foreign FROM s GROUP BY query
""")
def search_embedded(spark, sf_dir):
    """The best vector score of each passage that is searched as text alone; a ninth of the memories have vectors of another model."""
    hashing, d = embedders.HashEmbedder(32), F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("m"), d).alias("id"), d, "text")
    rows = embedders.embed(docs, hashing).withColumn("embedding_identity", F.when(d % 9 == 4, "other-model").otherwise(F.col("embedding_identity")))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    near = vectors.knn_search(embedders.embedded_queries(asked, hashing).drop("status", "embedding_identity"), embedders.of_identity(rows, hashing.identity), 1)
    foreign = near.join(rows.where("embedding_identity = 'other-model'").select("id", F.lit(1).alias("foreign")), "id", "left")
    return foreign.select("query_id", F.round("score", 5).alias("best"), F.coalesce("foreign", F.lit(0)).cast("long").alias("foreign"))


@query(f"""
    WITH {MEMORIES}, {_hashed("(SELECT id, text FROM memories WHERE valid_until IS NULL AND (starts_with(scope, 'org/src0/') OR starts_with(scope, 'org/src1/')))", 'id', 'text', 16)}
    SELECT 3 AS generation, key AS id, pos, CAST(floor(value * 1000000) AS BIGINT) AS millionths FROM hashed
""")
def reindex_values(spark, sf_dir):
    """The vectors of a generation that is embedded anew, a row for each place that isn't zero."""
    out = generations.reindex(memories(spark, sf_dir), lambda text: hash_embed(text, 16), ["org/src0", "org/src1"], 3)
    each = out.select("generation", "id", F.posexplode("vector").alias("pos", "value")).where("value <> 0")
    return each.select("generation", "id", "pos", F.floor(F.col("value").cast("double") * 1000000).alias("millionths"))


@query("""
    WITH c AS (SELECT c_custkey AS seq, c_nationkey AS family FROM customer), g AS (SELECT n_regionkey AS family, n_nationkey + 1 AS generation, n_nationkey % 7 = 3 AND n_regionkey = 1 AS building FROM nation),
    s AS (SELECT max(generation) AS top, count(*) FILTER (WHERE building) AS building FROM g)
    SELECT family, seq, CASE WHEN building = 0 AND seq = min(seq) OVER () THEN top + 1 END AS generation, CASE WHEN building = 0 AND seq = min(seq) OVER () THEN 'declared' ELSE 'already_building' END AS status
    FROM (SELECT 'open' AS family, seq, top, 0 AS building FROM c, s) UNION ALL SELECT 'building', seq, NULL, 'already_building' FROM c
""")
def declare_generation(spark, sf_dir):
    """Customers claim the next generation: where none is building the first gets it, where one is nobody does."""
    n = F.col("n_nationkey")
    claims = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"))
    known = lambda status: read(spark, sf_dir, "nation").select((n + 1).alias("generation"), status.alias("status"))
    idle = generations.declare_generation(known(F.lit("retired")), claims).withColumn("family", F.lit("open"))
    busy = generations.declare_generation(known(F.when(n % 7 == 3, "building").otherwise("retired")), claims).withColumn("family", F.lit("building"))
    return idle.unionByName(busy).select("family", "seq", F.col("generation").cast("long").alias("generation"), "status")


@query(f"WITH {MEMORIES} SELECT g AS generation, 'm' || vec_id AS id FROM embeddings, (SELECT unnest([1, 2]) AS g) WHERE 'm' || vec_id NOT IN (SELECT id FROM memories WHERE category = 'identity')")
def erase_vectors(spark, sf_dir):
    """Staged vectors of two generations without those of erased memories."""
    from recollect.operators.revise import erase_vectors as erase

    staged = read(spark, sf_dir, "embeddings").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("generation"), F.concat(F.lit("m"), "vec_id").alias("id"), "embedding")
    return erase(staged, memories(spark, sf_dir).where("category = 'identity'")).select("generation", "id")


@query(f"""
    WITH {MEMORIES} SELECT id, scope, category, md5(text) AS text, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(sys_closed, '%Y-%m-%d %H:%M:%S') AS sys_closed, version, 'e' || n % 3 AS entity_links FROM memories
""")
def read_memories(spark, sf_dir):
    """The memory table with its full list of fields, written by scope roots and read back."""
    path, rows = shared_path(spark, "memories"), memories(spark, sf_dir)
    at = lambda c: F.col(c).cast("timestamp").alias(c)
    full = rows.select(
        "id", "category", "scope", F.struct("text", F.lit(None).cast("string").alias("attrs")).alias("content"), *[at(c) for c in ("valid_from", "valid_until", "known_at", "sys_created", "sys_closed")],
        F.col("version").cast("long").alias("version"), F.array(F.concat(F.lit("e"), F.col("n") % 3)).alias("entity_links"),
    )
    tables.write_memories(full, path)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return tables.read_memories(spark, path).select("id", "scope", "category", F.md5("content.text").alias("text"), text("valid_from"), text("sys_closed"), "version", F.array_join("entity_links", ",").alias("entity_links"))
