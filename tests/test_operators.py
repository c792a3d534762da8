"""Small cases of single operators."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.functions.scopes import scope_match, scope_reason
from recollect.functions.text import contradicts, text_match
from recollect.operators import consolidate, evaluate, fusion, graph, ingest, lenses, lexical, neighbour_lists, packs, revise, vectors
from recollect.sources import tables
from recollect.streaming import traces as streams


def day(n):
    return datetime(2024, 1, n)


@pytest.fixture(scope="module")
def memories(spark):
    rows = [
        ("a", "org/a", "semantic", "the cache timeout is 30s", day(1), day(5), day(1), None, day(5), 1),
        ("b", "org/a/x", "semantic", "the cache timeout is 60s now", day(5), None, day(6), day(6), None, 2),
        ("c", "org/ab", "episodic", "ZETA_SCOPE_DENIED_42 seen", day(2), None, day(2), day(2), None, 1),
        ("d", "org/a", "uncertainty", "", day(2), None, day(2), day(2), None, 1),
    ]
    schema = "id string, scope string, category string, text string, valid_from timestamp_ntz, valid_until timestamp_ntz, known_at timestamp_ntz, sys_created timestamp_ntz, sys_closed timestamp_ntz, version long"
    return spark.createDataFrame(rows, schema)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_lenses_are_half_open(memories):
    at = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    assert ids(lenses.as_of(memories, at)) == ["b", "c", "d"]
    assert ids(lenses.as_of(memories, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))) == ["a"]
    assert ids(lenses.sys_as_of(memories, F.lit("2024-01-04 00:00:00").cast("timestamp_ntz"))) == ["a", "c", "d"]
    assert ids(lenses.in_categories(memories, [])) == [] and len(ids(lenses.in_categories(memories, None))) == 4


def test_scopes(spark):
    rows = spark.createDataFrame([("org/a", "org/a"), ("org/a/x", "org/a"), ("org/ab", "org/a")], "s string, q string")
    assert [r.m for r in rows.select(scope_match(F.col("s"), F.col("q"), F.lit("prefix")).alias("m")).collect()] == [True, True, False]
    bad = spark.createDataFrame([(x,) for x in ("", "a//b", "a b", "/a", "ok/a-1")], "s string").select(scope_reason(F.col("s")).alias("r"))
    assert [r.r for r in bad.collect()] == ["empty", "empty_segment", "white_space", "empty_segment", None]


def test_prefix_join_is_the_theta_join(memories, spark):
    scopes = spark.createDataFrame([("org",), ("org/a",)], "scope string")
    got = sorted(map(tuple, lenses.scope_prefix_join(memories, scopes).collect()))
    assert got == [("org", x) for x in "abcd"] + [("org/a", x) for x in "abd"]


def test_neighbours_under_lenses_are_brute_force(spark):
    import random

    draw = random.Random(6)
    time = lambda: draw.choice([None, day(draw.randrange(1, 9))])
    schema = "id string, scope string, embedding array<float>, valid_from timestamp_ntz, valid_until timestamp_ntz, known_at timestamp_ntz, sys_created timestamp_ntz, sys_closed timestamp_ntz"
    scopes = ["org", "org/a", "org/a/x", "org/ab", None]
    rows = [(f"m{i}", draw.choice(scopes), draw.choice([None, [], [1.0] * 3, *[[draw.choice([0.0, 1.0, 2.0]) for _ in range(4)]] * 5]), time(), time(), time(), time(), time()) for i in range(120)]
    asked = [(i, draw.choice(scopes), draw.choice(["prefix", "exact"]), [draw.choice([0.0, 1.0, 3.0]) for _ in range(4)], time(), time(), time()) for i in range(30)] + [(99, None, "prefix", None, None, None, None)]
    memories = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame(asked, "query_id int, scope string, scope_match string, embedding array<float>, as_of timestamp_ntz, known_as_of timestamp_ntz, sys_as_of timestamp_ntz")

    def cosine(x, y):
        a, b = math.sqrt(sum(v * v for v in x)), math.sqrt(sum(v * v for v in y))
        return sum(v * w for v, w in zip(x, y)) / (a * b) if a and b else 0.0

    def allowed(q, m):
        _, scope, match, _, at, known, system = q
        inside = scope is None or m[1] is not None and (m[1] == scope or match == "prefix" and m[1].startswith(scope + "/"))
        created = m[6] or m[5]
        valid = at is None or m[3] is not None and m[3] <= at and (m[4] is None or m[4] > at)
        known_by = known is None or m[5] is not None and m[5] <= known
        return inside and valid and known_by and (system is None or created is not None and created <= system and (m[7] is None or m[7] > system))

    want = set()
    for q in asked[:-1]:
        found = sorted((-round(cosine(q[3], m[2]), 9), m[0]) for m in rows if m[2] and len(m[2]) == 4 and allowed(q, m))[:5]
        want |= {(q[0], i, n + 1) for n, (_, i) in enumerate(found)}
    assert {(r.query_id, r.id, r.rank1) for r in vectors.knn_search(queries, memories, 5).collect()} == want
    pairs = spark.createDataFrame([(q[0], m[0]) for q in asked for m in rows], "query_id int, id string")
    got = {tuple(r) for r in lenses.seen(pairs, queries, memories).collect()}
    assert got == {(q[0], m[0]) for q in asked for m in rows if allowed(q, m)}


def test_bm25_regimes(memories, spark):
    asked = spark.createDataFrame([(1, "cache timeout"), (2, "zeta scope denied 42"), (3, "absent")], "query_id int, query string")
    found = {(r.query_id, r.id): r.score for r in lexical.bm25_scores(asked, memories).collect()}
    assert set(found) == {(1, "a"), (1, "b"), (2, "c")}
    assert found[1, "a"] == 0 and found[2, "c"] > 0  # in half of all texts: nothing; rare: something


def test_rrf_ignores_the_order_of_rows_and_breaks_ties_by_first_place(spark):
    rows = [(1, 0, 1, "x"), (1, 0, 2, "y"), (1, 1, 1, "y"), (1, 1, 2, "x"), (1, 1, 3, "z")]
    for some in (rows, rows[::-1]):
        got = fusion.rrf_fuse(spark.createDataFrame(some, "query_id int, list_no int, rank1 int, id string")).orderBy("rank1").collect()
        assert [r.id for r in got] == ["x", "y", "z"]
        assert got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-12)


def test_rewrites(spark):
    asked = spark.createDataFrame([(1, "what is the deadlock in parser"), (2, "  "), (3, "abc")], "query_id int, query string")
    got = sorted(map(tuple, fusion.rewrite_queries(asked).collect()))
    assert got == [(1, 0, "what is the deadlock in parser"), (1, 1, "deadlock parser"), (1, 2, "deadlock"), (3, 0, "abc")]


def test_abstain_keeps_queries_without_hits(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, 0.5)], "query_id int, score double")
    assert {r.query_id: r.abstained for r in fusion.abstain(asked, hits).collect()} == {1: False, 2: True}


def test_hash_embed(spark):
    rows = spark.createDataFrame([("Hello, hello world",), ("",), (None,)], "t string").select(vectors.hash_embed(F.col("t"), 16).alias("v")).collect()
    assert math.isclose(sum(x * x for x in rows[0].v), 1, abs_tol=1e-6) and set(rows[1].v) == {0.0} == set(rows[2].v)


def clustered(spark, n, dim=16, centres=40):
    import numpy as np

    draw = np.random.default_rng(8)
    middle = draw.standard_normal((centres, dim))
    rows = [(f"m{i}", [float(x) for x in middle[i % centres] + 0.2 * draw.standard_normal(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, embedding array<double>")


def test_lists_find_most_of_the_exact_neighbours(spark):
    v = clustered(spark, 4000)
    v = v.withColumns({"scope": F.when(F.col("id").endswith("7"), "x").otherwise("y/z"), "valid_from": F.lit(day(1)).cast("timestamp_ntz"), "valid_until": F.when(F.col("id").endswith("5"), F.lit(day(5)).cast("timestamp_ntz"))})
    asked = v.where("id LIKE '%00' OR id LIKE '%51'").select(F.col("id").alias("query_id"), "embedding", F.lit("y").alias("scope"), F.lit(day(9)).cast("timestamp_ntz").alias("as_of"))
    exact = {(r.query_id, r.id): (r.rank1, round(r.score, 6)) for r in vectors.knn_search(asked, v, 5).collect()}
    lists = neighbour_lists.Lists(v, 16)
    near = lists.search(asked, 5)
    found = {(r.query_id, r.id): round(r.score, 6) for r in near.collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact) and all(exact[key][1] == found[key] for key in exact.keys() & found.keys())
    assert not any(i.endswith(("5", "7")) for _, i in found)  # under the lenses
    pairs = lists.scored_pairs(asked).collect()
    assert len(pairs) == asked.count() and all(r.rows == 4000 for r in pairs) and sum(r.scored for r in pairs) < 0.1 * 4000 * len(pairs)
    recall = [r.recall for r in vectors.knn_recall(near, vectors.knn_search(asked, v, 5)).collect()]
    assert len(recall) == asked.count() and math.isclose(sum(recall) * 5, len(exact.keys() & found.keys()))
    # The whole search: all lists give the exact answer, and what finds too few is searched exactly.
    assert {(r.query_id, r.id): (r.rank1, round(r.score, 6)) for r in neighbour_lists.knn_search_lists(asked, v, 5, share=1.0, exact_rows=0).collect()} == exact
    lonely = neighbour_lists.knn_search_lists(asked, v.limit(30), 5, exact_rows=0)
    assert sorted((r.query_id, r.id, r.rank1) for r in lonely.collect()) == sorted((r.query_id, r.id, r.rank1) for r in vectors.knn_search(asked, v.limit(30), 5).collect())


def test_lists_of_hot_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbour_lists, "BLOCK_ROWS", 32)
    rows = [(f"h{i}", [1.0, 0.0]) for i in range(300)] + [(f"z{i}", [0.0, float(i)]) for i in range(3)] + [("n", None), ("e", []), ("d", [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, [0.5, 0.5, 0.5]), (4, None)], "query_id int, embedding array<double>")
    got = neighbour_lists.knn_search_lists(asked, v, 4, exact_rows=0, share=1.0)
    assert sorted((r.query_id, r.id, r.rank1) for r in got.collect()) == sorted((r.query_id, r.id, r.rank1) for r in vectors.knn_search(asked, v, 4).collect())
    assert {r.query_id for r in got.collect()} == {1, 2, 3}  # each dimension has its own pass
    assert neighbour_lists.knn_search_lists(asked, v.limit(0), 4).collect() == []


def test_registered_search_by_lists_reaches_its_recall(spark):
    from recollect.jobs import registry

    found = registry.queries()["knn_recall"](spark, "/root/testdata/sf0.1").collect()
    assert len(found) == 100 and sum(r.recall for r in found) >= 0.9 * len(found)
    assert sum(r.share for r in found) < 0.1 * len(found)


def test_supersede_has_one_winner(memories, spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    table = memories.withColumn("superseded_by", F.lit(None).cast("string"))
    asked = spark.createDataFrame(
        [(1, "b", "org/a/x", 9, "n"), (2, "b", "org/a/x", 2, "n"), (3, "b", "org/a/x", 2, "n"), (4, "a", "org/a", 1, "n"), (5, "c", "org/a", 1, "n"), (6, "zz", "org/a", 1, "n")],
        "seq int, prior_id string, scope string, expected_version long, text string",
    ).withColumns({"close_at": F.lit(None).cast("timestamp_ntz"), "new_valid_from": F.lit(None).cast("timestamp_ntz")})
    after, outcomes = revise.apply_supersedes(asked, table, now)
    assert {r.seq: r.status for r in outcomes.collect()} == {1: "version_conflict", 2: "ok", 3: "conflict", 4: "already_closed", 5: "scope_denied", 6: "not_found"}
    rows = {r.id: r for r in after.collect()}
    assert rows["b"].version == 3 and rows["b"].superseded_by == "b+2" and rows["b"].valid_until == day(10)
    assert rows["b+2"].version == 1 and rows["b+2"].supersedes is None if "supersedes" in table.columns else rows["b+2"].version == 1


def test_annotations_merge_shallowly(spark):
    """Values keep their JSON types; guards, unknown rows and second requests each have their outcome."""
    rows = spark.createDataFrame(
        [("a", "s", '{"x":1,"y":{"p":[1]},"k":true}', 1, 0.5, "extra"), ("b", "s", None, 1, 0.5, "extra"), ("c", "s", "[1]", 2, 0.5, "extra")],
        "id string, scope string, attrs string, version long, confidence double, more string",
    )
    schema = "seq int, id string, scope string, expected_version long, attrs string, confidence double, provenance_source string, provenance_kind string, bump_version boolean"
    asked = [
        (1, "a", "s", None, '{"y":{"q":null},"z":null,"x":2.5}', None, None, None, False), (2, "b", "s", 1, '{"z":"1"}', 0.9, "me", None, None), (3, "a", "s", None, "{}", None, None, None, None),
        (0, "a", "t", None, "{}", None, None, None, None), (5, "zz", "s", None, "{}", None, None, None, None), (6, "c", "s", 1, "{}", None, None, None, None), (7, "c", "s", 2, '{"l":"' + "x" * 5000 + '"}', None, None, None, None),
    ]
    changed, outcomes, events = revise.apply_annotations(spark.createDataFrame(asked, schema), rows, F.lit(day(9)))
    assert changed.columns == rows.columns
    got = {r.id: (r.attrs, r.version, r.confidence, r.more) for r in changed.collect()}
    assert got == {"a": ('{"k":true,"x":2.5,"y":{"q":null},"z":null}', 1, 0.5, "extra"), "b": ('{"z":"1"}', 2, 0.9, "extra"), "c": ("[1]", 2, 0.5, "extra")}
    assert {r.seq: r.status for r in outcomes.collect()} == {0: "scope_denied", 1: "ok", 2: "ok", 3: "conflict", 5: "not_found", 6: "version_conflict", 7: "attrs_too_large"}
    assert sorted((r.memory_id, r.version, r.bump) for r in events.collect()) == [("a", 1, False), ("b", 2, True)]


def test_traverse_meets_cycles_and_hubs(spark):
    edges = spark.createDataFrame([("a", "depends_on", "b"), ("b", "depends_on", "a"), ("b", "depends_on", "c"), ("d", "contradicts", "a")], "subject string, predicate string, object string")
    edges = edges.withColumns({"id": F.concat("subject", "object"), "state": F.lit("active")})
    closed = edges.where("subject = 'b' AND object = 'c'").withColumns({"object": F.lit("z"), "id": F.lit("bz"), "state": F.lit("closed")})
    edges, seed = edges.unionByName(closed), spark.createDataFrame([("a",)], "id string")
    nodes, stats = graph.traverse(edges, seed, 3)
    assert {(r.node, r.depth, ">".join(r.path)) for r in nodes.collect()} == {("a", 0, ""), ("b", 1, "ab"), ("d", 1, "da"), ("c", 2, "ab>bc")}
    assert tuple(stats.first()) == ("a", 4, 5, 2, [])
    cases = (({"depth": 1}, 3, ["depth"]), ({"visited": 2}, 2, ["visited"]), ({"most_edges": 2}, 3, ["edges"]), ({"states": ("active", "closed")}, 5, []), ({"predicates": ("contradicts",)}, 2, []), ({"direction": "in"}, 3, []))
    for options, n, truncated in cases:
        nodes, stats = graph.traverse(edges, seed, **{"depth": 3} | options)
        assert (nodes.count(), stats.first().truncated) == (n, truncated), options


def test_expansion_leaves_direct_hits_in_place(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.5)], "query_id int, id string, rank1 int, score double")
    edges = spark.createDataFrame([("a", "supports", "b"), ("a", "supports", "c")], "subject string, predicate string, object string")
    memories = spark.createDataFrame([("a", "org"), ("b", "org"), ("c", "org"), ("e", "else")], "id string, scope string")
    queries = spark.createDataFrame([(1, "org")], "query_id int, scope string")
    edges = edges.unionByName(spark.createDataFrame([("c", "supports", "e"), ("a", "supports", "e")], "subject string, predicate string, object string"))
    out, stats = graph.graph_expand(hits, edges, queries, memories)
    assert tuple(stats.first()) == (1, 2, 4, 2, 1, ["depth"])
    got = {r.id: r for r in out.collect()}
    assert "e" not in got and got["b"]["from"] == ["a"] and got["a"]["from"] == ["b"]
    assert (got["b"].rank1, got["b"].score, got["b"].expanded) == (2, 0.5, False) and got["c"].rank1 == 3 and got["c"].expanded
    assert got["c"].score == pytest.approx(1 / 63)


def test_packing_defers_an_oversized_first_hit(spark):
    hits = spark.createDataFrame([(1, 1, "big", "x" * 500), (1, 2, "small", "y" * 50)], "query_id long, rank1 int, id string, text string")
    got = [(r.id, r.form) for r in packs.pack_context(hits, 8, 200).collect()]
    named = packs.pack_context(hits.withColumn("query_id", F.concat(F.lit("q"), "query_id")), 8, 200)
    assert [(r.id, r.form) for r in named.collect()] == got and {r.query_id[0] for r in named.collect()} == {"q"}
    assert got == [("small", "card"), ("big", "stub")]


def test_insertions(spark):
    acks = spark.createDataFrame([(1, "p", ["b"]), (2, "p", ["b"]), (3, "p", ["c"]), (4, "p", ["zz"]), (5, "q", ["b"])], "seq int, proposal_id string, inserted array<string>")
    selected = spark.createDataFrame([("p", "b"), ("p", "c")], "proposal_id string, block_id string")
    assert {r.seq: r.status for r in packs.verify_insertions(acks, selected).collect()} == {1: "accepted", 2: "replayed", 3: "conflict", 4: "fabricated_block", 5: "unknown_proposal"}


def test_near_duplicates_are_the_brute_force_ones(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha beta gamma omega", "alpha beta", "", "never alpha beta gamma delta", "one two three four"]
    rows = spark.createDataFrame([(f"m{i}", "s", "semantic", t, day(i + 1)) for i, t in enumerate(texts)], "id string, scope string, category string, text string, valid_from timestamp_ntz")
    sets = [{w for w in t.split() if len(w) > 2} for t in texts]
    want = {frozenset((f"m{i}", f"m{j}")) for i in range(7) for j in range(i) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    got = consolidate.near_duplicates(rows).collect()
    # Pairs of the classes' first rows, and of these with the others of their class, give all pairs.
    classes = {f"m{i}": {f"m{j}" for j in range(7) if sets[j] == sets[i]} for i in range(7)}
    pairs = {frozenset((x, y)) for r in got for x in classes[r.keep] for y in classes[r["drop"]] if x != y}
    assert pairs == want and len(got) == 3 and {frozenset((r.keep, r["drop"])) for r in got} <= want
    assert all(r.conflict == ("m5" in (r.keep, r["drop"])) for r in got)


def test_conflicts_and_matches(spark):
    rows = spark.createDataFrame([("it is 30s", "it is 60s", True), ("can't do", "can do", True), ("same", "same", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", contradicts(F.col("a"), F.col("b")).alias("got")).collect())
    rows = spark.createDataFrame([("Uses Rust!", "it uses rust now", True), ("", "x", False), ("quick brown foxes", "brown bears", True), ("abc", "xyz", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", text_match(F.col("a"), F.col("b")).alias("got")).collect())


def test_citations(spark):
    rows = spark.createDataFrame([(1, "The answer.\nUSED: [b1, b-2] trailing"), (2, "ABSTAIN"), (3, "Used the block above.")], "probe int, raw string")
    got = {r.probe: (r.used, r.abstained, r.body) for r in evaluate.parse_citations(rows).collect()}
    assert got == {1: (["b1", "b-2"], False, "The answer."), 2: ([], True, ""), 3: ([], False, "Used the block above.")}


def test_ops_text():
    assert ingest.parse_ops('{"op":"noop","reason":"x"}') == ([{"op": "noop", "reason": "x"}], None)
    assert ingest.parse_ops('Sure ```json\n[{"op":"noop"}]\n```')[0] == [{"op": "noop"}]
    assert ingest.parse_ops('well {"op":"noop","reason":"a } b"} ok')[0] == [{"op": "noop", "reason": "a } b"}]
    assert [ingest.parse_ops(x)[1] for x in ("none", None, '{"op":"fly"}', '{"op":"noop","x":1}', '{"op":"noop","op":"put"}')] == ["no_json", "no_json", "unknown_op", "unknown_field", "duplicate_field"]


def test_memory_files(spark, tmp_path):
    schema = tables.MEMORY
    rows = spark.createDataFrame([], schema).unionByName(spark.range(2).selectExpr("CAST(id AS STRING) AS id", "'org/a/x' AS scope", "1L AS version"), allowMissingColumns=True)
    path = str(tmp_path / "memories")
    tables.write_memories(rows, path)
    assert tables.read_memories(spark, path).count() == 2
    odd = str(tmp_path / "odd")
    rows.withColumn("extra", F.lit(1)).write.parquet(odd)
    with pytest.raises(ValueError):
        tables.read_memories(spark, odd)


def test_scenarios(spark, tmp_path):
    (tmp_path / "b.json").write_text('{\n"id": "s1", "pattern": "p", "scope": "org", "transcript": [{"role": "user", "text": "hi"}], "probes": [{"name": "q", "query": "x", "limit": 3}]\n}')
    found = tables.read_scenarios(spark, str(tmp_path))
    assert found["transcript"].collect()[0].text == "hi" and found["probes"].collect()[0].limit == 3
    cases = tmp_path / "cases.jsonl"
    cases.write_text('{"name": "a", "scope": "org", "episode": "e", "expect_stored": true}\n')
    assert tables.read_write_cases(spark, str(cases)).collect()[0].expect_stored


def test_task_state_stream_is_the_batch_fold(spark, tmp_path):
    rows = [("org", "s", i, "{}" if i != 2 else "[]", e, c) for i, e, c in ((1, None, True), (2, None, None), (3, 1, None), (4, 1, None), (5, None, True))]
    df = spark.createDataFrame(rows, "scope string, slot string, seq long, body string, expected_version long, create_only boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(streams.STATE_OP).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, streams.run_available(streams.task_state_stream(stream)).collect()))
    want = sorted(map(tuple, revise.fold_task_state(df).collect()))
    assert got == want
    assert [r[3] for r in got] == ["ok", "invalid_body", "ok", "version_conflict", "exists"]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_streams_are_the_batch_results_in_any_frames(spark, tmp_path, batch):
    """Rows of a trace or a slot come unsorted, from several files, in frames of any size, over one trigger or several."""
    import random

    draw = random.Random(batch)
    rows = [(i, f"t{draw.randrange(4)}", draw.choice(["a", "b", None]), "search", "m", datetime(2024, 1, 1, draw.randrange(2), draw.randrange(3)), "") for i in range(60)]
    draw.shuffle(rows)
    events = spark.createDataFrame(rows, streams.EVENT)
    ops = events.selectExpr("trace_id AS scope", "'s' AS slot", "event_id AS seq", "'{}' AS body", "IF(event_id % 3 = 0, event_id % 5, NULL) AS expected_version", "event_id % 7 = 0 AS create_only")
    want = {r.trace_id: r.s for r in events.where("scope IS NOT NULL").groupBy("trace_id").agg(F.min_by("scope", F.struct("created_at", "event_id")).alias("s")).collect()}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, batch)
    try:
        events.repartition(5).write.parquet(str(tmp_path / "in"))
        got = streams.run_available(streams.ingest_stream(streams.trace_stream(spark, str(tmp_path / "in")))).collect()
        assert len(got) == 60
        scope = {r[0]: r[2] for r in rows}
        assert all((r.status == "ok") == (scope[r.event_id] == want[r.trace_id]) for r in got)
        ops.repartition(5).write.parquet(str(tmp_path / "ops"))
        stream = spark.readStream.schema(streams.STATE_OP).parquet(str(tmp_path / "ops"))
        assert sorted(map(tuple, streams.run_available(streams.task_state_stream(stream)).collect())) == sorted(map(tuple, revise.fold_task_state(ops).collect()))
        # File by file: a later trigger keeps to the scope that an earlier one has set.
        stream = streams.trace_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        owners = {(r.trace_id, scope[r.event_id]) for r in streams.run_available(streams.ingest_stream(stream, "3 hours")).collect() if r.status == "ok"}
        assert len(owners) == len({trace for trace, _ in owners}) == 4
    finally:
        spark.conf.unset(size)


def test_scenario_violations(spark):
    scenarios = spark.createDataFrame([("s",), ("s",)], "scenario string")
    gold = spark.createDataFrame([("s", "k")], "scenario string, key string")
    probes = spark.createDataFrame([("s", "p", ["k", "z"], [], False), ("s", "q", ["k"], [], True)], "scenario string, probe string, expect array<string>, forbid array<string>, abstain boolean")
    got = sorted(r.violation for r in evaluate.validate_scenarios(scenarios, gold, probes).collect())
    assert got == ["abstain_expects", "repeated_scenario", "unknown_key"]


def test_scenario_categories_times_and_patterns(spark):
    scenarios = spark.createDataFrame([("s", "drift")], "scenario string, pattern string")
    gold = spark.createDataFrame([("s", "k", "semantic", "2024-01-01T00:00:00Z", None), ("s", "l", "odd", "soon", None)], "scenario string, key string, category string, valid_from string, valid_until string")
    probes = spark.createDataFrame([("s", "p", ["k"], [], False, "never")], "scenario string, probe string, expect array<string>, forbid array<string>, abstain boolean, as_of string")
    got = sorted((str(r.scenario), r.violation) for r in evaluate.validate_scenarios(scenarios, gold, probes, ("drift", "echo")).collect())
    assert got == [("None", "no_exemplar:echo"), ("s", "bad_as_of"), ("s", "bad_valid_from"), ("s", "unknown_category")]


def test_pinned_revisions(spark):
    ends = spark.createDataFrame([("memory", "a", "s", 2), ("span", "b", "s", 1)], "kind string, id string, scope string, version long")
    rows = [("memory", "a", r, "span", "b", q, "s") for r, q in ((None, None), (2, None), (3, None), (0, None), (1, 1))]
    edges = spark.createDataFrame(rows, "subject_kind string, subject string, subject_rev long, object_kind string, object string, object_rev long, scope string")
    got = graph.dangling_endpoints(edges, ends)
    assert set(got.columns) == {*edges.columns, "reason"}
    assert sorted(str(r.reason) for r in got.collect()) == ["None", "None", "object_not_pinnable", "subject_bad_revision", "subject_bad_revision"]
