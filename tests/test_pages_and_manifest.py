"""Pages of many requests, texts told by containment, manifests, and functions for SQL texts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.functions.sql import register
from recollect.operators import evaluate, manifest, pages, text_gold

DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("prefix", [True, False])
def test_pages_are_the_plain_ones(spark, prefix):
    draw = random.Random(9)
    rows = [(f"m{i:04}", draw.choice(["org", "org/a", "org/a", "org/a", "org/a/b", "org/c"]), DAY + timedelta(hours=draw.randrange(40))) for i in range(900)]
    asked = []
    for i in range(120):
        after = draw.choice(rows) if i % 3 else None
        asked.append((i, draw.choice(["org", "org/a", "org/c", "org/none"]), [None, 5, 70, 1000, 0][i % 5], after and after[2], after and (after[0] if i % 2 else after[0] + "x")))
    df = spark.createDataFrame(rows, "id string, scope string, valid_from timestamp_ntz")
    requests = spark.createDataFrame(asked, "request_id int, scope string, limit int, after_from timestamp_ntz, after_id string")
    want = set()
    for i, scope, limit, at, last in asked:
        size = max(1, min(64 if limit is None else limit, 512))
        mine = sorted(((f, r) for r, s, f in rows if s == scope or (prefix and s.startswith(scope + "/"))), reverse=True)
        mine = [x for x in mine if last is None or x < (at, last)]
        want |= {(i, n + 1, r, len(mine) > size) for n, (_, r) in enumerate(mine[:size])}
    assert {tuple(r) for r in pages.pages(df, requests, prefix).collect()} == want
    assert pages.pages(df.limit(0), requests).collect() == [] == pages.pages(df, requests.limit(0)).collect()


def test_texts_are_told_by_containment(spark):
    gold = spark.createDataFrame([(2, "two", "The Cache, timeout is 30s"), (1, "one", "timeout IS 30"), (3, "ab", "Zx"), (4, "c", "q"), (5, "long", "entirely different words about giraffes")], "ord long, key string, text string")
    hits = [("h1", "we saw: the cache timeout is 30s now"), ("h2", "cache TIMEOUT"), ("h3", "lazxy"), ("h4", "?!"), ("h5", None), ("h6", "iraff"), ("h7", "nothing here"), ("h8", "quiet"), ("h9", "we saw: the cache timeout is 30s now")]
    df = spark.createDataFrame(hits, "hit string, text string")
    got = {r.hit: r.key for r in text_gold.text_gold(df, gold).collect()}
    assert got == {"h1": "one", "h9": "one", "h2": "two", "h3": "ab", "h6": "long", "h8": "c"}
    blank = gold.unionByName(spark.createDataFrame([(0, "blank", "...")], gold.schema))
    assert {r.hit: r.key for r in text_gold.text_gold(df, blank).collect()} == dict.fromkeys(("h1", "h2", "h3", "h6", "h7", "h8", "h9"), "blank")
    assert text_gold.text_gold(df.limit(0), gold).collect() == [] == text_gold.text_gold(df, gold.limit(0)).collect()


def test_long_hits_are_looked_for_in_no_gold(spark, monkeypatch):
    asked, plain = [], text_gold.contained
    monkeypatch.setattr(text_gold, "contained", lambda needles, hays: (asked.append(needles.count()), plain(needles, hays))[1])
    gold = spark.createDataFrame([(1, "one", "a red cache")], "ord long, key string, text string")
    hits = spark.createDataFrame([(1, "red"), (2, "a long text about a red cache"), (3, "RED!"), (2, "a red cache")], "hit int, text string")
    assert sorted(tuple(r) for r in text_gold.text_gold(hits, gold).collect()) == [(1, "one"), (2, "one"), (2, "one"), (3, "one")]
    assert asked == [1, 2]  # of four hits


def test_passages_are_found_within_words(spark, monkeypatch):
    passages = spark.createDataFrame([(1, "ello wor"), (2, ""), (3, None), (4, "Hello  world"), (5, "o"), (6, "ello wor"), (7, "b c d e")], "probe int, query string")
    memories = spark.createDataFrame([("a", "say hello world"), ("b", "Hello  world"), ("c", None), ("d", "ab c d ef")], "id string, text string")
    want = [(1, "a"), (2, "a"), (2, "b"), (2, "d"), (4, "b"), (5, "a"), (5, "b"), (6, "a"), (7, "d")]
    for most in (text_gold.MOST_BYTES, 0):
        monkeypatch.setattr(text_gold, "MOST_BYTES", most)
        assert sorted(tuple(r) for r in evaluate.passage_gold(passages, memories).collect()) == want


def test_containment_is_brute_force(spark):
    draw = random.Random(1)
    text = lambda n: " ".join("".join(draw.choices("abc", k=draw.randrange(1, 4))) for _ in range(n))
    needles = [(i, text(draw.randrange(1, 5))) for i in range(80)] + [(100, "")]
    hays = [(i, text(draw.randrange(1, 30))) for i in range(80)] + [(100, "")]
    got = {tuple(r) for r in text_gold.contained(spark.createDataFrame(needles, "needle int, text string"), spark.createDataFrame(hays, "hay int, text string")).collect()}
    assert got == {(n, h) for n, a in needles for h, b in hays if a and a in b} and len(got) > 100


def test_manifests(spark):
    t = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5)], "i int, s string, d double")
    stored = manifest.manifest({"t": t, "gone": t, "empty": t.limit(0), "twice": t})
    found = manifest.manifest({"t": t.orderBy(F.desc("i")).select("d", "i", "s"), "new": t, "empty": t.limit(0), "twice": t.withColumn("s", F.when(F.col("i") == 2, "x").otherwise(F.col("s")))})
    assert {r.table: r.status for r in manifest.compare_manifests(stored, found).collect()} == {"t": "ok", "gone": "missing", "new": "unknown", "empty": "ok", "twice": "changed"}


def test_functions_in_sql_texts(spark):
    register(spark)
    spark.createDataFrame([("q", "a", 1), ("q", "a", 3), ("q", "b", None), ("q", "b", 2)], "query string, id string, rank int").createOrReplaceTempView("ranked")
    got = {r.id: r.score for r in spark.sql("SELECT id, rrf_score(rank) AS score FROM ranked GROUP BY query, id").collect()}
    assert got == pytest.approx({"a": 1 / 61 + 1 / 63, "b": 1 / 62})
    (row,) = spark.sql("SELECT hash_embed('hello world', 8) AS v").collect()
    assert len(row.v) == 8 and sum(x * x for x in row.v) == pytest.approx(1, abs=1e-6)
