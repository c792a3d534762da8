"""Sharding, secrets and SimHash against plain versions."""

import os
import re
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from recollect.llm import secrets, simhash
from recollect.llm.arrays import replaced, running
from recollect.llm.secrets import find_secrets, redact, secret_report
from recollect.llm.sharding import shard
from recollect.llm.simhash import fingerprint_report, within_radius

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]
LIVE = "a1b2c3d4e5f60718293a4b5c"
TEXTS = [
    f"é password={LIVE} und", None, "", f'TOKEN : "{LIVE}"', "password=abc token=secret=abcdef api_key='xyzxyz1'", "AKIA" + "A1B2C3D4E5F6G7H8" + " AKIAshort",
    "password=example12345", "password=example12345", "password=example12345 and passwd:1", f"bare {LIVE}!", "x" * 5000 + " apikey=" + "q1" * 40, "😀 secret: zzzzzz9",
    "password=password=abcdefg", "deadbeef" * 4 + "deadbeef",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 12 if i != 4 else None, t, "src0" if LIVE in (t or "") else f"src{i % 4}", "en" if i % 2 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS row", "2 AS base", "3 AS mark", "4 AS size", "5 AS h", "6 AS bucket")


def base_of(text):
    spans = [(m.start(), o, m.end(), k) for o, (k, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(k, a, b) for a, _, b, k in sorted(spans)]


def test_base_spans(docs):
    rows = secret_report(docs, F.concat_ws("/", "source", "lang"), F.col("source")).collect()
    want = sorted((sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_of(t)).encode()).hexdigest(), *[sum(k == kind for k, _, _ in base_of(t)) for kind, *_ in KINDS]) for t in TEXTS)
    assert sorted((r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in rows) == want


def test_ownership_tells_live_from_example(docs):
    found, owned = find_secrets(docs, F.col("source"), F.col("source"))
    by = {r.value_hash: r for r in owned.collect()}
    example, live = by[sha256(b"example12345").hexdigest()], by[sha256(LIVE.encode()).hexdigest()]
    assert (example.owners, example.live) == (3, False) and live.live and live.owners <= 2
    spans = {r.mark: r for r in found.collect()}
    from hashlib import md5

    bare = spans[md5(f"bare {LIVE}!".encode()).hexdigest()]
    assert [(s.start, s.end) for s in bare.live] == [(5, 5 + len(LIVE))]


def test_redaction(docs):
    rows = redact(docs, F.col("source"), F.col("source")).collect()
    texts = [r.text for r in rows]
    assert len(rows) == len(TEXTS) and set(docs.columns) == set(rows[0].asDict())
    assert not any(LIVE in (t or "") for t in texts) and "é [SECRET] und" in texts and texts.count("password=example12345") == 2


def test_secrets_that_no_base_pattern_meets_and_other_places(spark):
    bare, short, dotted, slashed, copied = "ghp_Zk83hQpLm29XcVbN71", "k9Xw2Lq7vB", "q8Zt.M4nvX1.c7Kd", "wJ7rXU/K7MDENG9/bPxRfiCY5z==", "hT6yPq2WnB"
    texts = [
        (f"key {bare}!", "a"), (f"x/{bare}", "a"),  # no base pattern anywhere
        (f"password={short}. Then", "a"), (f"{short} OTHER={short}/x.{short} z{short} {short}9", "a"),
        (f"secret: {dotted}", "a"), (f"path/{dotted} {dotted}.", "b"), (f"é {slashed}", "b"), (f"KEY={slashed}", "b"),
        (f"token={copied}", "a"), (f"UP={copied}", "b"), (f"see its/path/{copied}.", "c"),  # three owners, one of them by the base pattern
        (None, "a"),
    ]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    found, owned = find_secrets(docs, F.col("source"), F.col("source"))
    by = {r.value_hash: (r.known, r.owners, r.live) for r in owned.collect()}
    want = {bare: (False, 1, True), short: (True, 1, True), dotted: (True, 2, True), slashed: (False, 1, True), copied: (True, 3, False)}
    assert {v: by[sha256(v.encode()).hexdigest()] for v in want} == want
    spans = {r.doc_id: {(s.start, s.end) for s in r.live} for r in found.collect()}
    edge = "[A-Za-z0-9+_-]"
    for i, (text, _) in enumerate(texts):
        every = {m.span(1) for v in want if want[v][2] for m in re.finditer(f"(?<!{edge})(?=({re.escape(v)})(?!{edge}))", text or "")}
        assert every <= spans[i] and (every or not spans[i])
    clean = {r.doc_id: r.text for r in redact(docs, F.col("source"), F.col("source")).collect()}
    assert not any(v in (t or "") for i, t in clean.items() for v in (bare, dotted, slashed)) and clean[3] == f"[SECRET] OTHER=[SECRET]/x.[SECRET] z{short} {short}9"
    assert all(clean[i] == texts[i][0] for i in (8, 9, 10, 11))


def plain_live(rows):
    """The whole rule for (text, repository, owner), one value and one text after another: live (start, end) of each row."""
    edge, found = "[A-Za-z0-9+_-]", []
    for n, (text, *_) in enumerate(rows):
        for kind, pattern, group, least in KINDS:
            found += [(n, m.end() - len(m[group]), m[group], True) for m in pattern.finditer(text) if len(m[group]) >= least]
        words = {(m.start(), m[0]) for p in (edge[:-1] + "/]+=*", edge + "+") for m in re.finditer(p.replace("-/]", "/-]"), text) if len(m[0]) >= 16}
        found += [(n, a, v, False) for a, v in words if re.search("[0-9]", v) and re.search("[A-Za-z]", v)]
    bare = lambda v: v.rstrip(".") if len(v.rstrip(".")) >= 6 else v
    found = [(n, a, bare(v), known) for n, a, v, known in found]
    lively = lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 8)
    owners, live, everywhere = defaultdict(set), defaultdict(set), defaultdict(set)
    known = {v for _, _, v, k in found if k}
    for n, _, v, _ in found:
        owners[v].add(rows[n][2])
    for v in {v for _, _, v, k in found if k or re.search("[=/.]", v)}:
        for n, (text, _, owner) in enumerate(rows):
            for m in re.finditer(f"(?<!{edge})(?={re.escape(v)}(?!{edge}))", text) if v in text else ():
                owners[v].add(owner)
                everywhere[v].add((n, m.start()))
    copied = {v for v in known if len(owners[v]) > 2}
    for v in owners:
        around = v not in known and "/" in v and copied & set(re.split("[=/]+", v))
        if lively(v) and len(owners[v]) <= 2 and not around:
            for n, a in everywhere[v] | {(n, a) for n, a, w, _ in found if w == v}:
                live[n].add((a, a + len(v)))
    return live


def test_live_spans_of_a_table_by_the_plain_rule(spark, docs, monkeypatch):
    given = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    path = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.01/documents.parquet"
    if os.path.exists(path):
        given += [tuple(r) for r in spark.read.parquet(path).select("doc_id", "text", "source", "lang").collect()]
    given = [(n, *r[1:]) for n, r in enumerate(given)]
    table = spark.createDataFrame(given, "doc_id long, text string, source string, lang string")
    want = plain_live([(t or "", None, s) for _, t, s, _ in given])
    assert want
    for few in (500_000, 0):  # told to all tasks, and joined by shuffles
        monkeypatch.setattr(secrets, "BROADCAST_ROWS", few)
        found, _ = find_secrets(table, F.col("source"), F.col("source"))
        assert {r.doc_id: {(s.start, s.end) for s in r.live} for r in found.collect() if r.live} == want


def test_secrets_of_a_very_long_text(spark):
    words = [sha256(str(i).encode()).hexdigest()[:34].replace("a", "G") for i in range(90_000)]
    text = "é" + " ".join(words)
    long = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    (row,) = secret_report(long, F.col("source"), F.col("source")).collect()
    assert len(text) > 3_000_000 and row.n_live > 85_000
    assert f"live:{1 + 35 * 1000}:{35 + 35 * 1000}" in row.spans
    (row,) = redact(long, F.col("source"), F.col("source")).collect()
    clean = row.text.removeprefix("é").split(" ")
    assert len(clean) == len(words) and all(c in (w, "[SECRET]") or "[SECRET]" in c for c, w in zip(clean, words)) and clean.count("[SECRET]") > 85_000


def test_running_values_and_replaced_spans(spark):
    numbers = [(list(range(n, 0, -1)),) for n in (0, 1, 31, 32, 33, 1024, 1025, 5000)]
    for join, plain in ((lambda a, b: a + b, lambda a, b: a + b), (F.greatest, max)):
        rows = spark.createDataFrame(numbers, "a array<int>").select("a", running(F.col("a"), join).alias("r")).collect()
        assert all(r.r == list(accumulate(r.a, plain)) for r in rows)
    text, spans = "é😀" + "ab\n" * 5000, [(0, 2), (1, 5), (5, 6), (4090, 8200), (8192, 8193), (15002, 15002)]
    keys = F.array(*[F.lit(a << 32 | b) for a, b in spans])
    got = spark.createDataFrame([(text,), ("",)], "t string").select(replaced(F.col("t"), keys, "#")).collect()
    assert got[0][0] == "##" + text[6:4090] + "#" + text[8200:] + "#"


def test_secrets_of_an_empty_table(docs):
    assert secret_report(docs.limit(0), F.col("source"), F.col("source")).collect() == []


def test_shards(docs, spark):
    rows = [(i, "same" * 30 if i % 3 == 0 else f"text {i} " * (i % 17), "x") for i in range(900)] + [(None, None, "x"), (5, "dup", "x"), (5, "dup", "x"), (7, "y" * 3000, "x")]
    found = shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 16).collect()
    assert len(found) == len(rows)
    total, sizes, slots = sum(r.size for r in found), defaultdict(int), defaultdict(list)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(s - total / 16) <= 3001 for s in sizes.values())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows if i is not None)
    assert shard(docs.limit(0), 16).collect() == []
    assert sorted(r.slot for r in shard(docs.limit(1), 16).collect()) == [0]


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_next_texts_across_buckets_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    monkeypatch.setattr(simhash, "RANGES", 4)
    ids = [None, 2, 2, 2, 2, 2, 2, 2, 2, *range(10, 40, 3), 1000, 10**9]
    rows = [(n, f"{k} word{k} " * (k % 5 + 1)) for k, n in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    ring = sorted(table.collect(), key=lambda r: (r.doc_id if r.doc_id is not None else -(1 << 63), r.h), reverse=True)
    want = [r.text[: len(r.text) - len(r.text) // 2] + n.text[: len(r.text) // 2] for r, n in zip(ring, ring[1:] + ring[:1])]
    got = simhash.edited(table.drop("h"))
    assert got.select("bucket").distinct().count() > 6 and sorted(r.edited for r in got.collect()) == sorted(want)
    report = fingerprint_report(table.drop("h")).select("doc_id", "edited_sha256").collect()
    assert sorted(r.edited_sha256 for r in report) == sorted(sha256(w.encode()).hexdigest() for w in want)


def test_fingerprints(docs):
    rows = fingerprint_report(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), every=3).collect()
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    order = sorted(texts, reverse=True)
    by = {r.doc_id: r for r in rows}
    assert set(by) == set(texts)
    for doc_id, after in zip(order, order[1:] + order[:1]):
        r, text = by[doc_id], texts[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert r.near_next == pytest.approx(1 - bits(r.fingerprint, by[after].fingerprint) / 64)
        assert r.near_edited == pytest.approx(1 - bits(r.fingerprint, r.edited_fingerprint) / 64)
        if doc_id % 3 == 0:
            assert r.n_within == sum(bits(r.fingerprint, x.fingerprint) <= 3 for x in rows)
        else:
            assert r.n_within is None


def test_fingerprints_are_the_plain_votes(spark):
    """Each bit by itself, from the hashes of the terms alone."""
    from pyspark.sql import functions as F

    from recollect.llm.simhash import fingerprints, shingles, terms

    texts = ["", "one two", "a b c d e f g", "a b c d e a b c d e a b c d e", "x " * 70, "É é, ½ q.r", " ".join(f"w{i % 13}" for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    hashed = {r.k: r.h for r in df.select("k", shingles(terms(F.col("t"))).alias("h")).collect()}
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        assert len(hashed[i]) == (max(1, len(words) - 4) if words else 0) and len(set(hashed[i])) == len({tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set())
    for r in fingerprints(df, ["k"], "t").collect():
        votes = [sum(1 if h >> b & 1 else -1 for h in hashed[r.k]) for b in range(64)]
        assert r.fingerprint & ((1 << 64) - 1) == sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_partners_within_the_radius(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {0: words, 1: words, 2: [*words[:-1], "other"], 3: words[::-1], 4: [*words[:200], "x", *words[201:]]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    rows = fingerprint_report(docs, every=2).collect()
    for r in rows:
        near = {x.doc_id for x in rows if bits(r.fingerprint, x.fingerprint) <= 3}
        if r.doc_id % 2:
            assert r.within is None
        else:
            assert {x.doc_id for x in rows if x.fingerprint in r.within} == near and r.within == sorted(set(r.within)) and r.n_within == len(near)
    assert {0, 1} <= {x.doc_id for r in rows if r.doc_id == 0 for x in rows if x.fingerprint in r.within}


def test_fingerprints_of_repeats_nulls_and_nothing(docs):
    assert fingerprint_report(docs).count() == len(TEXTS)
    assert fingerprint_report(docs.limit(0)).collect() == []
    one = fingerprint_report(docs.where("doc_id = 0").limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_hot_and_missing_ids_are_split(spark, monkeypatch):
    """Neighbours are those of the plain order, whatever the ranges and slices."""
    import random

    from recollect.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    monkeypatch.setattr(simhash, "RANGES", 6)
    draw = random.Random(9)
    rows = [(draw.choice([None, 7, 7, 7, i, i * 1000, -i]), f"text {i} {draw.random()} some more words") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = simhash._ordered(docs).select("id", "h", "bucket", "text").collect()
    ordered = sorted(placed, key=lambda r: (r.id, r.h))
    assert [r.bucket for r in ordered] == sorted(r.bucket for r in placed) and len({r.bucket for r in placed if r.id == 7}) > 3 and len({r.bucket for r in placed}) > 12
    down = [r.text for r in reversed(ordered)]
    want = sorted(sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest() for t, after in zip(down, down[1:] + down[:1]))
    assert sorted(r.edited_sha256 for r in fingerprint_report(docs).collect()) == want


@pytest.mark.parametrize("blocks", [None, 6, 8])
def test_radius_search_is_brute_force(spark, blocks):
    import random

    draw = random.Random(4)
    start = [draw.getrandbits(64) for _ in range(60)]
    some = start + [x ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 6))) for x in start for _ in range(3)]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in some]
    df = spark.createDataFrame(signed + [(None,)], "fingerprint long")
    got = {(r["query"], r.fingerprint): r.distance for r in within_radius(df.limit(200), df, 3, blocks).collect()}
    asked = {x for x, in signed[:200]}
    want = {(a, b): bin((a ^ b) & ((1 << 64) - 1)).count("1") for a in asked for b, in signed}
    assert got == {k: d for k, d in want.items() if d <= 3}
