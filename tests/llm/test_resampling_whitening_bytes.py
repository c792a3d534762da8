"""Importance resampling, whitening and the byte-level BPE against plain versions, SQL and the library."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from recollect.llm import importance, merge_queries, qdwh, queries, whitening
from recollect.llm.byte_bpe import encode_decode_bytes
from recollect.llm.crc_spans import crc32_spans
from recollect.llm.importance import numbered, resample
from recollect.llm.merge_queries import MergeQueries
from recollect.llm.whitening import whiten

DATA = "/root/testdata/sf0.001"


def test_checksums_of_spans():
    draw = np.random.default_rng(0)
    data = draw.integers(0, 256, 40_000, dtype="u1")
    cuts = np.sort(draw.choice(len(data), 4000, replace=False))
    starts, ends = cuts[::2], cuts[1::2]
    assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    for n in (1, 63, 64, 65, 128, 129, 4095, 30_001):
        assert crc32_spans(data, np.array([5]), np.array([5 + n])).tolist() == [zlib.crc32(data[5 : 5 + n].tobytes())]
    assert not len(crc32_spans(data, np.array([], "i8"), np.array([], "i8")))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resample(docs, target, least, share, buckets=10_000):
    bucket = lambda word: zlib.crc32(word.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for word in plain_words(text):
            s[bucket(word)] += 1
    for text in target:
        for word in plain_words(text):
            t[bucket(word)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words = plain_words(text)
        weight = sum(gain[bucket(w)] for w in words) // len(words) if words else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, row in enumerate(able[: share * len(able) // 100]):
        row[4] = i + 1
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("chunk", [importance.CHUNK_BYTES, 37])
def test_resampling_is_the_plain_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK_BYTES", chunk)
    words = "the House, and GREEN garden's 12 años über 中文字 x_y É ÀB".split()
    draw = np.random.default_rng(1)
    docs = [(i, " ".join(draw.choice(words, int(draw.integers(1, 40))))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "-- !!"), (103, "y" * 5000 + " z" * 30), (None, "the " * 25), (7, docs[7][1]), (7, docs[7][1]), (104, "a" * 64 + "," + "b" * 65)]
    target = ["the garden and the house", None, "", "12 años", "y" * 5000]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS score", "3 AS bucket", "4 AS weight", "5 AS place", "6 AS c0")
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = [tuple(r) for r in resample(df, bench, least_words=5, share=50).collect()]
    assert ordered(got) == ordered(plain_resample(docs, target, 5, 50))
    if chunk != 37:
        assert resample(df.limit(0), bench).collect() == []
        assert ordered(tuple(r) for r in resample(df, bench.limit(0), least_words=5).collect()) == ordered(plain_resample(docs, [], 5, 10))


def test_resampling_of_the_table_is_plain_and_sql(spark):
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    want = plain_resample(base.execute("SELECT doc_id, text FROM documents").fetchall(), [x for (x,) in base.execute("SELECT text FROM benchmark").fetchall()], 20, 10)
    df = queries.op12_resampling(spark, DATA)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    assert ordered(tuple(r) for r in df.collect()) == ordered(want) == ordered(base.execute(queries.SQL["op12_resampling"]).fetchall())


def test_numbers_of_a_hot_key(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("IF(id % 3 = 0, 5, id) AS key", "id AS place0")
    got = numbered(df, df.key).collect()
    assert sorted(r.place for r in got) == list(range(1, 3001))
    assert [r.key for r in sorted(got, key=lambda r: r.place)] == sorted(r.key for r in got)


@pytest.mark.parametrize("case", ["normal", "flat", "equal", "rank", "graded", "one", "two"])
def test_components_are_eigenvectors(case):
    draw = np.random.default_rng(4)
    turn, _ = np.linalg.qr(draw.standard_normal((24, 24)))
    a = {
        "normal": np.cov((draw.standard_normal((300, 24)) * np.linspace(1, 4, 24)).T), "flat": np.cov(draw.standard_normal((300, 24)).T),
        "equal": turn @ np.diag([5.0] * 6 + [2.0] * 12 + [0.5] * 6) @ turn.T, "rank": np.cov(draw.standard_normal((6, 24)).T),
        "graded": turn @ np.diag(np.logspace(6, -4, 24)) @ turn.T, "one": np.array([[3.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    }[case]
    values, vectors = qdwh.components(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    scale = np.linalg.norm(a)
    assert np.abs(values - want).max() < 1e-13 * scale
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13


def plain_whiten(rows, wanted=16):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dim in {len(v) for _, v in good}:
        fit = np.array(sorted({tuple(v) for _, v in good if len(v) == dim}), "i8")
        n, sums = len(fit), fit.sum(0)
        centred = fit - sums / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = [k for k in range(min(wanted, dim)) if values[k] > 1e-12 * values.sum()]
        for at, (i, v) in enumerate(good):
            if len(v) == dim:
                own = sum((n * x - int(s)) ** 2 for x, s in zip(v, sums))
                y = (np.array(v) - sums / n) @ vectors
                out.setdefault(i, []).extend((k + 1, n, own, y[k] / math.sqrt(values[k]), values[k] / values.sum()) for k in kept)
    return out


def held_to(found, rows, wanted=16):
    want = plain_whiten(rows, wanted)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, []).append((r.component, r.n, int(r.deviation), r.whitened, r.explained))
        assert 0 <= r.identity_error <= 1e-6
    assert got.keys() == want.keys()
    key = lambda x: (x[1], x[0], x[2], abs(x[3]))
    signs = {}
    for i in want:
        assert len(got[i]) == len(want[i])
        for g, w in zip(sorted(got[i], key=key), sorted(want[i], key=key)):
            assert g[:3] == w[:3] and abs(g[4] - w[4]) < 1e-9 and abs(abs(g[3]) - abs(w[3])) < 1e-6
            if abs(w[3]) > 1e-3:
                signs.setdefault((g[1], g[0]), set()).add(g[3] * w[3] > 0)
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def test_whitening_is_the_plain_one(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in draw.standard_normal(20) * np.linspace(0.3, 3, 20)]) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # a hot vector
    rows += [(2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [float("nan")] * 20), (2004, [float("inf")] + [0.0] * 19), (9, rows[8][1]), (9, rows[10][1])]
    rows += [(3000 + i, [float(c) for c in draw.standard_normal(3)]) for i in range(12)] + [(None, [0.5] * 20), (4000, [2.0] * 7), (4001, [2.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS dim", "3 AS n", "4 AS component", "5 AS i")
    held_to(whiten(df).collect(), [r for r in rows if r[1] is None or len(r[1]) != 7])  # equal vectors have no variance
    held_to(whiten(df, 2).collect(), [r for r in rows if r[1] is None or len(r[1]) != 7], 2)
    assert whiten(df.limit(0)).collect() == []


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = queries.op11_whitening(spark, DATA)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    held_to(df.collect(), rows)


def test_deviations_beyond_longs():
    x = np.array([[1_000_000 + (1 << 40), 1_000_003], [1_000_001, 1_000_002]])
    sums = [3_000_000_000_017, 2_999_999_999_999]
    model = whitening.Model(3_000_000, sums, np.array([1_000_000, 1_000_000]), None, None, None, 1.0)
    assert whitening.deviations(x, model) == [sum((3_000_000 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]


@pytest.fixture(scope="module")
def coder():
    return MergeQueries(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  ", "\n", " \n a", "a  b", "a \n\n b\t c", "it's we'll 'S x'd", "\x1c\x1d a\x85b", " x  y", "<|endoftext|> a", "é é रक्ष", "\x00a\x00 \x00", "1234567 12,345.67", "日本語のテキスト。中文", "👩‍👩‍👧 ok"]


def test_byte_bpe_is_the_librarys(coder):
    draw = np.random.default_rng(6)
    letters = lambda some, n: "".join(draw.choice(list(some), n))
    texts = ODD + ["a" * 3000, "ab" * 700, "aab" * 500, letters("abc", 2000), letters("abcdefghijklmnopqrstuvwxyz", 1500), " " * 900 + "x", "日本" * 400, letters("0123456789", 700), "=" * 1000]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}x {chr(c)} 1" for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    want = library(coder.ranks)
    assert coder.is_sound()
    for text, (ids, decoded) in zip(texts, coder.both(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text) and decoded == text.encode()


def test_long_words_without_a_sound_vocabulary(coder, monkeypatch):
    monkeypatch.setattr(coder, "sound", False)
    word = "thequickbrownfoxjumpsoverthelazydog" * 9
    ((ids, _),) = coder.both([word])
    assert np.frombuffer(ids, "<u4").tolist() == library(coder.ranks).encode_ordinary(word)


def test_forgetful_caches(coder, monkeypatch):
    for cache in (coder.words, coder.heads, coder.spaced):
        monkeypatch.setattr(cache, "kept", 3)
    monkeypatch.setattr(merge_queries, "CALL_WORDS", 5)
    want = library(coder.ranks)
    for low in range(0, 40, 10):
        texts = [f"unheardof{i} wordling{i % 7} zzyzx{i}" for i in range(low, low + 10)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in coder.both(texts)] == [want.encode_ordinary(t) for t in texts]


def test_byte_bpe_of_odd_rows(spark, coder):
    rows = [*enumerate(ODD), (None, "a b"), (3, "again"), (3, "again"), (99, None), (98, "x" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids", "3 AS word")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = [tuple(r) for r in encode_decode_bytes(df, path, public_tokenizers.PATTERN).collect()]
    want = library(coder.ranks)
    ids = [(i, want.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t in rows]
    assert ordered(got) == ordered((i, len(x), x, t) for i, x, t in ids)
    assert encode_decode_bytes(df.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_of_the_table(spark, coder):
    want = library(coder.ranks)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    told = []
    for doc_id, text in docs:
        ids = want.encode_ordinary(text or "")
        told.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(tuple(r) for r in queries.op13_byte_bpe(spark, DATA).collect()) == ordered(told)
