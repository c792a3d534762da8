"""Top-k search, language identification and the pipeline against plain versions and held-out accuracy."""

import math
import os
import sys

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import language, pivot_search
from recollect.llm.common import written
from recollect.llm.language import confident, identify
from recollect.llm.pivot_search import top_k

sys.path.insert(0, os.path.dirname(__file__))
from test_jaccard import plain_components  # noqa: E402


def plain(rows, k, queries):
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in sorted({i for i, _ in good if queries(i)}):
        x = min((v for i, v in good if i == q), key=lambda v: (len(v), v))
        own = next(at for at, (i, v) in enumerate(good) if i == q and v == x)
        found = sorted((-sum(a * b for a, b in zip(x, v)), i) for at, (i, v) in enumerate(good) if at != own and len(v) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK_ROWS", 16)
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in draw.standard_normal(8) * (5 if i % 7 == 0 else 1)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # a hot vector
    rows += [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, [1.0] * 3), (410, [0.0] * 8), (None, [1.0] * 8), (10, rows[4][1]), (7, rows[9][1]), (20, rows[20][1]), (30, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "2 AS x", "3 AS dim", "4 AS score", "5 AS asks", "6 AS row")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 10 == 0, 5).collect()))
    assert got == plain(rows, 5, lambda i: i % 10 == 0)


def test_top_k_of_a_hot_annulus_meets_in_bounded_keys(spark, monkeypatch):
    """Two thirds of all rows are one vector: results stay whole, and no key has more blocks or chunks than it may."""
    for name, value in {"BLOCK_ROWS": 16, "CHUNK_QUERIES": 2, "BLOCKS_PER_KEY": 3, "CHUNKS_PER_KEY": 2}.items():
        monkeypatch.setattr(pivot_search, name, value)
    seen, whole = [], pivot_search.met

    def spy(asked, index, annuli, chunks):
        pairs = whole(asked, index, annuli, chunks)
        each = asked.select("annulus", "chunk").join(index.select("annulus"), "annulus").count()
        per = pairs.groupBy("annulus", "span", "group").agg(F.count_distinct("ids").alias("blocks"), F.count_distinct("asked").alias("chunks"), F.count("*").alias("n")).collect()
        seen.append((each, per))
        return pairs

    monkeypatch.setattr(pivot_search, "met", spy)
    draw = np.random.default_rng(5)
    hot = [float(c) for c in draw.standard_normal(6)]
    rows = [(i, hot if i % 3 else [float(c) for c in draw.standard_normal(6)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 10 == 0, 4).collect()))
    assert got == plain(rows, 4, lambda i: i % 10 == 0)
    assert all(sum(r.n for r in per) == each for each, per in seen)
    assert all(r.blocks <= 3 and r.chunks <= 2 for _, per in seen for r in per)
    assert max(len({(r.span, r.group) for r in per}) for _, per in seen) > 4


def test_pivots_grow_with_the_rows():
    assert [pivot_search.pivots_for(n) for n in (0, 10**6, 10**8, 10**12)] == [32, 32, 156, 256]


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, 10).collect()] == [(0, 1, 1, 1024 * 1024)]
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert top_k(df, F.col("vec_id") > 100).collect() == []


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150 and sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(spark):
    rows = [(1, "the house and the garden", "en", "x"), (3, "das haus und der garten", "de", "x"), (2, None, "en", "x"), (4, "", None, "x"), (5, "123 !?", "de", "x"), (6, "½ ① Ⅷ", "de", "x"), (None, "the dog", None, "x"), (5, "x" * 50_000, "en", "x"), (5, "x" * 50_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").selectExpr("*", "1 AS lang_pred", "2 AS held_out", "3 AS _text")
    found = identify(df).collect()
    assert len(found) == len(rows)
    assert all(r.lang_pred in ("en", "de", "und") for r in found) and sum(r.lang_pred == "und" for r in found) == 4
    assert identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = confident(df)
    assert kept.columns == df.columns and kept.where("text IS NULL OR text = ''").count() == 0


def plain_features(text):
    """Counts of hashed n-grams, one at a time."""
    counts = {}
    points = [ord(c) for c in text.lower()]
    for order in (1, 2, 3):
        for i in range(len(points) - order + 1):
            h = order * 0x27D4EB2F & 0xFFFFFFFF
            for k in range(order):
                h = (h ^ points[i + k]) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[k] & 0xFFFFFFFF
                h ^= h >> 15
            counts[h % language.FEATURES] = counts.get(h % language.FEATURES, 0) + 1
    return counts


def test_language_model_is_the_plain_one(spark):
    """TF-IDF, FTRL with an elastic net, and temperature, coordinate by coordinate, on rows of which all are in the sample."""
    words = {"en": ["the", "house", "is", "old", "and", "green"], "de": ["das", "haus", "ist", "alt", "und", "braun"]}
    draw = np.random.default_rng(2)
    rows = [(" ".join(draw.choice(words[lang], 6)), lang) for lang in ("en", "de") for _ in range(8)]
    rows = sorted(set(rows))
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "text string, lang string")
    model = language.fit(df)
    assert model.labels == ["de", "en"]
    every = [*rows, rows[0], rows[0]]
    features = {text: plain_features(text) for text, _ in rows}
    df_of = {}
    for text, _ in every:
        for f in features[text]:
            df_of[f] = df_of.get(f, 0) + 1
    idf = lambda f: math.log((1 + len(every)) / (1 + df_of.get(f, 0))) + 1
    assert all(math.isclose(model.idf[f], idf(f)) for f in range(0, language.FEATURES, 7)) and all(math.isclose(model.idf[f], idf(f)) for f in df_of)

    def vector(text):
        x = {f: (1 + math.log(c)) * idf(f) for f, c in features[text].items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / length for f, v in x.items()}

    order = {r.text: r.h for r in df.select("text", F.xxhash64("text", F.lit(3)).alias("h")).collect()}
    examples = sorted(rows, key=lambda r: order[r[0]])
    z, n = {}, {}

    def weight(key):
        zi, ni = z.get(key, 0.0), n.get(key, 0.0)
        if abs(zi) <= language.L1:
            return 0.0
        return -(zi - math.copysign(language.L1, zi)) / ((language.BETA + math.sqrt(ni)) / language.ALPHA + language.L2)

    def scores(text):
        return [weight((-1, k)) + sum(v * weight((f, k)) for f, v in vector(text).items()) for k in range(2)]

    def probabilities(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    for _ in range(language.EPOCHS):
        for i, (text, lang) in enumerate(examples):
            if i % language.KEPT_BACK == 0:
                continue
            p = probabilities(scores(text))
            p[model.labels.index(lang)] -= 1
            steps = []
            for f, v in [*vector(text).items(), (-1, 1.0)]:
                for k in range(2):
                    g, ni = v * p[k], n.get((f, k), 0.0)
                    steps.append(((f, k), g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / language.ALPHA * weight((f, k)), ni + g * g))
            for key, dz, total in steps:
                z[key], n[key] = z.get(key, 0.0) + dz, total
    for f in df_of:
        assert np.allclose(model.weights[f], [weight((f, k)) for k in range(2)], atol=1e-5)
    assert np.allclose(model.bias, [weight((-1, k)) for k in range(2)], atol=1e-5)
    back = [(scores(text), model.labels.index(lang)) for text, lang in examples[:: language.KEPT_BACK]]
    losses = {t: -sum(math.log(max(probabilities([x / t for x in s])[k], 1e-12)) for s, k in back) for t in np.geomspace(0.05, 5, 60)}
    assert losses[min(losses, key=lambda t: abs(t - model.temperature))] <= min(losses.values()) + 1e-3


def test_one_text_of_many_copies_leaves_room_for_others(spark):
    rows = [("the same old words again", "en")] * 500 + [(f"eine andere zeile nummer {chr(97 + i)}", "de") for i in range(20)] + [(f"one more line number {chr(97 + i)}", "en") for i in range(20)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=40)
    assert model.predict("eine zeile")[0] == "de" and model.predict("more words")[0] == "en"


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats, clashing columns and an empty table pass all stages."""
    en, de = "the house and the garden are old and green", "das haus und der garten sind alt und braun"
    rows = [(i, f"{en} {i} {chr(97 + i)} {i * 7}", "en", "s", None) for i in range(12)] + [(20 + i, f"{de} {i} {chr(97 + i)} {i * 7}", "de", None, 3) for i in range(12)]
    rows += [(50, None, "en", "s", 0), (51, "", None, None, None), (None, en, "en", "s", 1), (None, en, "en", "s", 1), (52, "12 34", "de", "s", 5), (53, f"{en} token=a1b2c3d4e5f6g7h8 end", "en", "s", 9), (54, f"{de} " * 9000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "1 AS _mark", "2 AS _spans", "3 AS mark", "4 AS spans", "5 AS c0", "6 AS lang_pred", "7 AS size")
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        frames = [spark.read.parquet(str(tmp_path / name / "documents.parquet"))]
        for _, stage in corpus_pipeline.STAGES:
            frames.append(written(stage(spark, frames[-1], str(tmp_path / name)), "stage"))
        assert all(f.columns == docs.columns for f in frames[:4])
        pieces = corpus_pipeline.run(spark, str(tmp_path / name))
        assert pieces.columns == frames[4].columns and sorted(map(str, (r.doc_id for r in pieces.collect()))) == sorted(map(str, (r.doc_id for r in frames[4].collect())))
        if name == "none":
            assert all(f.count() == 0 for f in frames)
            continue
        told = {r.doc_id for r in frames[1].collect()}
        assert not told & {50, 51, 52} and {None, 53, 54} <= told
        kept = frames[2].collect()
        assert sum(r.doc_id is None for r in kept) == 1
        clean = {r.doc_id: r for r in frames[3].collect()}
        assert "a1b2c3d4e5f6g7h8" not in clean[53].text and clean[53].n_chars == len(clean[53].text) and clean[53]._mark == 1 and clean[53]._spans == 2


def test_pipeline(spark):
    """Each stage against what it must keep, on the driver's smallest documents."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], sf_dir), "stage"))
    told = frames[1].collect()
    assert set(r.doc_id for r in told) <= set(r.doc_id for r in docs.collect()) and len(told) >= 0.98 * docs.count()
    assert all(f.columns == docs.columns for f in frames[1:4])
    want = {c for _, _, c, _ in plain_components([(r.doc_id, r.text) for r in told], 5, 80)}
    kept = frames[2].collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)
    clean = frames[3].collect()
    assert sorted(r.doc_id for r in clean) == sorted(want) and all(r.n_chars == len(r.text) for r in clean if "[SECRET]" in r.text)
    assert not any("password=" in r.text for r in clean)
    pieces = frames[4].collect()
    assert {r.doc_id for r in pieces} == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)
