"""Texts scanned as arrays against the plain rules."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions.text import analyze
from recollect.operators import lexical, text_scan

ODD = ["Le Éclair CAFÉ café2go", "İstanbul ıI ΣΟΦΟΣ ΑΣ'Α σας", "Ⅷ ½x ²", "日本語テキスト 東京 𝔘𝔫𝔦 𐐀𐐨", "a_b-c.d 12ab34", "Ŀ ŉ ſ ǅ ß ẞ ﬁ", "नमस्ते éte", "", None, "x" * 30, "\0a\0", "Ÿÿ" * 9]


@pytest.mark.parametrize("chunk", [1 << 18, 64, 7])
def test_counts_are_those_of_analysed_texts(spark, monkeypatch, chunk):
    draw = random.Random(5)
    texts = ODD + [" ".join(draw.choices([t for t in ODD if t], k=draw.randrange(1, 9))) + draw.choice(["", "é", "\n1"]) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.t for r in rows.select("id", analyze(F.col("text")).alias("t")).collect()}
    asked = sorted({t for ts in want.values() if ts for t in ts})[::2] + ["unknown"]
    monkeypatch.setattr(text_scan, "CHUNK", chunk)
    terms = text_scan.Terms(pa.array(asked))
    got = {}
    for low, high, tokens, held in terms.counted(pa.array(["?", *texts])[1:]):
        for i in range(low, high):
            got[i] = int(tokens[i - low]), {h["term"]: h["tf"] for h in held[i - low].as_py()}
    assert got == {i: (len(t or []), {a: t.count(a) for a in asked if a in t} if t else {}) for i, t in want.items()}
    assert text_scan.Terms(pa.array([], pa.string())).counted(pa.array(["a b"])).__next__()[2].tolist() == [2]


def test_terms_may_go_out_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(f"m{i}", f"w{i % 7} w{i % 5} w{i % 5} é") for i in range(200)] + [("n", None)], "id string, text string")
    queries = spark.createDataFrame([(i, f"w{i} É w{i + 2}") for i in range(6)], "query_id int, query string")
    found = lambda: sorted(tuple(r) for r in lexical.bm25_search(queries, rows, 4, "any").collect())
    want = found()
    monkeypatch.setattr(lexical, "MOST_TERMS", 3)
    assert found() == want and len(want) == 24


def test_a_search_reads_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(f"m{i}", f"red w{i}") for i in range(50)], "id string, text string").write.parquet(str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m"))
    found = lexical.bm25_search(spark.createDataFrame([(1, "w7")], "query_id int, query string"), rows, 3)
    (tmp_path / "m").rename(tmp_path / "gone")  # counted by now
    assert [r.id for r in found.collect()] == ["m7"]


@pytest.mark.parametrize("chunk", [1 << 18, 16, 5])
def test_pieces_are_found_as_by_brute_force(monkeypatch, chunk):
    draw = random.Random(2)
    text = lambda n: "".join(draw.choices("aaaab é\0", k=n))
    hays = [text(draw.randrange(0, 90)) for _ in range(60)] + ["a" * 200, "", None, "b"]
    full = [h for h in hays if h]
    needles = {text(draw.randrange(1, 6)) for _ in range(40)} | {"a" * n for n in (1, 15, 16, 17, 40, 199, 200, 201)}
    for _ in range(60):
        h = draw.choice(full)
        low = draw.randrange(len(h))
        needles.add(h[low : low + draw.randrange(1, 60)])
    needles = sorted(needles)
    monkeypatch.setattr(text_scan, "CHUNK", chunk)
    monkeypatch.setattr(text_scan, "PAIRS", 50)
    block = text_scan.Needles(pa.array(range(len(needles))), [n.encode() for n in needles])
    rows, of = block.within(pa.array(["x", *hays])[1:])
    got = list(zip(rows.tolist(), of.tolist()))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, h in enumerate(hays) for j, n in enumerate(needles) if h is not None and n in h}
    assert [len(x) for x in text_scan.Needles(pa.array([], pa.int32()), []).within(pa.array(hays))] == [0, 0]
