"""Similar sets by waves of cells and chunks, against all pairs; what is shuffled grows with the sets, not with their pairs."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa

from recollect.operators import consolidate, similar_sets

SHAPE = "no long, scope string, category string, words string, row struct<id:string>"


def crowd(draw, n, words=100):
    base = [f"word{i}" for i in range(words)]
    return [sorted({*draw.sample(base, words - 4), f"own{i}"}) for i in range(n)]


def alike(sets, threshold=0.6):
    share = lambda a, b: len(a & b) / len(a | b)
    sets = [set(s) for s in sets]
    return {(i, j): share(sets[i], sets[j]) for j in range(len(sets)) for i in range(j) if share(sets[i], sets[j]) >= threshold}


def some_sets():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    sets = crowd(draw, 40) + [sorted(draw.sample(words, draw.choice((1, 2, 5, 9, 33, 60, 120, 300)))) for _ in range(260)]
    return sets + [sorted({*s, *draw.sample(words, len(s) // 6)}) for s in sets[40:140]]


def test_pairs_of_many_blocks_waves_and_cells_are_all_pairs(spark, monkeypatch):
    sets = some_sets()
    rows = [(i * 7, "a", "semantic", " ".join(s), (f"m{i}",)) for i, s in enumerate(sets)]
    waves, saved = [], similar_sets.saved
    monkeypatch.setattr(similar_sets, "saved", lambda df, label: saved(df, label) if label != "met" else waves.append(label) or saved(df, label))
    monkeypatch.setattr(similar_sets, "BLOCK_WORDS", 200)
    monkeypatch.setattr(similar_sets, "WAVE", 9)
    found = similar_sets.similar(spark.createDataFrame(rows, SHAPE), 0.6).collect()
    want = alike(sets)
    got = {tuple(sorted((int(r.a.id[1:]), int(r.b.id[1:])))): r.jaccard for r in found}
    assert got == want and len(found) == len(want) and len(waves) > 2


def test_cells_and_chunks_in_a_worker(monkeypatch):
    sets = [s for s in some_sets() if 36 <= len(s) < 166]  # classes 7 to 9
    monkeypatch.setattr(similar_sets, "TILE_COLUMNS", 8)
    monkeypatch.setattr(similar_sets, "CHUNK_TOKENS", 600)
    batch = pa.RecordBatch.from_pydict({"no": range(len(sets)), "scope": ["a"] * len(sets), "category": ["b"] * len(sets), "hashes": pa.array([[hash(w) % 2**63 for w in s] for s in sets], pa.list_(pa.int64()))})
    signed = list(similar_sets._signer(0.6)(iter([batch])))[0]
    kinds = sorted(set(signed["kind"].to_pylist()))
    assert kinds == [7, 8, 9]
    of = {k: signed.filter(pa.array([x == k for x in signed["kind"].to_pylist()])).select(["no", "n", "bits"]).to_struct_array() for k in kinds}
    met, pairs, members = [], 0, 0
    for upper in kinds:
        for lower in (upper, upper - 1):
            if lower in of:
                words = int(similar_sets._words(np.array(upper), 0.6))
                a, b = similar_sets._block(of[upper], words), similar_sets._block(of[lower], words)
                places = [np.concatenate(side) for side in zip(*similar_sets._met(a, None if upper == lower else b, 0.6))]
                for nos, x, y in similar_sets._chunks(a, b, *places) if places else ():
                    assert sum(len(sets[n]) for n in nos) <= 4 * 600 and (x < y).all()
                    met += zip(nos[x].tolist(), nos[y].tolist())
                    pairs, members = pairs + len(x), members + len(nos)
    want = alike(sets)
    assert set(want) <= set(met) and len(met) == len(set(met)) < 1.1 * len(want) and members < pairs / 2
    x, y = (np.array(side) for side in zip(*sorted(want)))
    assert similar_sets._common(pa.array(sets), x, y).tolist() == [len({*sets[i]} & {*sets[j]}) for i, j in zip(x, y)]


def test_a_crowd_of_near_copies_shuffles_sets_not_pairs(spark):
    texts = crowd(random.Random(4), 300)
    rows = [(f"m{i}", "s", "semantic", datetime(2024, 1, 1), " ".join(t)) for i, t in enumerate(texts)]
    memories = spark.createDataFrame(rows, "id string, scope string, category string, valid_from timestamp_ntz, text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert consolidate.near_duplicates(memories).count() == 300 * 299 // 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    mb = (shuffled() - before) / 1e6
    assert mb < 1, mb


def test_conflicts_of_values_and_negations(spark):
    same = "alpha beta gamma delta epsilon zeta eta theta"
    texts = {"a": same, "b": f"{same} port 80a", "c": f"{same} port 80a extra", "d": f"{same} port 90b", "e": f"{same} never extra"}
    rows = [(i, "s", "semantic", datetime(2024, 1, 1), t) for i, t in texts.items()]
    memories = spark.createDataFrame(rows, "id string, scope string, category string, valid_from timestamp_ntz, text string")
    got = {frozenset((r.keep, r.drop)): r.conflict for r in consolidate.near_duplicates(memories).collect()}
    want = {frozenset(p): "e" in p or p in ("bd", "cd") for p in ("ab", "ac", "ad", "ae", "bc", "bd", "be", "cd", "ce", "de")}
    assert got == {p: want[p] for p in got} and len(got) == 10


def test_pairs_have_the_scope_and_category_that_group_them(spark):
    rows = [(f"{s}{c}{i}", s, c, datetime(2024, 1, 1), f"alpha beta gamma delta {'epsilon' * (i % 2)}") for s in "st" for c in ("semantic", "episodic") for i in range(3)]
    memories = spark.createDataFrame(rows, "id string, scope string, category string, valid_from timestamp_ntz, text string")
    got = consolidate.near_duplicates(memories).collect()  # a pair of sets, and a copy
    assert len(got) == 8 and all(r.keep[:-1] == r.drop[:-1] == r.scope + r.category for r in got)
