"""The Jaccard join, components and shingles against brute force."""

import random
from itertools import combinations

import pytest

from recollect.llm import jaccard_join
from recollect.llm.components import components
from recollect.llm.jaccard_join import jaccard_components, one_of_each
from recollect.llm.shingles import shingle_sets

UPPER = {i: i + 32 for i in range(65, 91)}


def plain_set(text, words):
    found = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(UPPER)).split(" ") if w]
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def plain_components(rows, words, percent):
    sets = [plain_set(text, words) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
            links[i] += 1
            links[j] += 1
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(root(i)), links[i]) for i, (doc_id, _) in enumerate(rows)]


def corpus(seed, n=160):
    """Near copies in chains, a passage that many texts share, exact copies, short and empty texts."""
    draw = random.Random(seed)
    word = lambda: "w" + str(draw.randrange(4000))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        kind = draw.random()
        if rows and kind < 0.35:
            words = (draw.choice(rows)[1] or "x").split(" ")
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.6:
            own = [word() for _ in range(draw.randrange(3, 60))]
            text = " ".join(own + passage if draw.random() < 0.5 else passage + own)
        elif kind < 0.7:
            text = draw.choice(["", None, "A", "a", "one two", "ONE TWO", "one two three four", "é é\x1cé é"])
        else:
            text = " ".join(word() for _ in range(draw.randrange(1, 120)))
        rows.append((i * 3 % n, text))
    return rows + [(None, rows[5][1]), (0, rows[7][1]), (1, rows[3][1]), (1, rows[3][1])]


def got_of(spark, rows, words, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sid", "2 AS digest", "3 AS mark", "4 AS n")
    found = jaccard_components(docs, words, percent).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found), key=str)


@pytest.mark.parametrize("seed, words, percent", [(1, 4, 85), (2, 5, 80)])
def test_components_are_the_brute_force_ones(spark, seed, words, percent):
    rows = corpus(seed)
    assert got_of(spark, rows, words, percent) == sorted(plain_components(rows, words, percent), key=str)


def test_all_frequent_shingles_and_no_broadcasts(spark, monkeypatch):
    """Prefixes that go beyond what is stored, and the ways beyond the broadcasts' bounds."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    monkeypatch.setattr(jaccard_join, "checked", lambda small: small)
    monkeypatch.setattr(jaccard_join, "STORED", 1.0)
    rows = corpus(3, 120)
    assert got_of(spark, rows, 4, 85) == sorted(plain_components(rows, 4, 85), key=str)


def test_frequent_shingles_with_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    monkeypatch.setattr(jaccard_join, "STORED", 1.0)
    rows = corpus(4, 120)
    assert got_of(spark, rows, 4, 85) == sorted(plain_components(rows, 4, 85), key=str)


def crowd(seed, n=70, size=60):
    """Near copies of one text at all distances, some of them copied again, and two texts that share half of it."""
    draw = random.Random(seed)
    word = lambda: "w" + str(draw.randrange(4000))
    base = [word() for _ in range(size)]
    rows = [(0, " ".join(base)), (1, " ".join(base[: size // 2] + [word() for _ in range(size // 2)])), (2, " ".join([word() for _ in range(size // 2)] + base[size // 2 :]))]
    for i in range(3, n):
        words = list(draw.choice([base, base, base, draw.choice(rows)[1].split(" ")]))
        for _ in range(draw.randrange(0, 5)):
            at = draw.randrange(len(words))
            words[at : at + draw.randrange(0, 3)] = [word() for _ in range(draw.randrange(0, 3))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("members, columns", [(256, 4096), (4, 8)])
def test_crowds_of_near_copies(spark, monkeypatch, members, columns):
    """Links inside one group by its deltas, over several chunks, and between groups."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "COLUMNS", columns)
    rows = crowd(5) + [(1000 + i, text) for i, text in crowd(6, 30, 90)]
    assert got_of(spark, rows, 4, 85) == sorted(plain_components(rows, 4, 85), key=str)


def test_uncounted_components_are_the_same(spark):
    rows = crowd(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_components(docs, 5, 80, counted=False).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((x[0], x[2]) for x in plain_components(rows, 5, 80))
    assert {r.n_links for r in found} == {None}


def test_spanning_pairs_connect_what_all_do():
    import numpy as np

    for seed in range(20):
        linked = np.random.default_rng(seed).random((9, 7)) < 0.15
        got, wanted = np.zeros_like(linked), linked
        pairs = jaccard_join._spanning(linked)
        for r, c in pairs:
            assert linked[r, c]
            got[r, c] = True
        reach = lambda m: np.linalg.matrix_power(np.block([[np.eye(9, dtype=int), m.astype(int)], [m.T.astype(int), np.eye(7, dtype=int)]]), 20) > 0
        assert (reach(got) == reach(wanted)).all() and len(pairs) < 16


def test_empty_table(spark):
    assert got_of(spark, [], 4, 85) == []


def test_shingles_across_chunks():
    texts = ["A b\tc d e", "a  B c d\ne", "x", "", "\v\f", "long " * 50_000]
    found = shingle_sets(texts, 4)
    assert found[0].tolist() == found[1].tolist() and len(found[0]) == 2
    assert [len(x) for x in found[2:]] == [1, 0, 0, 1]


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 120)} == {100} and {got[i] for i in (200, 201, 202)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    copy = " ".join(f"w{i}" for i in range(30))
    rows = [(3, copy), (1, copy), (1, copy), (2, copy + " more"), (4, ""), (5, None), (6, "its own words here and now")]
    rows += [(None, None), (None, None), (7, "x"), (7, "x"), (7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id + 1 AS _mark", "2 AS id", "3 AS m", "4 AS stays", "5 AS c0")
    kept = one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r._mark) for r in kept.collect()))) == sorted(map(str, [(1, 2), (4, 5), (5, 6), (6, 7), (7, 8), (7, 8), (None, None)]))
