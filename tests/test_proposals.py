"""Proposals that stand, against a plain fold; components against a plain search."""

import random

from recollect.operators import consolidate
from recollect.operators.components import component_roots


def plain(pairs):
    out, kept, dropped = set(), set(), set()
    for group, pos, keep, drop in sorted(pairs, key=lambda p: (p[0], p[1])):
        if (group, drop) not in dropped | kept and (group, keep) not in dropped:
            kept.add((group, keep))
            dropped.add((group, drop))
            out.add((group, pos, keep, drop))
    return out


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "group string, pos long, keep string, drop string")


def test_proposals_are_the_plain_fold(spark):
    draw = random.Random(2)
    pairs = []
    for group in ("a", "b", "c"):
        ends = [tuple(draw.sample(range(60), 2)) for _ in range(150)]
        pairs += [(group, pos, f"m{k}", f"m{d}") for pos, (k, d) in enumerate(ends)]
    pairs += [("hub", i, "m0", f"m{i + 1}") for i in range(300)] + [("hub", 300, "m5", "m0"), ("self", 0, "m1", "m1"), ("self", 1, "m2", "m1")]
    pairs = [p for p in pairs if p[2] != p[3]]
    for rounds in (0, 2):
        got = {tuple(r) for r in consolidate.select_proposals(frame(spark, pairs), rounds).collect()}
        assert got == plain(pairs)
    assert consolidate.select_proposals(frame(spark, pairs).limit(0)).collect() == []


def test_proposals_are_numbered_by_ranges(spark, monkeypatch):
    draw = random.Random(6)
    pairs = [(draw.choice("aaaab"), f"m{draw.randrange(9)}", f"m{draw.randrange(99)}", f"m{i}") for i in range(500)]
    tables, plain_saved = {}, consolidate.saved
    monkeypatch.setattr(consolidate, "saved", lambda df, label: tables.setdefault(label, plain_saved(df, label)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in consolidate.numbered(spark.createDataFrame(pairs, "group string, earlier string, keep string, drop string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(g, n + 1, k, d) for g in "ab" for n, (_, _, k, d) in enumerate(sorted(p for p in pairs if p[0] == g))}
    assert tables["ranges"].where("group = 'a'").select("part").distinct().count() > 2


def test_a_long_chain_takes_few_jobs(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("'g' AS group", "id AS pos", "concat('m', id) AS keep", "concat('m', id + 1) AS drop")
    spark.sparkContext.setJobGroup("chain", "a long chain")
    try:
        stands = consolidate.select_proposals(chain)
        assert stands.count() == n // 2 and stands.where("pos % 2 = 1").count() == 0
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 500


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(500)] + [(7, 7), (2000, 2000)]
    want = {}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in links:
        want.setdefault(a, a)
        want.setdefault(b, b)
        low, high = sorted((find(a), find(b)))
        want[high] = low
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in want}
    assert component_roots(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_that_share_tokens_but_arent_similar_make_no_rows(spark):
    import random

    from recollect.operators.similar_sets import candidates

    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    sets = [sorted(draw.sample(words, draw.choice((20, 30, 90, 140)))) for _ in range(300)]
    sets += [sorted({*s, *draw.sample(words, 3)}) for s in sets[:40]] + [words, words[:240], words[:239], ["one"], ["one", "two"]]
    rows = [(i, ("a", "b")[i % 2], "semantic", s) for i, s in enumerate(sets)] + [(1000, None, "semantic", ["one"])]
    found = candidates(spark.createDataFrame(rows, "no long, scope string, category string, tokens array<string>"), 0.6)
    met = [tuple(r) for r in found.collect()]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if i % 2 == j % 2 and len({*sets[i]} & {*sets[j]}) >= 0.6 * len({*sets[i]} | {*sets[j]}) - 1e-9}
    assert alike <= set(met) and len(met) == len(set(met)) and len(met) < 3 * len(alike)
    one, two = zip(*[(i, j) for i, j in alike])
    assert max(one) >= 300 or max(two) >= 300
    assert candidates(spark.createDataFrame(rows[:0], "no long, scope string, category string, tokens array<string>"), 0.6).collect() == []
