"""Scores of retrieval, citations and extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import normalised, text_match
from recollect.sources.derived import CATEGORIES
from recollect.sources.shared import saved


def search_to_gold(hits: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(probe, n_hits, found, expected, leaked) of probes (probe, expect, forbid: arrays of keys) and hits (probe, rank1, key)."""
    top = hits.where(F.col("rank1") <= k)
    per = top.groupBy("probe").agg(F.collect_set("key").alias("keys"), F.count("*").alias("n_hits"))
    rows = probes.join(per, "probe", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    return rows.select(
        *[c for c in probes.columns if c not in ("expect", "forbid")], F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.size(F.array_intersect("expect", "keys")).alias("found"), F.size("expect").alias("expected"), F.size(F.array_intersect("forbid", "keys")).alias("leaked"),
    )


def score_probes(hits: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(probe, ..., hit, recall): no leak and all expected keys, or, where a probe expects nothing, no hits at all."""
    rows = search_to_gold(hits, probes, k)
    clean = F.col("leaked") == 0
    hit = F.when(F.col("abstain"), clean & (F.col("n_hits") == 0)).otherwise(clean & (F.col("found") == F.col("expected")))
    return rows.withColumn("hit", hit).withColumn("recall", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("found") / F.col("expected")))


def tag_summary(rows: DataFrame) -> DataFrame:
    """(system, tag, n, hits, skipped)."""
    skipped = F.col("skipped")
    return rows.groupBy("system", "tag").agg(F.count_if(~skipped).alias("n"), F.count_if(~skipped & F.col("hit")).alias("hits"), F.count_if(skipped).alias("skipped"))


def latency_percentiles(rows: DataFrame, method: str = "round") -> DataFrame:
    """(system, p50, p95, max) of ms by index: ``round`` takes round(p * (n - 1)), ``floor`` n / 2 and n * 95 / 100.

    Equal values are counted first, then dealt out by ranges; a value's place is its range's base and the sum
    within the range, so that no task holds a system's values.
    """
    counted = rows.where("ms IS NOT NULL").groupBy("system", "ms").agg(F.count("*").alias("c"))
    dealt = saved(counted.repartitionByRange("system", "ms").withColumn("part", F.spark_partition_id()), "values")
    before = Window.partitionBy("system").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = dealt.groupBy("system", "part").agg(F.sum("c").alias("of_part"))
    bases = bases.withColumns({"base": F.coalesce(F.sum("of_part").over(before), F.lit(0)), "n": F.sum("of_part").over(Window.partitionBy("system"))})
    upto = Window.partitionBy("system", "part").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(bases, ["system", "part"]).withColumn("upto", F.col("base") + F.sum("c").over(upto))
    n = F.col("n")
    at = lambda p: F.floor(p * (n - 1) + 0.5) if method == "round" else F.floor(n * int(p * 100) / 100)
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(at(p), n - 1), F.col("ms")))
    return placed.groupBy("system").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max("ms").alias("max"))


def macro_precision_recall(rows: DataFrame) -> DataFrame:
    """(precision, recall, invented): unweighted means over scenarios, and how many invented a prior."""
    return rows.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count_if("invented").alias("invented"))


MOST_STRATEGIES = 1000


def expand_scores(hits: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(strategy, kind, recall, noise): recall over all hits, noise among the first ``k``, as means by strategy.

    Noise is a hit that is neither gold nor a seed. ``kind`` is overall, graph (min_depth over 0) or lexical.
    """
    per = hits.groupBy("strategy", "probe").agg(F.collect_set("key").alias("all"), F.collect_set(F.when(F.col("rank1") <= k, F.col("key"))).alias("top"))
    names = [r.strategy for r in hits.select("strategy").distinct().limit(MOST_STRATEGIES + 1).collect()]
    if len(names) > MOST_STRATEGIES:
        raise ValueError(f"more than {MOST_STRATEGIES} strategies")
    empty = F.array().cast("array<string>")
    every = probes.withColumn("strategy", F.explode(F.lit(sorted(names)).cast("array<string>") if names else empty))
    rows = every.join(per, ["strategy", "probe"], "left").withColumns({"all": F.coalesce("all", empty), "top": F.coalesce("top", empty)})
    scored = rows.select(
        "strategy", F.explode(F.array(F.lit("overall"), F.when(F.col("min_depth") > 0, "graph").otherwise("lexical"))).alias("kind"),
        (F.size(F.array_intersect("gold", "all")) / F.size("gold")).alias("recall"), F.size(F.array_except("top", F.array_union("gold", "seeds"))).alias("noise"),
    )
    return scored.groupBy("strategy", "kind").agg(F.avg("recall").alias("recall"), F.avg("noise").alias("noise"), F.count("*").alias("n"))


def parse_citations(answers: DataFrame) -> DataFrame:
    """``answers`` (raw) with used, abstained and body.

    ``USED`` lines name block ids, in brackets if there are any; ``ABSTAIN`` lines abstain; the rest is the body.
    """
    lines = F.split(F.coalesce("raw", F.lit("")), "\r?\n")
    mark = lambda s: F.trim(s).rlike(r"(?i)^USED(:|\[|$| [\p{L}\p{N}\[\],\-_ ]+$)")
    quits = lambda s: F.trim(s).rlike(r"(?i)^ABSTAIN(:|$)")

    def inner(s: Column) -> Column:
        t = F.trim(s)
        boxed = F.regexp_extract(t, r"\[(.*)\]", 1)
        after = F.when(F.contains(t, F.lit(":")), F.regexp_replace(t, "^[^:]*:", "")).otherwise(F.regexp_replace(t, "(?i)^[used]+", ""))
        return F.when(t.rlike(r"\[.*\]"), boxed).otherwise(after)

    ids = F.flatten(F.transform(F.filter("lines", mark), lambda s: F.split(inner(s), ",")))
    clean = F.filter(F.transform(ids, lambda x: F.regexp_replace(F.trim(x), r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", "")), lambda x: x != "")
    body = F.trim(F.array_join(F.filter("lines", lambda s: ~mark(s) & ~quits(s)), "\n"))
    rows = answers.withColumn("lines", lines)
    return rows.select(*answers.columns, clean.alias("used"), F.exists("lines", quits).alias("abstained"), body.alias("body"))


def score_citations(answers: DataFrame, blocks: DataFrame, gold: DataFrame) -> DataFrame:
    """A row for each probe: answers (probe, used, abstained, body, expect_abstain), blocks (probe, block_id, text), gold (probe, text, forbidden).

    Fraud is an id that wasn't presented; gold is supported by a used block that matches it.
    """
    presented = blocks.groupBy("probe").agg(F.collect_set("block_id").alias("ids"), F.count("*").alias("n_presented"), F.sum(F.floor(F.octet_length("text") / 4)).alias("est_tokens"))
    used = answers.select("probe", F.explode(F.array_distinct("used")).alias("block_id")).join(blocks, ["probe", "block_id"])
    facts = gold.where(~F.col("forbidden")).select("probe", F.monotonically_increasing_id().alias("g"), F.col("text").alias("fact"))
    supported = facts.join(used.select("probe", "text"), "probe").where(text_match(F.col("fact"), F.col("text"))).groupBy("probe").agg(F.count_distinct("fact").alias("gold_supported"))
    said = answers.select("probe", "body").join(gold, "probe").groupBy("probe").agg(
        F.coalesce(F.bool_or(~F.col("forbidden") & text_match(F.col("text"), F.col("body"))), F.lit(False)).alias("asserts"),
        F.coalesce(F.bool_or(F.col("forbidden") & text_match(F.col("text"), F.col("body"))), F.lit(False)).alias("says_forbidden"),
        F.count_if(~F.col("forbidden")).alias("n_gold"),
    )
    rows = answers.join(presented, "probe", "left").join(supported, "probe", "left").join(said, "probe", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_presented", "est_tokens", "gold_supported", "n_gold")} | {c: F.coalesce(c, F.lit(False)) for c in ("asserts", "says_forbidden")})
    fraud = F.array_sort(F.array_except("used", F.coalesce("ids", F.array().cast("array<string>"))))
    some, want = F.col("gold_supported") > 0, F.col("expect_abstain")
    forbidden = ~F.col("asserts") & F.col("says_forbidden")
    abstain_ok = F.when(want, F.col("abstained") & ~F.col("asserts") & ~forbidden)
    hit = ~want & F.col("asserts") & some
    passed = (F.size(fraud) == 0) & ~forbidden & F.when(want, abstain_ok).when(F.col("n_gold") == 0, True).otherwise(hit)
    return rows.select(
        "probe", fraud.alias("fraud"), "gold_supported", "n_gold", "n_presented", "est_tokens", hit.alias("fact_hit"), (~want & F.col("asserts") & ~some).alias("leak"),
        abstain_ok.alias("abstain_ok"), forbidden.alias("forbidden_asserted"), passed.alias("passed"),
    )


def leak_check(blobs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(probe, leaks): how many of a probe's forbidden sentences its text holds, after normalising."""
    met = blobs.join(forbidden.select("probe", F.col("text").alias("sentence")), "probe")
    return met.groupBy("probe").agg(F.count_if(F.contains(normalised(F.col("blob")), normalised(F.col("sentence")))).alias("leaks"))


def extract_gold(gold: DataFrame, episodes: DataFrame) -> DataFrame:
    """``gold`` (scenario, idx, op, text) as an extractor can be held to: supersedes are puts, and puts stay if the episode supports them."""
    words = lambda c: F.array_distinct(F.filter(F.split(normalised(c), " "), lambda w: F.length(w) > 3))
    rows = gold.join(episodes.select("scenario", F.col("text").alias("episode")), "scenario")
    w = words(F.col("text"))
    common = F.size(F.array_intersect(w, words(F.col("episode"))))
    put = F.col("op").isin("put", "supersede")
    supported = put & ((common >= 3) | (2 * common >= F.size(w)))
    return rows.select("scenario", "idx", F.when(supported, "put").when(put, "noop").otherwise(F.col("op")).alias("op"), "text")


def score_extraction(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(scenario, matched, n_pred, n_gold, precision, recall): each gold op, in order, takes the first free prediction that matches it.

    Candidate pairs are joined by scenario and kind; only their greedy choice is folded, a scenario at a time.
    """
    p = predicted.where("op <> 'noop'").select("scenario", F.col("idx").alias("p"), "op", F.col("text").alias("said"))
    g = gold.where("op <> 'noop'").select("scenario", F.col("idx").alias("g"), "op", F.col("text").alias("want"))
    pairs = g.join(p, ["scenario", "op"]).where(text_match(F.col("want"), F.col("said"))).select("scenario", "g", "p")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken, done = set(), set()
        for row in rows.sort_values(["g", "p"]).itertuples(index=False):
            if row.g not in done and row.p not in taken:
                done.add(row.g)
                taken.add(row.p)
        return pd.DataFrame({"scenario": [rows["scenario"].iloc[0]], "matched": [len(done)]})

    matched = pairs.groupBy("scenario").applyInPandas(choose, f"scenario {gold.schema['scenario'].dataType.simpleString()}, matched long")
    counts = lambda df, name: df.groupBy("scenario").agg(F.count("*").alias(name))
    rows = counts(g, "n_gold").join(counts(p, "n_pred"), "scenario", "full").join(matched, "scenario", "left").na.fill(0, ["matched", "n_pred", "n_gold"])
    share = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.col("matched") / F.col(n))
    return rows.select("scenario", "matched", "n_pred", "n_gold", share("n_pred").alias("precision"), share("n_gold").alias("recall"))


def validate_scenarios(scenarios: DataFrame, memories: DataFrame, probes: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """(scenario, violation): repeated ids, gold keys and probe names, and probes that expect unknown keys or, when they abstain, any.

    Where the columns are there, also categories that aren't known and times (texts) that don't parse, of
    memories and probes; and, without a scenario, each of ``patterns`` that no scenario's pattern is.
    """
    twice = lambda df, keys, what: df.groupBy(*keys).count().where("count > 1").select("scenario", F.lit(what).alias("violation"))
    expected = probes.select("scenario", F.explode(F.concat("expect", "forbid")).alias("key"))
    unknown = expected.join(memories.select("scenario", "key"), ["scenario", "key"], "left_anti").select("scenario", F.lit("unknown_key").alias("violation"))
    idle = probes.where(F.col("abstain") & (F.size("expect") > 0)).select("scenario", F.lit("abstain_expects").alias("violation"))
    out = twice(scenarios, ["scenario"], "repeated_scenario").unionByName(twice(memories, ["scenario", "key"], "repeated_key")).unionByName(twice(probes, ["scenario", "probe"], "repeated_probe"))
    out = out.unionByName(unknown).unionByName(idle)
    for rows in (memories, probes):
        if "category" in rows.columns:
            out = out.unionByName(rows.where(~F.col("category").isin(*CATEGORIES)).select("scenario", F.lit("unknown_category").alias("violation")))
        for c in ("valid_from", "valid_until", "known_at", "as_of", "known_as_of", "sys_as_of"):
            if c in rows.columns:
                bad = F.col(c).isNotNull() & F.try_to_timestamp(c).isNull()
                out = out.unionByName(rows.where(bad).select("scenario", F.lit(f"bad_{c}").alias("violation")))
    if patterns:
        named = scenarios.sparkSession.createDataFrame([(x,) for x in patterns], "pattern string")
        missing = named.join(scenarios.select("pattern"), "pattern", "left_anti")
        out = out.unionByName(missing.select(F.lit(None).cast(scenarios.schema["scenario"].dataType).alias("scenario"), F.concat(F.lit("no_exemplar:"), "pattern").alias("violation")))
    return out.distinct()


def passage_gold(passages: DataFrame, memories: DataFrame) -> DataFrame:
    """(probe, key) of memories that hold a passage (probe, query) verbatim, from within a word too; an empty passage is in every text."""
    from recollect.operators.text_gold import contained

    digest = F.sha2("query", 256)
    needles = passages.where("query IS NOT NULL").select(digest.alias("needle"), F.col("query").alias("text")).distinct()
    hays = memories.where("text IS NOT NULL").select(F.col("id").alias("hay"), "text")
    found = contained(needles, hays).join(passages.select("probe", digest.alias("needle")), "needle").select("probe", F.col("hay").alias("key"))
    empty = passages.where("query = ''").select("probe").crossJoin(hays.select(F.col("hay").alias("key")))  # such pairs are the result
    return found.unionByName(empty)


def run_probes(probes: DataFrame, memories: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(probe, n_hits, found, expected, hit, recall) of probes (query_id, query, lenses) searched and held against ``gold`` (probe, key)."""
    from recollect.operators.lexical import bm25_search

    hits = bm25_search(probes, memories, k, "any").select(F.col("query_id").alias("probe"), "rank1", F.col("id").alias("key"))
    empty = F.array().cast("array<string>")
    keys = gold.groupBy("probe").agg(F.collect_set("key").alias("expect"))
    rows = probes.select(F.col("query_id").alias("probe")).join(keys, "probe", "left").withColumns({"expect": F.coalesce("expect", empty), "forbid": empty})
    return score_probes(hits, rows.withColumn("abstain", F.size("expect") == 0), k)


def system_stats(rows: DataFrame) -> DataFrame:
    """(system, n, passed, fact_hits, p50, p95, max) of scored rows with ms, by the floor rule of percentiles."""
    sums = rows.groupBy("system").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if("fact_hit").alias("fact_hits"))
    return sums.join(latency_percentiles(rows, "floor"), "system", "left")
