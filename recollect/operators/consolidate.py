"""Consolidation: near-duplicate memories, age-outs, capacity, probation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import ascii_tokens, collapsed, compared, negates, preview, values
from recollect.operators.components import component_roots
from recollect.operators.similar_sets import similar
from recollect.sources.shared import saved


def near_duplicates(memories: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(keep, drop, jaccard, conflict, earlier, scope, category) of pairs of one scope and category whose token sets are that similar.

    Rows of one scope, category and token set are a class; its first row in the order of keeping stands for
    it. Pairs are between the classes' first rows, and of each first row with every other row of its class:
    every similar pair of rows follows from these, and a crowd of copies gives as many pairs as it has rows.
    The longer text (in bytes) is kept; ties keep the row that is listed first, by valid_from and id
    descending. Rows of category uncertainty, or without tokens, take no part. Which sets may be similar is told
    by bitmaps; only for these are the tokens compared (see ``similar_sets``).
    """
    rows = memories.where("category <> 'uncertainty'").select(
        "id", "scope", "category", "valid_from", F.octet_length("text").alias("bytes"), negates(F.col("text")).alias("neg"), F.array_sort(F.array_distinct(ascii_tokens(F.col("text")))).alias("all"),
    )
    digest = F.when(F.size(values(F.col("all"))) > 0, F.sha2(F.array_join(values(F.col("all")), " "), 256))
    rows = rows.withColumns({"vals": digest, "words": F.array_join(compared(F.col("all")), " ")}).drop("all")
    identity = F.sha2(F.concat_ws("\u0000", "scope", "category", "words"), 256)
    rows = saved(rows.withColumn("set", identity), "token-sets").where("words <> ''")  # tested before it is written, texts would be taken apart twice
    standing = F.struct("bytes", "valid_from", "id", "neg", "vals", "scope", "category")
    sets = rows.groupBy("set").agg(F.first("scope").alias("scope"), F.first("category").alias("category"), F.first("words").alias("words"), F.max(standing).alias("row"))
    number = F.monotonically_increasing_id()  # fixed where it is written
    sets = saved(sets.withColumn("no", number), "sets")
    close = similar(sets, threshold)
    member = rows.select("set", standing.alias("b"))
    copies = sets.select("set", F.col("row").alias("a")).join(member, "set").where(F.col("a.id") != F.col("b.id")).select("a", "b", F.lit(1.0).alias("jaccard"))
    listed = lambda x: F.struct(f"{x}.valid_from", f"{x}.id")
    order = lambda x: F.struct(f"{x}.bytes", f"{x}.valid_from", f"{x}.id")
    keep_a = order("a") > order("b")
    differ = F.coalesce(F.col("a.vals") != F.col("b.vals"), F.lit(False))
    return close.unionByName(copies).select(
        F.when(keep_a, F.col("a.id")).otherwise(F.col("b.id")).alias("keep"), F.when(keep_a, F.col("b.id")).otherwise(F.col("a.id")).alias("drop"), "jaccard",
        ((F.col("a.neg") != F.col("b.neg")) | differ).alias("conflict"), F.when(listed("a") > listed("b"), F.col("a.id")).otherwise(F.col("b.id")).alias("earlier"),
        "a.scope", "a.category",
    )


ROUNDS = 2


def numbered(pairs: DataFrame) -> DataFrame:
    """``pairs`` (group, earlier, keep, drop) as (group, pos, keep, drop): pos is the place in the group by the other three, from 1.

    Pairs are dealt out by ranges; a pair's place is its range's base and the place within the range, so that no task holds a group.
    """
    order = ["earlier", "keep", "drop"]
    pairs = saved(pairs.select("group", *order), "proposals")  # read twice, for the ranges' bounds
    dealt = saved(pairs.repartitionByRange("group", *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = dealt.groupBy("group", "part").agg(F.count("*").alias("n")).select("group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy(*order))
    return dealt.withColumn("place", place).join(bases, ["group", "part"]).select("group", (F.col("base") + F.col("place")).alias("pos"), "keep", "drop")


def select_proposals(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pairs`` (group, pos, keep, drop) that stand in order: a dropped row is dropped once, a kept row is never dropped, nor the reverse.

    First ``rounds`` rounds over all groups at once: a pair that comes before all open pairs that it can't stand beside is
    taken, and open pairs that can't stand beside a taken one go. What is open then is told apart into
    components of pairs that share rows, and each component is one fold in order of pos: a chain in which
    each pair waits for the last costs the rounds of its components, which grow with the logarithm of its length, and one task
    of as many rows. Every step is written.
    """
    left = saved(pairs.select("group", "pos", "keep", "drop"), "open")
    out = left.limit(0)
    for _ in range(rounds):
        if not left.limit(1).count():
            return out
        taken, left = _round(left)
        out = out.unionByName(taken)
    return out.unionByName(_folded(left)) if left.limit(1).count() else out


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    dropped = left.groupBy("group", F.col("drop").alias("id")).agg(F.min("pos").alias("d"))
    kept = left.groupBy("group", F.col("keep").alias("id")).agg(F.min("pos").alias("k"))
    least = dropped.join(kept, ["group", "id"], "full")
    at = lambda side: least.select("group", F.col("id").alias(side), F.col("d").alias(f"{side}_d"), F.col("k").alias(f"{side}_k"))
    rows = left.join(at("keep"), ["group", "keep"]).join(at("drop"), ["group", "drop"])
    first = (F.col("pos") <= F.col("drop_d")) & (F.col("drop_k").isNull() | (F.col("pos") < F.col("drop_k"))) & (F.col("keep_d").isNull() | (F.col("pos") < F.col("keep_d")))
    taken = saved(rows.where(first).select("group", "pos", "keep", "drop"), "taken")
    gone, stays = taken.select("group", F.col("drop").alias("id")), taken.select("group", F.col("keep").alias("id"))
    for bad, side in ((gone.unionByName(stays), "drop"), (gone, "keep")):
        left = left.join(bad.withColumnRenamed("id", side).distinct(), ["group", side], "left_anti")
    return taken, saved(left.select("group", "pos", "keep", "drop"), "open")


def _folded(left: DataFrame) -> DataFrame:
    """Pairs that stand, by a fold of each component. Rows meet by 64-bit hashes: one that repeats would only join two components."""
    hashed = lambda side: F.xxhash64("group", side)
    roots = component_roots(left.select(hashed("keep").alias("a"), hashed("drop").alias("b")))
    rows = left.withColumn("node", hashed("keep")).join(roots, "node").select("root", "group", "pos", "keep", "drop")
    dealt = rows.repartition("root").sortWithinPartitions("root", "group", "pos")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, kept, dropped = None, set(), set()
        for batch in batches:
            stands = []
            for root, *ends in zip(*(batch.column(c).to_pylist() for c in ("root", "group", "keep", "drop"))):
                if root != component:
                    component, kept, dropped = root, set(), set()
                keep, drop = (ends[0], ends[1]), (ends[0], ends[2])
                good = drop not in dropped and drop not in kept and keep not in dropped
                if good:
                    kept.add(keep)
                    dropped.add(drop)
                stands.append(good)
            yield batch.drop_columns(["root"]).filter(pa.array(stands, pa.bool_()))

    return saved(dealt.mapInArrow(fold, left.schema), "folded")


def age_out(memories: DataFrame, now: Column, days: int | None) -> DataFrame:
    """(id, preview, reason) of episodic rows at least ``days`` old; all of them, for review, if there is no limit."""
    rows = memories.where("category = 'episodic'")
    if days is not None:
        rows = rows.where(F.col("valid_from") <= F.date_sub(now, 0) - F.expr(f"INTERVAL {days} DAYS"))
    return rows.select("id", preview(F.col("text"), 80).alias("preview"), F.lit("review" if days is None else "older").alias("reason"))


def sleep_report(memories: DataFrame, now: Column, days: int | None, proposals: DataFrame | None = None, most: int | None = None, apply: bool = False, approved: bool = False) -> tuple[DataFrame, DataFrame]:
    """(report, forget ops): near-duplicate proposals and age-outs; only age-outs become ops, and only with both flags."""
    aged = age_out(memories, now, days).select(F.lit("age_out_episodic").alias("op"), "id", F.col("reason"))
    report = aged if proposals is None else proposals.select(F.lit("near_duplicate").alias("op"), F.col("drop").alias("id"), F.col("keep").alias("reason")).unionByName(aged)
    if most is not None:
        report = report.orderBy(F.desc("op"), "id").limit(most)
    ops = report.where((F.col("op") == "age_out_episodic") & F.lit(apply and approved)).select("id", F.lit("soft_forget").alias("kind"))
    return report, ops


def capacity_report(memories: DataFrame, rows: int = 512, total: int = 256 * 1024, each: int = 1024) -> DataFrame:
    """(scope, n, bytes, oversized, over) of active rows by scope."""
    size = F.octet_length("text")
    per = memories.where("valid_until IS NULL").groupBy("scope").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(size > each).alias("oversized"))
    return per.withColumn("over", (F.col("n") > rows) | (F.col("bytes") > total))


def duplicate_identities(memories: DataFrame) -> DataFrame:
    """(scope, identity, n, first_id) of active texts that are equal but for case and white space."""
    rows = memories.where("valid_until IS NULL").groupBy("scope", F.md5(collapsed(F.col("text"))).alias("identity"))
    return rows.agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def prune_probation(memories: DataFrame, usage: DataFrame, now: Column, days: int = 7, hard: bool = False) -> DataFrame:
    """(id, kind) of forgets for active rows that were never used and whose probation has ended."""
    ended = memories.where(F.col("valid_until").isNull() & (F.col("valid_from") + F.expr(f"INTERVAL {days} DAYS") <= now))
    used = usage.where("used > 0").select(F.col("memory_id").alias("id"))
    return ended.join(used, "id", "left_anti").select("id", F.lit("hard_forget" if hard else "soft_forget").alias("kind"))
