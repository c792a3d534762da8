"""Rank fusion and the retrieval that is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import QUERY_STOP_WORDS
from recollect.operators.lenses import lens_of
from recollect.operators.lexical import bm25_search
from recollect.operators.vectors import knn_search
from recollect.sources.shared import saved

RRF_K = 60
CHANNEL = 32


def rrf_fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """``ranked`` (query_id, list_no, rank1, id) as (query_id, id, score, rank1, lists).

    A hit scores the sum of 1 / (k + rank) over its lists; ties go to what comes first by list and rank.
    """
    fused = ranked.groupBy("query_id", "id").agg(
        F.sum(1.0 / (k + F.col("rank1"))).alias("score"), F.min(F.struct("list_no", "rank1")).alias("first"), F.sort_array(F.collect_set("list_no")).alias("lists")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", "id")
    return fused.withColumn("rank1", F.row_number().over(order)).drop("first")


def search(queries: DataFrame, memories: DataFrame, limit: int = 8, match: str = "all") -> DataFrame:
    """Hits of each query by the channels that it has: text (query), vector (embedding), or both by fusion.

    What the query's scope and lenses allow (see ``lenses.seen``) is held to in both channels.
    Returns query_id, id, score, rank1, bm25 and vector (which channels found it). Queries with neither
    give nothing; see ``search_reason``.
    """
    limit = min(limit, CHANNEL)
    width = max(CHANNEL, limit)
    lexical = bm25_search(queries.where(F.trim("query") != ""), memories, width, match).select("query_id", "id", "score", "rank1", F.lit(0).alias("list_no"))
    near = knn_search(queries, memories, width).select("query_id", "id", "score", "rank1", F.lit(1).alias("list_no"))
    both = saved(lexical.unionByName(near), "channels")  # ``width`` rows a query and channel, read twice
    fused = rrf_fuse(both)
    alone = queries.select("query_id", ((F.trim("query") != "") & F.col("embedding").isNotNull()).alias("hybrid"))
    scores = both.groupBy("query_id", "id").agg(F.max("score").alias("own"))
    hits = fused.join(scores, ["query_id", "id"]).join(alone, "query_id").where(F.col("rank1") <= limit)
    return hits.select(
        "query_id", "id", F.when(F.col("hybrid"), F.col("score")).otherwise(F.col("own")).alias("score"), "rank1",
        F.array_contains("lists", 0).alias("bm25"), F.array_contains("lists", 1).alias("vector"),
    )


def search_reason(query: Column, embedding: Column, lexical_only: bool = False) -> Column:
    """Which channels serve a query, or ``invalid``."""
    text, vector = F.trim(F.coalesce(query, F.lit(""))) != "", embedding.isNotNull()
    return (
        F.when(F.lit(lexical_only) & vector, "invalid").when(text & vector, "hybrid").when(text, "bm25").when(vector, "knn").otherwise("invalid")
    )


def rewrite_queries(queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, pass, query): the query, its words without stop words, and its longest word if that is long.

    Of longest words the last counts. Variants that repeat an earlier one are left out.
    """
    q = F.trim("query")
    words = F.filter(F.split(q, "[^A-Za-z0-9]+"), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*QUERY_STOP_WORDS))
    bag = F.array_join("words", " ")
    longest = F.array_max(F.transform("words", lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t"))))
    with_words = queries.where(q != "").select("query_id", q.alias("q"), words.alias("words"))
    with_variants = with_words.withColumn("longest", longest).select(
        "query_id",
        F.array_distinct(
            F.array_compact(F.array(F.col("q"), F.when(F.size("words") > 0, bag), F.when(F.col("longest.n") >= 6, F.col("longest.t"))))
        ).alias("variants"),
    )
    return with_variants.select("query_id", F.posexplode(F.slice("variants", 1, most)).alias("pass", "query"))


def hard_recall(queries: DataFrame, memories: DataFrame, limit: int = 8, passes: int = 3) -> DataFrame:
    """Hits over a query's rewritten passes, fused by rank; ``pre_score`` is the best score before fusion.

    The fused score stands only where more than one pass found anything.
    """
    variants = rewrite_queries(queries, passes)
    key = F.concat_ws("#", "query_id", "pass")
    asked = variants.join(queries.select("query_id", *lens_of(queries)), "query_id").withColumn("k", key)
    found = bm25_search(asked.drop("query_id").withColumnRenamed("k", "query_id"), memories, CHANNEL).withColumnRenamed("query_id", "k").join(asked.select("k", "query_id", "pass"), "k")
    width = F.when(F.col("pass") == 0, limit).otherwise(min(limit + 4, CHANNEL))
    found = found.where(F.col("rank1") <= width)
    fused = rrf_fuse(found.select("query_id", F.col("pass").alias("list_no"), "rank1", "id")).where(F.col("rank1") <= limit)
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("pre_score"))
    used = found.groupBy("query_id").agg(F.count_distinct("pass").alias("passes"))
    out = fused.join(best, ["query_id", "id"]).join(used, "query_id")
    return out.select("query_id", "id", "rank1", F.when(F.col("passes") > 1, F.col("score")).otherwise(F.col("pre_score")).alias("score"), "pre_score")


def abstain(queries: DataFrame, hits: DataFrame, min_hits: int = 1, min_score: float = 0.0, score: str = "score") -> DataFrame:
    """(query_id, n_hits, best, abstained) of every query, those without hits too."""
    per = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.max(score).alias("best"))
    out = queries.select("query_id").join(per, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    low = F.lit(min_score > 0) & (F.coalesce("best", F.lit(0.0)) < min_score)
    return out.withColumn("abstained", (F.col("n_hits") < min_hits) | low)


def attach_entities(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """``hits`` with the entity_links of their memories; graph says whether there are any."""
    out = hits.join(memories.select("id", "entity_links"), "id", "left")
    return out.withColumn("graph", F.coalesce(F.size("entity_links") > 0, F.lit(False)))


def iterative_requery(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """Two rounds: the second adds to the query the first four long words, sorted, of the top hit; ranks of round one first."""
    first = saved(bm25_search(queries, memories, k, "any"), "round-one")  # ``k`` rows a query, read twice
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 4)))
    top = first.where("rank1 = 1").join(memories.select("id", "text"), "id").select("query_id", F.array_join(F.slice(words, 1, 4), " ").alias("extra"))
    again = saved(queries.join(top, "query_id").select("query_id", *lens_of(queries), F.concat_ws(" ", "query", "extra").alias("query")), "asked-again")
    second = bm25_search(again, memories, k, "any")
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    best = both.groupBy("query_id", "id").agg(F.min(F.struct("round", "rank1")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "id")
    return best.withColumn("rank1", F.row_number().over(order)).where(F.col("rank1") <= k).select("query_id", "id", "rank1", F.col("at.round").alias("round"))


def channel_signals(hits: DataFrame, has_vector: Column, has_text: Column) -> DataFrame:
    """``hits`` (rrf?, bm25?, distance?) with which channels found them; a row with a fused score alone has those of its query."""
    fused = F.col("rrf").isNotNull() & F.col("bm25").isNull() & F.col("distance").isNull()
    return hits.withColumns({"vector": F.col("distance").isNotNull() | (fused & has_vector), "lexical": F.col("bm25").isNotNull() | (fused & has_text)})


def find_candidates(queries: DataFrame, memories: DataFrame, now: Column, limit: int = 8) -> DataFrame:
    """Open rows of a query's scope that its text may revise: a search at ``now`` without other lenses."""
    asked = queries.select("query_id", "query", "scope", "scope_match").withColumn("as_of", now)
    return bm25_search(asked, memories, limit, "any")
