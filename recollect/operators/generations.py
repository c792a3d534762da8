"""Embedding generations: staging, coverage, activation, identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.validation import vector_reason

IDENTITY = ("family", "model", "dimension", "normalization", "encoding")


def stage_embeddings(vectors: DataFrame, items: DataFrame, memories: DataFrame, dim: int, status: str = "building") -> tuple[DataFrame, DataFrame]:
    """(vectors, outcomes): upserts (seq, generation, id, vector); the highest seq of a key stands.

    Unknown memories and wrong vectors are refused, and everything unless the generation is building.
    """
    known = memories.select("id", F.lit(True).alias("_known"))
    reason = F.coalesce(F.when(F.lit(status != "building"), "not_building"), F.when(F.col("_known").isNull(), "unknown_memory"), F.when(F.col("vector").isNull(), "embedding_empty"), vector_reason(F.col("vector"), dim))
    checked = items.join(known, "id", "left").withColumn("reason", reason)
    good = checked.where("reason IS NULL").groupBy("generation", "id").agg(F.max_by("vector", "seq").alias("vector"))
    kept = vectors.join(good.select("generation", "id"), ["generation", "id"], "left_anti")
    return kept.select("generation", "id", "vector").unionByName(good), checked.select("seq", "id", F.coalesce("reason", F.lit("staged")).alias("status"))


def generation_coverage(memories: DataFrame, vectors: DataFrame, generation: int) -> DataFrame:
    """Embedded memories without a vector of the generation."""
    staged = vectors.where(F.col("generation") == generation).select("id")
    return memories.where("embedding IS NOT NULL").select("id").join(staged, "id", "left_anti")


def embedded_count(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """(generation, embedded, expected, coverage); vectors of erased memories don't count."""
    expected = memories.where("embedding IS NOT NULL").agg(F.count("*").alias("expected"))
    live = vectors.join(memories.where("embedding IS NOT NULL").select("id"), "id", "left_semi")
    per = live.groupBy("generation").agg(F.count_distinct("id").alias("embedded"))
    return per.join(F.broadcast(expected)).withColumn("coverage", F.when(F.col("expected") > 0, F.col("embedded") / F.col("expected")).otherwise(1.0))


def activate_generation(memories: DataFrame, vectors: DataFrame, generations: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """(memories, generations) with the generation's vectors in place; both as they were if any memory lacks one.

    Whether it is refused is part of the plan: one count of missing vectors, broadcast to every row.
    """
    missing = generation_coverage(memories, vectors, generation).agg((F.count("*") == 0).alias("_whole"))
    staged = vectors.where(F.col("generation") == generation).select("id", F.col("vector").alias("_vector"))
    rows = memories.join(staged, "id", "left").join(F.broadcast(missing))
    swap = F.col("_whole") & F.col("embedding").isNotNull()
    out = rows.withColumn("embedding", F.when(swap, F.col("_vector")).otherwise(F.col("embedding"))).withColumn(
        "embedding_generation", F.when(swap, F.lit(generation).cast("long")).otherwise(F.col("embedding_generation"))
    )
    states = generations.join(F.broadcast(missing))
    turned = F.when(~F.col("_whole"), F.col("status")).when(F.col("generation") == generation, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status"))
    return out.select(memories.columns), states.withColumn("status", turned).select(generations.columns)


def reindex(memories: DataFrame, embed: Callable[[Column], Column], prefixes: list[str], generation: int) -> DataFrame:
    """(generation, id, vector) of every open memory under the scope prefixes, embedded anew; running it again gives the same."""
    under = F.lit(False)
    for prefix in prefixes:
        under = under | (F.col("scope") == prefix) | F.col("scope").startswith(f"{prefix}/")
    rows = memories.where(F.col("valid_until").isNull() & under)
    return rows.select(F.lit(generation).alias("generation"), "id", embed(F.col("text")).alias("vector"))


def identity_compatible(generations: DataFrame, claims: DataFrame) -> DataFrame:
    """``claims`` (claim, generation, identity columns) with status against the generations' identities.

    An identity that isn't known can be adopted while nothing is embedded.
    """
    own = generations.select("generation", "embedded", *[F.col(c).alias(f"_{c}") for c in IDENTITY])
    rows = claims.join(own, "generation", "left")
    unknown, same = F.lit(True), F.lit(True)
    for c in IDENTITY:
        unknown, same = unknown & F.col(f"_{c}").isNull(), same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = (
        F.when(F.col("embedded").isNull(), "not_found").when(unknown & (F.col("embedded") == 0), "adoptable").when(unknown, "unknown_identity")
        .when(same, "compatible").otherwise("incompatible")
    )
    return rows.select("claim", "generation", status.alias("status"))


def declare_generation(generations: DataFrame, claims: DataFrame) -> DataFrame:
    """``claims`` (seq) with the number that each would get: one more than the highest, refused while one is building, one at a time."""
    state = generations.agg(F.max("generation").alias("_top"), F.count_if(F.col("status") == "building").alias("_building"))
    first = claims.agg(F.min("seq").alias("_first"))
    rows = claims.join(F.broadcast(state)).join(F.broadcast(first))
    ok = (F.col("_building") == 0) & (F.col("seq") == F.col("_first"))
    return rows.select("seq", F.when(ok, F.coalesce("_top", F.lit(0)) + 1).alias("generation"), F.when(ok, "declared").otherwise("already_building").alias("status"))
