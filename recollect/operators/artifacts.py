"""Artifacts by content digest, their locations, and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEDIA_TYPE = "application/octet-stream"


def ingest_artifacts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, outcomes) of files (seq, scope, content, media_type?): a row for each (scope, digest), its first file's.

    Digests are SHA-256. Empty contents are refused.
    """
    rows = files.withColumn("digest", F.when(F.octet_length("content") > 0, F.sha2("content", 256)))
    first = Window.partitionBy("scope", "digest").orderBy("seq")
    numbered = rows.withColumn("_n", F.row_number().over(first))
    status = F.when(F.col("digest").isNull(), "empty").when(F.col("_n") == 1, "created").otherwise("replayed")
    outcomes = numbered.select("seq", "scope", "digest", status.alias("status"))
    made = numbered.where("digest IS NOT NULL AND _n = 1")
    return made.select("scope", "digest", F.coalesce("media_type", F.lit(MEDIA_TYPE)).alias("media_type"), F.octet_length("content").alias("bytes")), outcomes


def relocate_report(artifacts: DataFrame, sources: DataFrame, copies: DataFrame) -> DataFrame:
    """``artifacts`` (id, location) with outcome and reason, after hashing the files (location or digest, content) on both sides.

    A location ends in the 64 hexadecimal digits of its content; nothing stops the batch.
    """
    digest = F.regexp_extract("location", "([^/]*)$", 1)
    rows = artifacts.withColumn("digest", digest).withColumn("_named", F.col("digest").rlike("^[0-9a-f]{64}$"))
    source = sources.select("location", F.sha2("content", 256).alias("_source"))
    copied = copies.select(F.sha2("content", 256).alias("digest"), F.lit(True).alias("_copied")).distinct()
    rows = rows.join(source, "location", "left").join(copied, "digest", "left")
    reason = (
        F.when(~F.col("_named"), "bad_location").when(F.col("_source").isNull(), "source_missing").when(F.col("_source") != F.col("digest"), "digest_mismatch")
        .when(F.col("_copied").isNull(), "copy_missing")
    )
    return rows.select("id", "location", F.when(reason.isNull(), "copied").otherwise("failed").alias("outcome"), reason.alias("reason"))


def rebind_locations(artifacts: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, outcomes) of moves (seq, id, expected_location, location): a location changes where it is still the expected one.

    Of several good moves of an artifact the one of the lowest seq wins, the rest are ``conflict``.
    """
    found = moves.join(artifacts.select("id", F.col("location").alias("_at")), "id", "left")
    good = F.coalesce(F.col("_at") == F.col("expected_location"), F.lit(False))
    order = Window.partitionBy("id", good).orderBy("seq", "location")
    status = F.when(~good, "guard_rejected").when(F.row_number().over(order) == 1, "rebound").otherwise("conflict")
    outcomes = found.withColumn("status", status)
    won = outcomes.where("status = 'rebound'").select("id", F.col("location").alias("_to"))
    changed = artifacts.join(won, "id", "left").withColumn("location", F.coalesce("_to", "location")).select(artifacts.columns)
    return changed, outcomes.select("seq", "id", "status")


def ingest_spans(spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``spans`` (artifact, scope, start, end, unit) with reason, or null where they are good."""
    of = artifacts.select(F.col("id").alias("artifact"), F.col("scope").alias("_scope"))
    rows = spans.join(of, "artifact", "left")
    reason = (
        F.when(~F.col("unit").isin("byte", "line", "char"), "bad_unit").when((F.col("start") < 0) | (F.col("end") < F.col("start")), "bad_range")
        .when(F.col("_scope").isNull(), "not_found").when(F.col("_scope") != F.col("scope"), "scope_denied")
    )
    return rows.withColumn("reason", reason).drop("_scope")
