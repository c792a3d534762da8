"""Checks that split requests into accepted and quarantined ones, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scopes import scope_reason
from recollect.functions.text import CHATTER

TEXT_BYTES = 8192
ATTRS_BYTES = 4096
KEY_BYTES = 256


def vector_reason(embedding: Column, dim: int) -> Column:
    """Why a vector is refused, or null; a missing vector is fine."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(embedding.isNull(), None).when(F.size(embedding) == 0, "embedding_empty")
        .when(F.size(embedding) != dim, "embedding_dimension").when(~finite, "embedding_not_finite")
    )


def put_reason(dim: int = 64) -> Column:
    """The first rule that a put (scope, category, text, attrs, confidence, embedding, key, valid_from, valid_until) breaks."""
    c = F.col
    return F.coalesce(
        F.when(scope_reason(c("scope")).isNotNull(), "bad_scope"),
        F.when(F.octet_length("text") > TEXT_BYTES, "text_too_large"),
        F.when(F.octet_length("attrs") > ATTRS_BYTES, "attrs_too_large"),
        F.when((c("category") != "trace") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "blank_text"),
        F.when(F.isnan("confidence") | (c("confidence") < 0) | (c("confidence") > 1), "confidence_out_of_range"),
        vector_reason(c("embedding"), dim),
        F.when((F.trim("key") == "") | (F.octet_length("key") > KEY_BYTES), "bad_key"),
        F.when(c("valid_until") < c("valid_from"), "interval_reversed"),
    )


def validate_puts(puts: DataFrame, dim: int = 64) -> DataFrame:
    """``puts`` with reason: null where accepted."""
    return puts.withColumn("reason", put_reason(dim))


def preflight_ops(ops: DataFrame, most: int = 128, versioned_forgets: bool = True) -> DataFrame:
    """``ops`` (batch_id, idx, op, scope, active_scope, text, id, expected_version) with reason and batch_ok.

    One bad op refuses its whole batch, as do too many ops.
    """
    c = F.col
    reason = F.coalesce(
        F.when((c("op") != "noop") & (c("scope") != c("active_scope")), "foreign_scope"),
        F.when(c("op").isin("put", "supersede") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "blank_text"),
        F.when(c("op").isin("supersede", "forget") & (F.trim(F.coalesce("id", F.lit(""))) == ""), "blank_id"),
        F.when(F.lit(versioned_forgets) & (c("op") == "forget") & c("expected_version").isNull(), "version_required"),
    )
    batch = Window.partitionBy("batch_id")
    checked = ops.withColumn("reason", reason)
    return checked.withColumn("batch_ok", F.max("reason").over(batch).isNull() & (F.count("*").over(batch) <= most))


def checkpoint_filter(summaries: DataFrame, least_chars: int = 12) -> DataFrame:
    """``summaries`` (text, force) with status: stored, or why it is skipped."""
    text = F.trim("text")
    low = F.lower(text)
    chatter = low.isin(*CHATTER) | ((F.size(F.split(low, r"\s+")) <= 2) & (F.octet_length(low) < 16))
    force = F.coalesce("force", F.lit(False))
    return summaries.withColumn(
        "status",
        F.when(text.isNull() | (text == ""), "empty").when(~force & (F.length(text) < least_chars), "short")
        .when(~force & chatter, "chatter").otherwise("stored"),
    )
