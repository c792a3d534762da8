"""Packing hits into contexts under budgets, and the audit of what was inserted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STUB_CHARS = 64


def pack_context(hits: DataFrame, max_cards: int = 8, max_chars: int = 4800) -> DataFrame:
    """(query_id, rank1, id, form, used) of hits (query_id, rank1, id, text): whole cards in rank order while they fit, then stubs.

    Each choice depends on the room that earlier ones left, so a query's few hits are folded in one place.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        room, cards, out, later = max_chars, 0, [], []
        for row in rows.sort_values("rank1").itertuples(index=False):
            if cards < max_cards and row.cost <= room:
                room, cards = room - row.cost, cards + 1
                out.append((row.query_id, row.rank1, row.id, "card", row.cost))
            else:
                later.append(row)
        for row in later:
            if cards < max_cards and STUB_CHARS <= room:
                room, cards = room - STUB_CHARS, cards + 1
                out.append((row.query_id, row.rank1, row.id, "stub", STUB_CHARS))
        return pd.DataFrame(out, columns=["query_id", "rank1", "id", "form", "used"])

    sized = hits.select("query_id", "rank1", "id", F.octet_length("text").alias("cost"))
    kind = {c: sized.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    return sized.groupBy("query_id").applyInPandas(fill, f"query_id {kind['query_id']}, rank1 int, id {kind['id']}, form string, used long")


def pack_summary(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, cards, est_tokens, abstained) of every query."""
    per = packed.groupBy("query_id").agg(F.count("*").alias("cards"), F.ceil(F.sum("used") / 4).alias("est_tokens"))
    out = queries.select("query_id").join(per, "query_id", "left").na.fill(0, ["cards", "est_tokens"])
    return out.withColumn("abstained", F.col("cards") == 0)


def dispositions(hits: DataFrame, inventory: DataFrame, min_score: float) -> DataFrame:
    """``hits`` with disposition: already_in_context (any version, or this one), below_floor, or candidate."""
    held = inventory.select("query_id", "id", F.coalesce("version", F.lit(-1)).alias("_held")).distinct()
    held = held.groupBy("query_id", "id").agg(F.collect_set("_held").alias("_held"))
    rows = hits.join(held, ["query_id", "id"], "left")
    inside = F.coalesce(F.array_contains("_held", -1) | F.array_contains("_held", F.col("version")), F.lit(False))
    return rows.withColumn("disposition", F.when(inside, "already_in_context").when(F.col("score") < min_score, "below_floor").otherwise("candidate")).drop("_held")


def prepare_context(hits: DataFrame, inventory: DataFrame, min_score: float = 0.0, max_blocks: int = 8, max_chars: int = 4800) -> tuple[DataFrame, DataFrame]:
    """(blocks, proposals): candidates packed at 64 bytes more than their text each, with digests as block and proposal ids.

    A proposal's status is empty without hits, insufficient_evidence if none is a candidate, budget_exhausted
    if no block fits, partial if some don't, else ready.
    """
    rows = dispositions(hits, inventory, min_score)
    able = rows.where("disposition = 'candidate'").select("query_id", "rank1", "id", F.concat("text", F.repeat(F.lit(" "), 64)).alias("text"))
    packed = pack_context(able, max_blocks, max_chars).join(rows.select("query_id", "id", "version", "text"), ["query_id", "id"])
    excerpt = F.when(F.col("form") == "card", F.col("text")).otherwise("")
    blocks = packed.select("query_id", "rank1", "id", "form", "used", excerpt.alias("excerpt"), F.sha2(F.concat_ws("|", "id", "version", F.sha2(excerpt, 256)), 256).alias("block_id"))
    per = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank1", "block_id"))).alias("b"))
    per = per.select("query_id", F.size("b").alias("n_blocks"), F.sha2(F.array_join(F.transform("b", lambda x: x["block_id"]), ","), 256).alias("proposal_id"))
    counts = rows.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count_if(F.col("disposition") == "candidate").alias("n_able"))
    out = counts.join(per, "query_id", "left").na.fill(0, ["n_blocks"])
    status = F.when(F.col("n_able") == 0, "insufficient_evidence").when(F.col("n_blocks") == 0, "budget_exhausted").when(F.col("n_blocks") < F.col("n_able"), "partial").otherwise("ready")
    return blocks, out.withColumn("status", status)


def render_blocks(blocks: DataFrame) -> DataFrame:
    """(query_id, text): the selected blocks' texts in order."""
    rows = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank1", "excerpt"))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["excerpt"]), "\n\n").alias("text"))


def verify_insertions(acks: DataFrame, selected: DataFrame) -> DataFrame:
    """``acks`` (seq, proposal_id, inserted: array) with status, against ``selected`` (proposal_id, block_id).

    Unknown proposals and fabricated blocks are rejected; of the rest, a proposal's first counts, an equal
    one replays it and a different one conflicts.
    """
    sets = selected.groupBy("proposal_id").agg(F.collect_set("block_id").alias("_all"))
    rows = acks.join(sets, "proposal_id", "left")
    reason = F.when(F.col("_all").isNull(), "unknown_proposal").when(F.size(F.array_except("inserted", "_all")) > 0, "fabricated_block")
    rows = rows.withColumn("reason", reason)
    good = Window.partitionBy("proposal_id", F.col("reason").isNull()).orderBy("seq")
    first = F.first(F.array_sort("inserted")).over(good)
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.row_number().over(good) == 1, "accepted").when(F.array_sort("inserted") == first, "replayed").otherwise("conflict")
    return rows.withColumn("status", status).select("seq", "proposal_id", "status")
