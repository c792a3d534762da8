"""From conversations to memory operations."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import WRITER_CUES, fact_like

#: Operations and their fields.
FIELDS = {
    "put": {"op", "scope", "text", "category", "confidence", "source", "episodic", "idempotency_key"},
    "supersede": {"op", "prior_id", "expected_version", "scope", "text", "category", "confidence", "new"},
    "forget": {"op", "id", "scope", "expected_version", "hard", "at"},
    "noop": {"op", "reason"},
}
FENCE = re.compile(r"```[A-Za-z]*\s*\n?(.*?)```", re.S)


def episodes_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, text): ``role: text`` lines in turn order."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))


def infer_category(category: Column, episodic: Column, text: Column, prefer_semantic: bool = True) -> Column:
    """The given category, else episodic if flagged, else semantic if the text reads as a fact, else episodic."""
    fact = F.lit(prefer_semantic) & F.coalesce(fact_like(text), F.lit(False))
    return F.coalesce(category, F.when(F.coalesce(episodic, F.lit(False)), "episodic").when(fact, "semantic").otherwise("episodic"))


def provenance_kind(category: Column, supersede: Column) -> Column:
    return F.when(supersede, "fact_update").when(category.isin("semantic", "identity"), "fact").when(category == "episodic", "episode").otherwise(category)


def extract_ops(episodes: DataFrame) -> DataFrame:
    """(episode_id, idx, op, text, episodic, confidence): a put for each line with text; noop for a blank episode."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = episodes.select("episode_id", F.posexplode_outer(lines).alias("idx", "text"))
    some = F.col("text").isNotNull()
    return rows.select(
        "episode_id", F.coalesce("idx", F.lit(0)).alias("idx"), F.when(some, "put").otherwise("noop").alias("op"), "text",
        F.when(some, ~fact_like(F.col("text"), WRITER_CUES)).alias("episodic"), F.when(some, F.lit(0.85)).alias("confidence"),
    )


def _balanced(text: str) -> str | None:
    """The first balanced JSON array or object."""
    start = next((i for i, c in enumerate(text) if c in "[{"), None)
    if start is None:
        return None
    depth, quoted, escaped = 0, False, False
    for i, c in enumerate(text[start:], start):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a field twice")
    return out


def parse_ops(text: str | None) -> tuple[list[dict], str | None]:
    """Operations of a model's raw text, or why it is quarantined."""
    text = (text or "").strip()
    fenced = FENCE.search(text)
    for part in (text, fenced.group(1) if fenced else None, _balanced(text)):
        if not part:
            continue
        try:
            found = json.loads(part, object_pairs_hook=_once)
        except ValueError as e:
            if str(e) == "a field twice":
                return [], "duplicate_field"
            continue
        ops = found if isinstance(found, list) else [found]
        for op in ops:
            if not isinstance(op, dict) or op.get("op") not in FIELDS:
                return [], "unknown_op"
            if set(op) - FIELDS[op["op"]]:
                return [], "unknown_field"
        return ops, None
    return [], "no_json"


def parse_ops_text(texts: DataFrame) -> DataFrame:
    """(text_id, idx, op, body, reason): a row for each operation, or one with the reason of a quarantine."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["text_id"], batch["text"]):
                ops, reason = parse_ops(text)
                out += [(key, i, op["op"], json.dumps(op, sort_keys=True), None) for i, op in enumerate(ops)]
                if reason:
                    out.append((key, 0, None, None, reason))
            yield pd.DataFrame(out, columns=["text_id", "idx", "op", "body", "reason"])

    return texts.select("text_id", "text").mapInPandas(parse, "text_id long, idx int, op string, body string, reason string")


def ingest_compaction(episodes: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(op outcomes, trace events, checkpoints) of episodes (episode_id, scope, text) and summaries (episode_id, text).

    Lines become puts, checked as a batch and applied up to the first failure; each batch leaves a write
    event; a summary becomes a checkpoint only if all of its episode's operations went through.
    """
    from recollect.operators.revise import op_outcomes
    from recollect.operators.validation import checkpoint_filter, preflight_ops

    scope = episodes.select(F.col("episode_id").alias("batch_id"), "scope")
    ops = extract_ops(episodes).withColumnRenamed("episode_id", "batch_id").join(scope, "batch_id")
    ops = ops.withColumns({"active_scope": F.col("scope"), "id": F.lit(None).cast("string"), "expected_version": F.lit(None).cast("long")})
    checked = preflight_ops(ops).withColumns({"hard": F.lit(False), "failed": ~F.col("batch_ok")})
    done = op_outcomes(checked)
    batches = done.groupBy("batch_id").agg(F.count("*").alias("n_ops"), F.bool_and(F.col("status") == "ok").alias("ok"))
    events = batches.select("batch_id", F.lit("write").alias("kind"), "n_ops", "ok")
    kept = summaries.withColumnRenamed("episode_id", "batch_id").withColumn("force", F.lit(False)).join(batches.where("ok").select("batch_id"), "batch_id", "left_semi")
    return done.select("batch_id", "idx", "op", "status"), events, checkpoint_filter(kept).select("batch_id", "status")
