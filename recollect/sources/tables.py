"""Typed readers and writers of the library's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.scopes import scope_root

PROVENANCE = "STRUCT<source: STRING, kind: STRING, span: STRING>"
MEMORY = (
    "id STRING, category STRING, scope STRING, content STRUCT<text: STRING, attrs: STRING>, embedding ARRAY<FLOAT>, embedding_generation LONG, "
    f"valid_from TIMESTAMP, valid_until TIMESTAMP, known_at TIMESTAMP, confidence DOUBLE, provenance {PROVENANCE}, version LONG, supersedes STRING, "
    "superseded_by STRING, entity_links ARRAY<STRING>, stale BOOLEAN, extractor_version STRING, model_version STRING, idempotency_key STRING, "
    "valid_rev_from LONG, valid_rev_until LONG, sys_created TIMESTAMP, sys_updated TIMESTAMP, sys_closed TIMESTAMP"
)
_PROBE = (
    "STRUCT<name: STRING, query: STRING, scope: STRING, scope_match: STRING, limit: INT, expect_keys_in_top: ARRAY<STRING>, must_not_include_keys: ARRAY<STRING>, "
    "embedding_from: STRING, require_vector: BOOLEAN, tag: STRING, as_of: STRING, known_as_of: STRING, sys_as_of: STRING, expect_abstain: BOOLEAN, category: STRING>"
)
_GOLD = "STRUCT<key: STRING, scope: STRING, text: STRING, category: STRING, with_embedding: BOOLEAN, valid_from: STRING, valid_until: STRING, known_at: STRING>"
_OP = "STRUCT<op: STRING, scope: STRING, text: STRING, category: STRING, confidence: DOUBLE, prior_id: STRING>"
SCENARIO = f"id STRING, pattern STRING, scope STRING, transcript ARRAY<STRUCT<role: STRING, text: STRING>>, gold_ops ARRAY<{_OP}>, gold_memories ARRAY<{_GOLD}>, probes ARRAY<{_PROBE}>"
WRITE_CASE = (
    "name STRING, scope STRING, episode STRING, ops_json STRING, use_rule_writer BOOLEAN, expect_stored BOOLEAN, expect_noop_only BOOLEAN, "
    "expect_preview_contains STRING, recall_query STRING, recall_must_contain STRING, recall_must_not_contain STRING, expect_ops_parse BOOLEAN"
)


def read_memories(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The memory table with its full field list. A field that isn't in the list is an error."""
    schema = T._parse_datatype_string(MEMORY)
    found = spark.read.format(fmt).load(path).columns
    extra = set(found) - set(schema.names) - {"scope_root"}
    if extra:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    rows = spark.read.schema(schema).format(fmt).load(path)
    return rows.select(schema.names)


def write_memories(memories: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each scope root; with dynamic partition overwrite only touched roots are written anew."""
    rows = memories.withColumn("scope_root", scope_root(F.col("scope")))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("scope_root").parquet(path)


def read_scenarios(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Scenario files, an object each, as frames: transcript, gold_ops, gold_memories, probes; ordered by file name."""
    rows = spark.read.option("multiLine", True).schema(SCENARIO).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    out = {"scenarios": rows.select("id", "pattern", "scope", "file").orderBy("file")}
    for name in ("transcript", "gold_ops", "gold_memories", "probes"):
        out[name] = rows.select(F.col("id").alias("scenario"), "file", F.posexplode(name).alias("idx", "x")).select("scenario", "file", "idx", "x.*")
    return out


def read_write_cases(spark: SparkSession, path: str) -> DataFrame:
    """Write cases, a JSON object a line."""
    return spark.read.schema(WRITE_CASE).json(path)
