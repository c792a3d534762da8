"""What a snapshot's tables hold, and whether tables read back are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n, digest) of each table: how many rows, and a digest that depends on all their columns and not on their order.

    The digest is the sum of the rows' 64-bit hashes, as a decimal, so that repeated rows count.
    """
    out = None
    for name, df in sorted(tables.items()):
        row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
        one = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest"))
        one = one.select(F.lit(name).alias("table"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def compare_manifests(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(table, stored_n, found_n, status): ok, changed, rows_lost, rows_added, or missing and unknown tables."""
    both = stored.select("table", F.col("n").alias("stored_n"), F.col("digest").alias("_s")).join(found.select("table", F.col("n").alias("found_n"), F.col("digest").alias("_f")), "table", "full")
    status = (
        F.when(F.col("found_n").isNull(), "missing").when(F.col("stored_n").isNull(), "unknown").when(F.col("found_n") < F.col("stored_n"), "rows_lost")
        .when(F.col("found_n") > F.col("stored_n"), "rows_added").when(F.col("_s") != F.col("_f"), "changed").otherwise("ok")
    )
    return both.select("table", "stored_n", "found_n", status.alias("status"))
