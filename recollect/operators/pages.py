"""Pages of many requests at once, each from its own cursor.

Rows and cursors are sorted together by ranges, and counts of the ranges before give each its place in its
scope's order; a page is then the rows of places after its cursor's. No scope, however large, is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scopes import ancestors
from recollect.sources.shared import saved

SLOT = 64
MOST = 512


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (scope, valid_from, id, cursor: boolean and others) with place: how many rows that are no cursors stand at or before it, newest first, in its scope."""
    order = [F.col("scope").asc(), F.col("valid_from").desc(), F.col("id").desc(), F.col("cursor").asc()]
    dealt = saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("scope", "range").agg(F.count_if(~F.col("cursor")).alias("n"))
    before = Window.partitionBy("scope").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = counts.select("scope", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("scope")).alias("total"))
    upto = Window.partitionBy("range", "scope").orderBy(F.desc("valid_from"), F.desc("id"), "cursor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(F.when(F.col("cursor"), 0).otherwise(1)).over(upto)
    return dealt.withColumn("own", own).join(bases, ["scope", "range"]).withColumn("place", F.col("base") + F.col("own")).drop("range", "own", "base")


def pages(rows: DataFrame, requests: DataFrame, prefix: bool = True) -> DataFrame:
    """(request_id, pos, id, more) of each request's page of ``rows`` (id, scope, valid_from), newest first, by id descending among equals.

    ``requests`` has request_id, scope, limit (1 to 512; null is 64) and the cursor (after_from, after_id) of
    the last row that was seen, null for the first page; the row itself need not be there any more. With
    ``prefix`` a scope has the rows below it too. more says whether rows are left after the page; its last
    row's valid_from and id are the next cursor. Scopes without rows give none.
    """
    asked = saved(requests.select("request_id", "scope", F.greatest(F.lit(1), F.least(F.coalesce("limit", F.lit(SLOT)), F.lit(MOST))).cast("long").alias("limit"), "after_from", "after_id"), "requests")
    of = ancestors(F.col("scope")) if prefix else F.array("scope")
    own = rows.select("id", "valid_from", F.explode(of).alias("scope")).join(asked.select("scope").distinct(), "scope", "left_semi")
    listed = own.select("scope", "valid_from", "id", F.lit(False).alias("cursor"))
    cursors = asked.where("after_id IS NOT NULL").select("scope", F.col("after_from").alias("valid_from"), F.col("after_id").alias("id"), F.lit(True).alias("cursor")).distinct()
    placed = saved(_placed(listed.unionByName(cursors)), "placed")
    starts = placed.where("cursor").select("scope", F.col("valid_from").alias("after_from"), F.col("id").alias("after_id"), F.col("place").alias("start"))
    totals = placed.groupBy("scope").agg(F.max("total").alias("total"))
    begun = asked.join(starts, ["scope", "after_from", "after_id"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    slots = F.sequence(F.floor(F.col("start") / SLOT), F.floor((F.col("start") + F.col("limit") - 1) / SLOT))
    begun = begun.join(totals, "scope").withColumn("slot", F.explode(slots))
    at = placed.where("NOT cursor").select("scope", "id", F.col("place"), F.floor((F.col("place") - 1) / SLOT).alias("slot"))
    met = begun.join(at, ["scope", "slot"]).where((F.col("place") > F.col("start")) & (F.col("place") <= F.col("start") + F.col("limit")))
    return met.select("request_id", (F.col("place") - F.col("start")).alias("pos"), "id", (F.col("total") > F.col("start") + F.col("limit")).alias("more"))
