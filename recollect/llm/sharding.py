"""Shards of near equal bytes by sampled splitters, in DataFrame operations only.

Rows are ordered by the hash of their text and then by doc_id, so that equal texts stand together and a
hot text can still be split. A size-weighted sample of these keys gives quantile boundaries of fine ranges;
ranges that come out overfull are subdivided by a denser sample. Each row's place is its range's base, a
prefix sum of exact counts, plus a running sum within the range alone. Shards are cut at equal shares of
all bytes, and at the edge of a group of equal texts where one is near.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import text_or_empty, written

KEY = ("h", "id")
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the order key of each row; the texts themselves go no further."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
    )


def sampled_keys(rows: DataFrame, step: float) -> list[tuple[int, int]]:
    """Sorted keys of about one row for each ``step`` bytes: a row is drawn with odds of its size to step."""
    draw = (F.pmod(F.xxhash64("id", "h", F.lit(7)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return sorted((r.h, r.id) for r in rows.where(draw < F.col("size") / F.lit(step)).select(*KEY).distinct().collect())


def range_of(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of splitters at or below its key, as ``range``, by a binary search over literals."""
    return rows.withColumn("range", _place(splitters, 0, len(splitters)))


def _place(splitters: list[tuple[int, int]], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    h, i = splitters[mid]
    at_or_over = (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("id") >= F.lit(i)))
    return F.when(at_or_over, _place(splitters, mid + 1, high)).otherwise(_place(splitters, low, mid))


def shard(docs: DataFrame, shards: int = 16, ranges: int | None = None, tolerance: float = 0.01) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) in ``shards`` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; 1 if it is null), text_crc32, law (``bytes``),
    shard, slot (gapless from 0 in each shard) and grown_shard (null: this law has none). A shard
    ends within half a row's size of its share, plus ``tolerance`` of a share where a cut moves to the edge of a group of equal
    texts; larger groups are split. Rows that are equal, or share a doc_id, or have none, all stay. An
    empty table gives no rows; other columns are left alone. ``ranges`` is the number of fine ranges, by
    default at least 64 and that of shuffle partitions; the driver holds about 8 keys for each and no rows.
    """
    spark = docs.sparkSession
    rows = written(keyed(docs), "shard-keys")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(1.0, total / ranges)
    drawn = sampled_keys(rows, share / 8)
    splitters = sorted(set(drawn[8::8]))
    counted = range_of(rows, splitters).groupBy("range").agg(F.sum("size").alias("bytes")).collect()
    over = {r.range for r in counted if r.bytes > 2 * share}
    if over:  # subdivide the overfull ranges by a denser draw within them
        dense = sampled_keys(range_of(rows, splitters).where(F.col("range").isin(*over)), share / 64)
        splitters = sorted({*splitters, *dense[16::16]})
    placed = range_of(rows, splitters)
    sums = sorted(placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    bases, base_bytes, base_rows = [], 0, 0
    for r in sums:
        bases.append((r.range, base_bytes, base_rows))
        base_bytes, base_rows = base_bytes + r.bytes, base_rows + r.n
    base = spark.createDataFrame(bases, "range int, base_bytes long, base_rows long")
    within = Window.partitionBy("range").orderBy(*KEY, "text_crc32", "size")
    located = written(
        placed.withColumn("end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(base), "range")
        .select("doc_id", "size", "text_crc32", "h", (F.col("base_bytes") + F.col("end")).alias("end"), (F.col("base_rows") + F.col("nth") - 1).alias("row")),
        "shard-places",
    )
    cuts = _cuts(located, total, shards, tolerance)
    shard_of = F.lit(0)
    for cut in cuts:
        shard_of = shard_of + F.when(2 * F.col("end") - F.col("size") > F.lit(2 * cut), 1).otherwise(0)
    dealt = located.withColumn("shard", shard_of.cast("int"))
    first = {r.shard: r.first for r in dealt.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    start = F.coalesce(*[F.when(F.col("shard") == s, F.lit(f)) for s, f in first.items()], F.lit(0))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(located: DataFrame, total: int, shards: int, tolerance: float) -> list[int]:
    """The bytes at which shards end: equal shares, or the nearer edge of the group of equal texts there."""
    even = [round(total * i / shards) for i in range(1, shards)]
    crossing = [(F.col("end") - F.col("size") < F.lit(c)) & (F.col("end") >= F.lit(c)) for c in even]
    some = crossing[0] if crossing else F.lit(False)
    for c in crossing[1:]:
        some = some | c
    hashes = [r.h for r in located.where(some).select("h").distinct().collect()]  # at most one a cut
    if not hashes:
        return even
    edges = located.where(F.col("h").isin(*hashes)).groupBy("h").agg(F.min(F.col("end") - F.col("size")).alias("low"), F.max("end").alias("high"))
    groups = sorted((r.low, r.high) for r in edges.collect())
    near = tolerance * total / shards
    cuts = []
    for c in even:
        at = bisect_right(groups, (c, 1 << 62)) - 1
        if at >= 0 and groups[at][0] < c < groups[at][1]:
            edge = min(groups[at], key=lambda x: abs(x - c))
            c = edge if abs(edge - c) <= near else c
        cuts.append(c)
    return cuts
