"""Importance resampling of documents towards a target distribution of hashed words.

Words are hashed into buckets by CRC-32; a bucket's gain is the logarithm of its smoothed share in the target
over that in the documents, a document's weight the mean gain of its words, and Gumbel noise by a hash of
its id turns the highest scores into a draw without replacement. Texts are read twice and never shuffled: once for
the buckets' counts, once for the weights; only ids and scores are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import sliced, text_or_empty, written
from recollect.llm.crc_spans import crc32_spans

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10  # percent
SEED = 2024
CHUNK_BYTES = 1 << 20

#: Bytes of words: digits, letters, and all bytes of characters beyond ASCII. A to Z become a to z first.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[0x41:0x5B] += 0x20


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, rows) of parts of about ``CHUNK_BYTES``: texts, or parts of a long text cut outside words."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "u1")
    row, at = 0, int(offsets[0])
    while row < len(column):
        last = max(int(np.searchsorted(offsets, at + CHUNK_BYTES, "right")) - 1, row)
        if last > row:  # whole texts, but for the first, of which the rest is left
            end = int(offsets[last])
            yield data[at:end], np.concatenate([[0], offsets[row + 1 : last] - at]), np.arange(row, last)
            row, at = last, end
            continue
        stop, end = int(offsets[row + 1]), at + CHUNK_BYTES
        while end < stop:
            outside = np.flatnonzero(~_WORD[data[end : min(end + CHUNK_BYTES, stop)]])
            if len(outside):
                end += int(outside[0])
                break
            end += CHUNK_BYTES
        end = min(end, stop)
        yield data[at:end], np.zeros(1, "i8"), np.array([row])
        row, at = (row + 1, stop) if end == stop else (row, end)


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, CRC-32) of all words of a batch's texts, part by part; rows are the texts' places in the batch."""
    for data, starts, rows in _chunks(column):
        inside = _WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        # A word ends with its text. Where the next one starts inside a word, two words meet.
        edge = starts[starts < len(data)]
        begins[edge] = inside[edge]
        edge = edge[edge > 0]
        ends[edge - 1] = inside[edge - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield rows[np.searchsorted(starts, s, "right") - 1], crc32_spans(_LOWER[data], s, e)


def _counter(buckets: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for _, hashes in word_hashes(batch.column("text")):
                total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype("i4")), pa.array(total[met])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the words of all ``texts`` (text); each task gives a row a bucket at most."""
    counted = texts.select(text_or_empty().alias("text")).mapInArrow(sliced(_counter(buckets)), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain; ``buckets`` numbers are all that comes to the driver."""
    both = bucket_counts(documents, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    found = every.join(found, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    found = written(found, "bucket-counts")
    sums = found.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1.0) * float(sums.s + buckets)) / ((F.col("s") + 1.0) * float(sums.t + buckets))
    told = found.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))
    return [r.gain for r in told.orderBy("bucket").collect()]


def _weigher(gain: list[int]) -> Callable:
    of = np.array(gain, "i8")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, "i8"), np.zeros(batch.num_rows, "i8")
            for rows, hashes in word_hashes(batch.column("text")):
                n += np.bincount(rows, minlength=len(n))
                np.add.at(total, rows, of[hashes % np.uint32(len(of))])
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return weigh


def weights(documents: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_features and weight (the floored mean gain of its words; 0 without words) of every row."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(sliced(_weigher(gain)), "doc_id long, n_features long, weight long")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``place``, from 1, in this order: ranges are sorted by themselves, and counts of the ranges before are added.

    Rows that are equal in the order are split between ranges by their numbers, so that no group is too large.
    """
    spark = rows.sparkSession
    names = [f"c{i}" for i in range(len(rows.columns))]
    keyed = rows.select("*", *[key.alias(f"_k{i}") for i, key in enumerate(order)]).toDF(*names, *[f"k{i}" for i in range(len(order))])
    keyed = written(keyed.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "to-number")
    keys = [*(f"k{i}" for i in range(len(order))), "row"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ranged = written(ranged.select(*names, F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "numbered")
    counts = {r.range: r.n for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row a range
    bases = np.cumsum([0, *(counts.get(i, 0) for i in range(max(counts, default=0)))])
    base = F.get(F.lit(bases.tolist()), F.col("range").cast("int"))
    return ranged.select(*names, (base + F.col("at") + 1).alias("place")).toDF(*rows.columns, "place")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` (doc_id, weight) with score: the weight and Gumbel noise of the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(
    documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``documents`` (doc_id, text), drawn towards ``target`` (text).

    Of the N rows of at least ``least_words`` words, floor(share * N / 100) of the highest scores are drawn
    and numbered from 1, ties to the smaller doc_id, a null one last; the others' rank is null. A null or empty text, or one
    without words, has no features and weight 0. Rows stand alone, also where a doc_id is null or repeated:
    such rows share their noise. An empty target or table counts no words; no documents give no rows. Other
    columns are left alone.
    """
    rows = scored(weights(documents, gains(documents, target, buckets)), seed)
    able = F.col("n_features") >= least_words
    placed = numbered(rows, ~able, -F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"))
    most = share * placed.where(able).count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(able & (F.col("place") <= most), F.col("place")).alias("rank"))
