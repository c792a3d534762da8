"""Harmonic packing of documents into sequences of a fixed number of tokens.

Lengths fall into reciprocal-capacity classes: class k has the lengths over capacity / (k + 1) and up to
capacity / k, and each of its bins holds exactly k pieces. Documents may be cut, so that a length that
would fill its bins badly first gives off the longest piece that fills a class's bins well. Each worker
fills bins for itself; only the pieces of bins that a worker couldn't fill, fewer than k for each class
and worker, meet afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import sliced, text_or_empty, written
from recollect.llm.word_ids import word_ids

SHORT = 32
WASTE = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker long, nth long, sequence_id long, offset long"
OUT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@cache
def cut(length: int, capacity: int) -> tuple[int, ...]:
    """The lengths of a document's pieces: whole sequences, then what fills the bins of some class well.

    A bin is filled well if at most 1 / WASTE of it stays empty; up to SHORT tokens are never cut.
    """
    if length >= capacity:
        return (capacity,) * (length // capacity) + cut(length % capacity, capacity)
    if not length:
        return ()
    if length <= SHORT or capacity - (capacity // length) * length <= capacity // WASTE:
        return (length,)
    k = capacity // length + 1
    while capacity - (capacity // k) * k > capacity // WASTE:
        k += 1
    return (capacity // k, *cut(length - capacity // k, capacity))


def _packer(tokenizer: str, end_id: int, capacity: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        from pyspark import TaskContext

        encoder = word_ids(tokenizer)
        worker = TaskContext.get().partitionId()
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int32() if n == "class" else pa.int64() for n in names]
        waiting: dict[int, list[list]] = {}
        sequence = worker << 40

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            out: list[list] = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids = np.append(np.frombuffer(found, encoder.dtype), [end_id]).astype("<u4")
                start = 0
                for length in cut(len(ids), capacity):
                    k = capacity // length
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    bin_ = waiting.setdefault(k, [])
                    bin_.append([doc_id, start, length, crc, len(ids), k, worker, len(bin_), None, None])
                    start += length
                    if len(bin_) == k:
                        offset = 0
                        for row in waiting.pop(k):
                            row[-2:] = sequence, offset
                            offset += row[2]
                            out.append(row)
                        sequence += 1
            yield batch_of(out)
        yield batch_of([row for rows in waiting.values() for row in rows])

    return pack


def _fit(capacity: int) -> Callable:
    """First fit, longest first, of what no class could fill a bin with: fewer than k pieces of each class k."""

    def fit(pieces):
        pieces = pieces.sort_values(["length", "doc_id", "start", "worker", "nth"], ascending=[False, True, True, True, True])
        room: list[int] = []
        at = []
        for length in pieces["length"]:
            i = next((i for i, left in enumerate(room) if left >= length), len(room))
            if i == len(room):
                room.append(capacity)
            at.append((i, capacity - room[i]))
            room[i] -= length
        pieces["sequence_id"] = [(1 << 62) + i for i, _ in at]
        pieces["offset"] = [offset for _, offset in at]
        return pieces

    return fit


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text) and their places in sequences of ``capacity`` tokens.

    A document is its ids and ``end_id``. A null or empty text is that id alone; rows that share a
    doc_id, or have none, are documents of their own. An empty table gives no pieces. Other columns are
    left alone. sequence_id is unique, not gapless. Each text is encoded once; the pieces (not the ids)
    are written to the shared folder, as which bins a worker filled must not change in a second run.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    pieces = written(texts.mapInArrow(sliced(_packer(tokenizer, end_id, capacity)), PIECES), "pieces")
    left = pieces.where("sequence_id IS NULL")
    counts = left.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "class", "worker",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy("class")).alias("total"),
    )
    ranked = left.join(bases, ["class", "worker"]).withColumn("at", F.col("base") + F.col("nth"))
    filled = F.col("at") < F.col("total") - F.col("total") % F.col("class")
    bin_ = Window.partitionBy("class", "bin").orderBy("at")
    names = pieces.columns
    met = (
        ranked.where(filled)
        .withColumn("bin", F.floor(F.col("at") / F.col("class")))
        .withColumn("sequence_id", F.lit(1 << 61) + F.shiftleft(F.col("class").cast("long"), 40) + F.col("bin"))
        .withColumn("offset", F.coalesce(F.sum("length").over(bin_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(names)
    )
    rest = ranked.where(~filled).select(names).groupBy().applyInPandas(_fit(capacity), PIECES)
    placed = pieces.where("sequence_id IS NOT NULL").unionByName(met).unionByName(rest)
    return placed.select(*OUT)
