"""Embeddings by hashing, and nearest neighbours by cosine."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.lenses import SEEN_BY, Lens, lens_of
from recollect.operators.lexical import top_k_per_query, within_limits
from recollect.operators.validation import vector_reason
from recollect.sources.shared import saved

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
QUERY_BYTES = 32 << 20
BLOCK_ROWS = 2048
#: Queries that are scored at once: with as many rows as a block has, 8 MB of scores.
CHUNK_QUERIES = 512
TEXT_ROWS = 256
KNOWN_WORDS = 100_000


def _hash_vectors(texts: Iterable[str | None], dim: int, known: dict[str, tuple[int, float]]) -> np.ndarray:
    """Signed hashed bags of words at length 1: FNV-1a of each word picks a place, its bit 32 the sign. ``known`` words, up to a bound, are kept."""
    split = re.compile(r"[^\w]+|_+")
    out = []
    for text in texts:
        if len(known) > KNOWN_WORDS:
            known.clear()
        v = np.zeros(dim)
        for word in filter(None, split.split((text or "").lower())):
            if word not in known:
                h = FNV_OFFSET
                for byte in word.encode():
                    h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
                known[word] = h % dim, -1.0 if h >> 32 & 1 else 1.0
            at, sign = known[word]
            v[at] += sign
        norm = np.sqrt(v @ v)
        out.append((v / norm if norm else v).astype("f4"))
    return np.array(out, "f4").reshape(-1, dim)


def _hash_texts(texts: Iterable[str | None], dim: int) -> list[list[float]]:
    return _hash_vectors(texts, dim, {}).tolist()


def hash_embed(text: Column, dim: int) -> Column:
    """A text's hashed vector of floats; a text without words has the zero vector. A worker has ``TEXT_ROWS`` texts at a time as Python's."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, float]] = {}
        for texts in batches:
            parts = [_hash_vectors(texts.slice(low, TEXT_ROWS).to_pylist(), dim, known) for low in range(0, len(texts), TEXT_ROWS)]
            values = np.concatenate([np.zeros((0, dim), "f4"), *parts])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype="i4") * dim), pa.array(values.reshape(-1)))

    return embed(text)


def check_vectors(memories: DataFrame, dim: int) -> DataFrame:
    """``memories`` with reason: why its embedding is refused, or null."""
    return memories.withColumn("reason", vector_reason(F.col("embedding"), dim))


def unit(embedding: Column) -> Column:
    """The vector as doubles at length 1; zero stays zero."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def _nearest(chunks: list[tuple[pa.Array, np.ndarray, Lens]], k: int) -> Callable:
    """The ``k`` best of each batch for each query: by score rounded to 9 digits, then id. Scores are made a chunk of queries at a time."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(low, BLOCK_ROWS)
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(batch.num_rows, -1)
                length = np.sqrt((x * x).sum(1, keepdims=True))
                x /= np.where(length > 0, length, 1)
                names = np.array(batch.column("id").to_pylist(), object)
                for ids, q, lens in chunks:
                    scores = q @ x.T
                    ranked = np.where(lens.mask(batch), np.round(scores, 9), -np.inf)
                    least = np.partition(ranked, -k, 1)[:, -k] if ranked.shape[1] > k else np.full(len(q), -np.inf)
                    rows, columns = np.nonzero((ranked >= least[:, None]) & (ranked > -np.inf))
                    order = np.lexsort((names[columns], -ranked[rows, columns], rows))
                    place = np.arange(len(order)) - np.searchsorted(rows, rows[order])
                    order = order[place < k]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows[order])), pa.array(names[columns[order]], pa.string()), pa.array(scores[rows[order], columns[order]])], ["query_id", "id", "score"]
                    )

    return near


def knn_search(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank1): each query's ``k`` nearest by cosine, exact, with score 1 - distance.

    A query sees what its scope and lenses allow, if it has any (see ``lenses.seen``): a mask over each block of
    scores. Queries go out in blocks of at most ``QUERY_BYTES``, and each batch of memories keeps its own ``k``
    best, so that what is shuffled is ``k`` rows a query and batch. A worker scores ``CHUNK_QUERIES`` of them at
    a time, so that its memory doesn't grow with their number. More queries than a block make more passes, and so do queries of several dimensions: a query meets the vectors of its own. Vectors without values take no part.
    """
    lens = lens_of(queries)
    asked = saved(queries.where(F.size("embedding") > 0).select("query_id", "embedding", F.size("embedding").alias("dim"), *lens), "asked")
    rows = memories.select("id", "embedding", *[c for c in SEEN_BY if lens and c in memories.columns])
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id string, score double"
    best = asked.sparkSession.createDataFrame([], kind)
    dims = asked.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()  # a row a dimension
    for dim, n in map(tuple, dims):
        blocks = -(-n * dim * 8 // QUERY_BYTES)
        own = rows.where(F.size("embedding") == dim)
        for block in range(blocks):
            part = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
            best = best.unionByName(own.mapInArrow(_near_block(part, dim, k, asked.sparkSession), kind))
    return within_limits(top_k_per_query(best, k), queries)


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of length 1; zero stays zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norms > 0, norms, 1)


def _near_block(part: pa.Table, dim: int, k: int, spark: SparkSession) -> Callable:
    pieces = [part.slice(low, CHUNK_QUERIES).combine_chunks() for low in range(0, part.num_rows, CHUNK_QUERIES)]
    piece = lambda p, c: pa.concat_arrays(p.column(c).chunks)
    shared = spark.sparkContext.broadcast([(piece(p, "query_id"), units(piece(p, "embedding"), dim), Lens(p)) for p in pieces])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = shared.value
        yield from _nearest(chunks, k)(batches) if chunks else ()

    return near


def knn_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's exact hits (query_id, id) that were found."""
    met = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return met.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
