"""Embedders as plug-ins: batches of texts to vectors in the workers, with the identity of the model on every vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.operators.fusion import search
from recollect.operators.vectors import _hash_texts

BATCH = 64
#: Rows that a worker has as Python's objects at a time.
PART_ROWS = 256
EMBEDDED = "embedding array<float>, embedding_identity string"


class Embedder(Protocol):
    """What a plug-in gives. It is sent to the workers as it is; models are opened there, once a worker."""

    identity: str
    dim: int

    def open(self) -> Callable[[list[str]], list[list[float]]]:
        """A function from a batch of texts to as many vectors of ``dim`` finite values."""


class HashEmbedder:
    """Signed hashed bags of words."""

    def __init__(self, dim: int):
        self.identity, self.dim = f"hash-fnv1a-{dim}", dim

    def open(self) -> Callable[[list[str]], list[list[float]]]:
        return lambda texts: _hash_texts(texts, self.dim)


_open: dict[str, Callable] = {}


def opened(embedder: Embedder) -> Callable:
    """The worker's own instance; one for each identity."""
    if embedder.identity not in _open:
        _open[embedder.identity] = embedder.open()
    return _open[embedder.identity]


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = BATCH) -> DataFrame:
    """``rows`` with embedding and embedding_identity where they have none: other rows keep theirs, and blank or null texts get none.

    Texts go to the embedder in batches of at most ``batch``. A wrong number of vectors, or a vector of
    another dimension, is an error: it would be stored under a false identity.
    """
    own = {"embedding": "array<float>", "embedding_identity": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in own.items() if c not in rows.columns})
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>"))
    schema = StructType(rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(embedder)
        for part in (whole.slice(low, PART_ROWS) for whole in batches for low in range(0, whole.num_rows, PART_ROWS)):
            texts = part.column(text).to_pylist()
            vectors, identities = part.column("embedding").to_pylist(), part.column("embedding_identity").to_pylist()
            wanted = [i for i, t in enumerate(texts) if vectors[i] is None and (t or "").strip()]
            for low in range(0, len(wanted), batch):
                at = wanted[low : low + batch]
                found = model([texts[i] for i in at])
                if len(found) != len(at) or any(len(v) != embedder.dim for v in found):
                    raise ValueError(f"{embedder.identity} didn't give {len(at)} vectors of {embedder.dim}")
                for i, vector in zip(at, found):
                    vectors[i], identities[i] = vector, embedder.identity
            made = {"embedding": pa.array(vectors, pa.list_(pa.float32())), "embedding_identity": pa.array(identities, pa.string())}
            yield pa.RecordBatch.from_arrays([made.get(c, part.column(c)) for c in part.schema.names], part.schema.names)

    return rows.mapInArrow(run, schema)


def of_identity(rows: DataFrame, identity: str) -> DataFrame:
    """``rows`` whose vectors of any other identity are left out of the vector channel: null; the rows stay."""
    return rows.withColumn("embedding", F.when(F.col("embedding_identity") == identity, F.col("embedding")))


def embedded_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """``queries`` (query_id, query, embedding?, embedding_identity?) with vectors for those that have text alone, and status.

    A query that brings a vector of another identity, or of none, is ``identity_mismatch``; the others are ``ok``.
    """
    brought = F.col("embedding").isNotNull() if "embedding" in queries.columns else F.lit(False)
    same = F.coalesce(F.col("embedding_identity") == embedder.identity, F.lit(False)) if "embedding_identity" in queries.columns else F.lit(False)
    checked = queries.withColumn("status", F.when(brought & ~same, "identity_mismatch").otherwise("ok"))
    return embed(checked, embedder, "query")


def search_embedded(queries: DataFrame, memories: DataFrame, embedder: Embedder, limit: int = 8, match: str = "all") -> tuple[DataFrame, DataFrame]:
    """(hits, refused): ``fusion.search`` with text-only queries embedded, so that they use both channels.

    ``refused`` (query_id, status) are the queries with a vector of another identity: they aren't searched.
    Memories (with embedding and embedding_identity) of another identity are found by their text alone.
    """
    asked = embedded_queries(queries, embedder)
    good = asked.where("status = 'ok'").drop("status", "embedding_identity")
    return search(good, of_identity(memories, embedder.identity), limit, match), asked.where("status <> 'ok'").select("query_id", "status")
