"""Byte-level BPE encoding and decoding of whole texts; the merges are recursive queries in the workers (``merge_queries``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import sliced, text_or_empty
from recollect.llm.merge_queries import merge_queries

PART_LETTERS = 2_000_000


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``PART_LETTERS`` letters."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > PART_LETTERS:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _coder(path: str, pattern: str, digests: bool) -> Callable:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        coder = merge_queries(path, pattern)
        for batch in batches:
            found = [x for some in _parts(batch.column("text").to_pylist()) for x in coder.both(some)]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(ids) // 4 for ids, _ in found], pa.int64())}
            if digests:
                columns["ids_sha256"] = pa.array([sha256(ids).hexdigest() for ids, _ in found], pa.string())
                columns["decoded_sha256"] = pa.array([sha256(decoded).hexdigest() for _, decoded in found], pa.string())
            else:
                columns["ids"] = pa.array([np.frombuffer(ids, "<u4").astype("i4") for ids, _ in found], pa.list_(pa.int32()))
                columns["decoded"] = pa.array([decoded for _, decoded in found], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return code


def encode_decode_bytes(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded bytes for each row of ``docs`` (doc_id, text), by a rank file and a pattern.

    With ``digests``, ids_sha256 (of ids as little-endian unsigned 32-bit integers) and decoded_sha256 stand
    for ids and bytes, computed beside them. A null or empty text has no ids. Each row has its own
    result, also where a doc_id is null or repeated; an empty table gives no rows; other columns are left
    alone. No shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    schema = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return texts.mapInArrow(sliced(_coder(path, pattern, digests)), f"doc_id long, n_tokens long, {schema}")
