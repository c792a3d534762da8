"""Token ids as flat binary files with 64-bit document offsets, read back through memory maps.

A folder holds, for each part of the range partitioning by document id:

* ``<part>.ids``  the ids of its documents one after another, little-endian unsigned integers of 2 or 4
  bytes (2 where the vocabulary has at most 65,536 entries);
* ``<part>.off``  n + 1 little-endian unsigned 64-bit offsets, in ids from the start of the part;
* ``<part>.doc``  n little-endian signed 64-bit document ids; rows without one stand first in part order,
  and the index says how many they are.

The index, a Parquet table in the same folder, has a row for each part: its path, its counts, and its
bases, which are prefix sums of the counts. A global offset is the part's base plus the offset there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import during_writes, shared_path, sliced, text_or_empty
from recollect.llm.word_ids import word_ids

PART_SCHEMA = "part int, path string, dtype string, n_docs long, n_null long, n_ids long"
INDEX_SCHEMA = f"{PART_SCHEMA}, base_docs long, base_ids long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_DOCS = 4096


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = word_ids(tokenizer)
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{part:06d}-{uuid.uuid4().hex}"  # each attempt has its own files; the index names those that count
        end = np.array([end_id], encoder.dtype).tobytes()
        n_docs = n_null = n_ids = 0
        width = np.dtype(encoder.dtype).itemsize
        with (
            store.open_output_stream(f"{root}/{path}.ids") as ids,
            store.open_output_stream(f"{root}/{path}.off") as offsets,
            store.open_output_stream(f"{root}/{path}.doc") as docs,
        ):
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                found = encoder.encode(batch.column("text").to_pylist())
                lengths = np.array([len(x) // width + 1 for x in found], "<u8")
                ids.write(b"".join(y for x in found for y in (x, end)))
                offsets.write((np.cumsum(lengths, dtype="<u8") + np.uint64(n_ids)).astype("<u8").tobytes())
                keys = batch.column("doc_id")
                docs.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_null, n_ids = n_docs + len(found), n_null + keys.null_count, n_ids + int(lengths.sum())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()), "path": [path], "dtype": [encoder.dtype],
                "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids],
            }
        )

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into token files under ``folder`` in ascending doc_id order.

    Returns the index. ``end_id`` ends each document; a null text is empty, so that it has that id alone.
    A null doc_id comes first; rows of one doc_id all stay, by the hash of their texts. An empty table
    gives an index of empty parts. Other columns are left alone. ``parts`` is the number of files, by
    default that of shuffle partitions. Parts are bounded by ranges of (doc_id, hash), so that one hot
    doc_id is split as well. A lost task writes new files; only files named in the index count.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    key = ["doc_id", "h"]
    dealt = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(parts, *key)
        .sortWithinPartitions(*key)
        .select("doc_id", "text")
    )
    with during_writes(spark):
        dealt.mapInArrow(sliced(_writer(folder, tokenizer, end_id)), PART_SCHEMA).write.parquet(f"{folder}/parts")
    # One row a part: the prefix sums of the counts are the driver's.
    rows, base_docs, base_ids = [], 0, 0
    for row in sorted(spark.read.schema(PART_SCHEMA).parquet(f"{folder}/parts").collect()):
        rows.append((*row, base_docs, base_ids))
        base_docs, base_ids = base_docs + row.n_docs, base_ids + row.n_ids
    spark.createDataFrame(rows, INDEX_SCHEMA).coalesce(1).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def opened(store, path: str):
    """A file for reads at places: mapped into memory if the store is the local disk or mounted there."""
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def _documents(store, path: str, part: dict) -> Iterator[pa.RecordBatch]:
    """The documents of a part; of each file only what READ_DOCS of them need is read at a time."""
    import zlib

    import numpy as np

    with opened(store, f"{path}.ids") as ids, opened(store, f"{path}.off") as offsets, opened(store, f"{path}.doc") as docs:

        def read(file, dtype: str, first: int, last: int):
            width = np.dtype(dtype).itemsize
            return np.frombuffer(file.read_at((last - first) * width, first * width), dtype)

        for low in range(0, part["n_docs"], READ_DOCS):
            high = min(low + READ_DOCS, part["n_docs"])
            bounds = read(offsets, "<u8", low, high + 1).astype("i8")
            crc = [zlib.crc32(read(ids, part["dtype"], a, b).astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(read(docs, "<i8", low, high), pa.int64(), mask=np.arange(low, high) < part["n_null"]),
                    "start": pa.array(bounds[:-1] + part["base_ids"]),
                    "n_tokens": pa.array(np.diff(bounds)),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def _reader(folder: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                yield from _documents(store, f"{root}/{part['path']}", part)

    return read


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens and the crc32 of its ids as u32.

    ``start`` counts the ids of all documents before it. Each file is mapped by the task that reads it, or
    read by ranges where its store can't be mapped.
    """
    index = read_index(spark, folder)
    parts = max(1, index.count())
    return index.repartition(min(parts, 4096), "part").mapInArrow(_reader(folder), READ_SCHEMA)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back; see ``write_token_files``."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder)
