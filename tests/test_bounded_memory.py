"""What workers and the driver hold at a time doesn't grow with queries, lists or texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.operators import embedders, neighbour_lists, vectors


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_lists_are_fitted_without_a_matrix_of_all_similarities(spark):
    noise = lambda n: (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2001)) - 1000) / 1000.0
    rows = spark.range(4096).select(F.concat(F.lit("m"), "id").alias("id"), F.array(*[noise(n) for n in range(4)]).alias("embedding")).cache()
    centres, mb = peak_mb(lambda: neighbour_lists.fit_lists(rows, 4, 2048))
    assert centres.shape == (2048, 4) and mb < 32  # a matrix of 4,096 by 2,048 has 67 MB
    few, most = neighbour_lists.SAMPLE_ROWS, rows.count()
    neighbour_lists.SAMPLE_ROWS = 100
    try:
        drawn = neighbour_lists._drawn(rows, most).column("embedding").to_pylist()
        assert drawn == neighbour_lists._drawn(rows, None).column("embedding").to_pylist() and len(drawn) == 100
    finally:
        neighbour_lists.SAMPLE_ROWS = few


def test_routed_queries_are_never_broadcast(spark):
    spread = F.array(*[F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2001)) - 1000.0 for n in range(4)])
    rows = vectors.saved(spark.range(500).select(F.concat(F.lit("m"), "id").alias("id"), spread.alias("embedding")), "rows")
    asked = vectors.saved(rows.where("id LIKE '%0'").withColumnRenamed("id", "query_id"), "asked")  # tables of known, small sizes
    near = neighbour_lists.Lists(rows, 4).search(asked, 3, share=1.0)
    planned = near._jdf.queryExecution().toString()
    assert near.count() == 150 and "BroadcastHashJoin" not in planned and "SortMergeJoin" in planned


def test_scores_are_made_a_chunk_of_queries_at_a_time(spark):
    draw = np.random.default_rng(3)
    q, x = draw.normal(size=(6000, 8)), draw.normal(size=(2048, 8)).astype("f4")
    part = pa.table({"query_id": pa.array(range(6000)), "embedding": pa.array(q.tolist()), "scope": pa.array(["a" if i % 2 else None for i in range(6000)])})
    batch = pa.RecordBatch.from_arrays([pa.array([f"m{i}" for i in range(2048)]), pa.array(x.tolist(), pa.list_(pa.float32())), pa.array([["a", "b"][i % 2] for i in range(2048)])], ["id", "embedding", "scope"])
    near = vectors._near_block(part, 8, 2, spark)
    found, mb = peak_mb(lambda: pa.Table.from_batches(list(near(iter([batch])))))
    assert mb < 64  # 6,000 by 2,048 scores have 98 MB
    unit = lambda v: v / np.sqrt((v * v).sum(1, keepdims=True))
    scores = unit(q) @ unit(x.astype("f8")).T
    scores[1::2, 1::2] = -2  # queries of scope a
    best = {(i, f"m{j}") for i, row in enumerate(np.argsort(-scores, 1)[:, :2]) for j in row}
    assert set(zip(found["query_id"].to_pylist(), found["id"].to_pylist())) == best


def test_texts_are_hashed_a_part_at_a_time_with_a_bounded_cache(spark):
    known = {}
    before = vectors.KNOWN_WORDS
    vectors.KNOWN_WORDS = 50
    try:
        found = vectors._hash_vectors([f"word{i} other{i}" for i in range(500)], 8, known)
    finally:
        vectors.KNOWN_WORDS = before
    assert len(known) <= 52 and found.shape == (500, 8) and found[7].tolist() == vectors._hash_texts(["word7 other7"], 8)[0]
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("Text of "), "id")).alias("t"))
    texts = [r.t for r in rows.orderBy("id").collect()]
    assert [r.v for r in rows.select("id", vectors.hash_embed(F.col("t"), 4).alias("v")).orderBy("id").collect()] == vectors._hash_texts(texts, 4)


def test_embedders_see_parts_of_a_batch(spark):
    taken = []

    class Embedder(embedders.HashEmbedder):
        def open(self):
            run = super().open()
            return lambda texts: taken.append(len(texts)) or run(texts)

    caught = {}

    class Rows:
        schema, columns = spark.createDataFrame([], "text string, embedding array<float>, embedding_identity string").schema, ["text", "embedding", "embedding_identity"]
        withColumns = withColumn = lambda self, *_: self

        def mapInArrow(self, run, schema):
            caught["run"] = run

    embedders._open.clear()
    embedders.embed(Rows(), Embedder(4))
    n = 3 * embedders.PART_ROWS
    whole = pa.RecordBatch.from_arrays([pa.array(["a b"] * n), pa.nulls(n, pa.list_(pa.float32())), pa.nulls(n, pa.string())], ["text", "embedding", "embedding_identity"])
    parts = list(caught["run"](iter([whole])))
    assert [p.num_rows for p in parts] == [embedders.PART_ROWS] * 3 and sum(taken) == n and max(taken) <= embedders.BATCH
    embedders._open.clear()
