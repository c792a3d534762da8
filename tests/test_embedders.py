"""Embedders as plug-ins."""

import pytest
from pyspark.sql import functions as F

from recollect.operators import embedders


def plug_ins():
    """Classes of this function travel to the workers by value."""

    class Counting:
        """Vectors of a text's length, and of how often the worker opened the model."""

        identity, dim = "counting-2", 2

        def __init__(self):
            self.times = 0

        def open(self):
            self.times += 1

            def run(texts):
                assert len(texts) <= 3
                return [[float(len(t)), float(self.times)] for t in texts]

            return run

    class Wrong(Counting):
        identity, dim = "wrong-3", 3

    return Counting(), Wrong()


ROWS = [(1, "a", None, None), (2, "", None, None), (3, None, None, None), (4, "bcd", [9.0, 9.0], "other"), (5, "  ", None, None)] + [(i, "x" * i, None, None) for i in range(10, 30)]


def frame(spark):
    return spark.createDataFrame(ROWS, "id long, text string, embedding array<float>, embedding_identity string")


def test_texts_are_embedded_in_batches_by_one_model_a_worker(spark):
    counting, wrong = plug_ins()
    got = {r.id: (r.embedding, r.embedding_identity) for r in embedders.embed(frame(spark).repartition(3), counting, batch=3).collect()}
    assert len(got) == len(ROWS)
    assert got[4] == ([9.0, 9.0], "other") and all(got[i] == (None, None) for i in (2, 3, 5))
    assert all(got[i] == ([float(i), 1.0], "counting-2") for i in range(10, 30)) and got[1][0] == [1.0, 1.0]
    bare = embedders.embed(frame(spark).select("text", "id"), counting, batch=3)
    assert bare.columns == ["text", "id", "embedding", "embedding_identity"] and bare.where("embedding IS NULL").count() == 3
    assert embedders.embed(frame(spark).limit(0), counting).collect() == []
    with pytest.raises(Exception, match="didn't give"):
        embedders.embed(frame(spark), wrong, batch=3).collect()


def test_text_alone_is_searched_by_both_channels(spark):
    hashing = embedders.HashEmbedder(16)
    memories = spark.createDataFrame([("a", "green tea leaves"), ("b", "black coffee beans"), ("c", "green coffee"), ("d", "cups and plates")], "id string, text string")
    memories = embedders.embed(memories, hashing).withColumn("embedding_identity", F.when(F.col("id") == "c", "other").otherwise(F.col("embedding_identity")))
    queries = spark.createDataFrame([(1, "green tea", None, None), (2, "", [1.0] * 16, "other"), (3, "coffee", None, None)], "query_id long, query string, embedding array<float>, embedding_identity string")
    hits, refused = embedders.search_embedded(queries, memories, hashing)
    assert [tuple(r) for r in refused.collect()] == [(2, "identity_mismatch")]
    found = {(r.query_id, r.id): (r.bm25, r.vector) for r in hits.collect()}
    assert found[1, "a"] == (True, True) and found[3, "b"] == (True, True)
    assert found[3, "c"] == (True, False) and (1, "c") not in found  # by its text alone
    assert {q for q, _ in found} == {1, 3}
