"""The bounded text search against all scores, ranked."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.operators import best_texts, fusion, lenses, lexical

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    rows = [
        (f"m{i}", "org/a" if i % 3 else "org/b/c", ["semantic", "episodic"][i % 2], " ".join(["common", *draw.choices(WORDS, [1 / (n + 1) for n in range(40)], k=draw.randrange(1, 12))]), datetime(2024, 1, 1 + i % 9), None)
        for i in range(3000)
    ]
    rows += [("n", "org/a", "semantic", None, datetime(2024, 1, 1), None), ("e", "org/a", None, "", datetime(2024, 1, 1), None)]
    return spark.createDataFrame(rows, "id string, scope string, category string, text string, valid_from timestamp_ntz, valid_until timestamp_ntz").repartition(6)


@pytest.fixture(scope="module")
def queries(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["common"] * (i % 2) + draw.choices(WORDS, k=i % 4 + 1)), [None, "org", "org/b"][i % 3], [None, ["semantic"], []][i % 5 % 3], [None, 3][i % 2], datetime(2024, 1, 5) if i % 4 else None) for i in range(60)]
    rows += [(100, "common", None, None, None, None), (101, "unknown", None, None, None, None), (102, "", None, None, None, None), (103, None, None, None, None, None), (104, "common unknown w1", None, None, None, None)]
    return spark.createDataFrame(rows, "query_id long, query string, scope string, categories array<string>, limit int, as_of timestamp_ntz")


@pytest.mark.parametrize("match", ["all", "any"])
@pytest.mark.parametrize("block", [best_texts.QUERY_ROWS, 20])
def test_best_texts_are_the_first_of_all(spark, monkeypatch, table, queries, match, block):
    monkeypatch.setattr(best_texts, "QUERY_ROWS", block)
    monkeypatch.setattr(best_texts, "BATCH_ROWS", 100)
    every = lenses.seen(lexical.bm25_scores(queries, table, match), queries, table)
    want = lexical.within_limits(lexical.top_k_per_query(every, 7), queries)
    told = lambda df: sorted((r.query_id, r.rank1, r.id, round(r.score, 7)) for r in df.collect())
    assert told(lexical.bm25_search(queries, table, 7, match)) == told(want)
    assert lexical.bm25_search(queries.limit(0), table, 7, match).collect() == [] == lexical.bm25_search(queries, table.limit(0), 7, match).collect()


def test_a_term_of_every_text_makes_few_rows(spark, table):
    asked = spark.createDataFrame([(i, f"common w{i % 5}") for i in range(20)], "query_id long, query string")
    terms = lexical.query_terms(asked)
    weights = lexical.term_weights(terms, table)
    found = best_texts.best_texts(asked, terms, weights, table, 5, "any").withColumn("task", F.spark_partition_id())
    rows = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks")).collect()
    assert len(rows) == 20 and all(r.n <= 5 * r.tasks for r in rows)  # of 3,000 matches
    assert lexical.bm25_scores(asked, table, "any").count() == 20 * 3000


def test_as_of_is_now_by_default(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    asked = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1))], "query_id int, as_of timestamp_ntz")
    assert [r.as_of for r in lenses.at_present(asked, now).orderBy("query_id").collect()] == [datetime(2024, 3, 1), datetime(2024, 1, 1)]
    assert [r.as_of for r in lenses.at_present(asked.select("query_id"), now).collect()] == [datetime(2024, 3, 1)] * 2


def test_no_text_is_shuffled_and_null_texts_count(spark):
    rows = spark.createDataFrame([("a", "red green"), ("b", "blue"), ("c", "blue blue"), ("d", None)], "id string, text string")
    found = lexical.bm25_search(spark.createDataFrame([(1, "Green")], "query_id int, query string"), rows, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.rindex("Exchange")  # the window's, over what the tasks found
    (hit,) = found.collect()
    assert hit.id == "a" and hit.score == pytest.approx(math.log((4 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (5 / 3))))


def test_a_second_round_doesnt_search_the_first_again(spark, table, queries):
    out = fusion.iterative_requery(queries.drop("categories", "limit"), table, 4)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
