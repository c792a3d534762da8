"""New versions under time lenses, reasons of edges that a change leaves alone, and the journal of edges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.operators import graph, lenses, revise

NOW = datetime(2024, 2, 1)
LATER = "2024-03-01 00:00:00"


def at(text="2024-02-01 00:00:00"):
    return F.lit(text).cast("timestamp_ntz")


def test_a_new_version_is_seen_by_all_times_and_keeps_its_category(spark):
    rows = spark.createDataFrame(
        [("a", "org", "semantic", "x", datetime(2024, 1, 1), None, datetime(2024, 1, 1), datetime(2024, 1, 1), None, None, None, 1)],
        "id string, scope string, category string, text string, valid_from timestamp_ntz, valid_until timestamp_ntz, known_at timestamp_ntz, sys_created timestamp_ntz, sys_closed timestamp_ntz, superseded_by string, supersedes string, version long",
    )
    asked = spark.createDataFrame([(1, "a", "org", 1, None, None, "y")], "seq long, prior_id string, scope string, expected_version long, close_at timestamp_ntz, new_valid_from timestamp_ntz, text string")
    after, outcomes = revise.apply_supersedes(asked, rows, at())
    assert "_category" not in outcomes.columns and after.columns == rows.columns
    (new,) = lenses.known_as_of(lenses.sys_as_of(after, at(LATER)), at(LATER)).where("supersedes = 'a'").collect()
    assert (new.category, new.known_at, new.sys_created, new.text) == ("semantic", NOW, NOW, "y")
    assert lenses.sys_as_of(after, at("2024-01-15 00:00:00")).select("id").collect() == [("a",)]
    ops = spark.createDataFrame([(1, 0, "supersede", "a", "org", "z", None, False), (1, 1, "put", None, "org", "w", None, False)], "batch_id long, idx long, op string, id string, scope string, text string, expected_version long, hard boolean")
    after = revise.apply_ops(rows, ops, at())[0]
    seen = {r.text: r.category for r in lenses.known_as_of(lenses.sys_as_of(after, at(LATER)), at(LATER)).collect()}
    assert seen == {"z": "semantic", "w": None}


EDGE = "id string, subject string, predicate string, object string, state string, state_reason string, version long, epistemic string, evidence string, valid_until timestamp_ntz"


@pytest.fixture
def edges(spark):
    rows = [
        ("e1", "a", "derived_from", "b", "stale", "endpoint_superseded", 3, "asserted", "x", None), ("e2", "c", "derived_from", "d", "active", None, 1, "asserted", "x", None),
        ("e3", "a", "supports", "c", "purged", "endpoint_erased", 2, "asserted", "x", None),
    ]
    return spark.createDataFrame(rows, EDGE)


def test_reasons_of_untouched_edges_stay(spark, edges):
    ids = spark.createDataFrame([("d", "org")], "id string, scope string")
    memories = spark.createDataFrame([("d", 1)], "id string, version long")
    reasons = lambda df: {r.id: r.state_reason for r in df.collect()}
    assert reasons(revise.stale_edges(edges, ids)) == {"e1": "endpoint_superseded", "e2": "endpoint_superseded", "e3": "endpoint_erased"}
    assert reasons(revise.apply_hard_erases(memories, edges, ids)[1]) == {"e1": "endpoint_superseded", "e2": "endpoint_erased", "e3": "endpoint_erased"}
    asked = spark.createDataFrame([(1, "e2", 1, None, None, "inferred")], "seq long, id string, expected_version long, state string, reason string, epistemic string")
    assert reasons(graph.update_edges(edges, asked)[0]) == {"e1": "endpoint_superseded", "e2": None, "e3": "endpoint_erased"}


def test_purged_edges_stay_and_any_version_is_restored(spark, edges):
    schema = "seq long, id string, expected_version long, state string, reason string, epistemic string, evidence string, valid_until timestamp_ntz"
    first = spark.createDataFrame([(1, "e2", 1, None, None, "inferred", None, NOW), (2, "e2", 1, "closed", "r", None, None, None), (3, "e3", 2, "stale", "r", None, None, None), (4, "e1", 3, "active", None, None, None, None)], schema)
    one, outcomes, events_1 = graph.update_edges(edges, first, at())
    assert {r.seq: r.status for r in outcomes.collect()} == {1: "ok", 2: "conflict", 3: "not_allowed", 4: "cannot_reopen"}
    second = spark.createDataFrame([(1, "e2", 2, "closed", "done", None, "y", None)], schema)
    two, _, events_2 = graph.update_edges(one, second, at())
    versions = spark.range(0, 6).selectExpr("explode(array('e1', 'e2', 'e3', 'zz')) AS id", "id AS version")
    got = {(r.id, r.version): tuple(r) for r in graph.edges_at_version(two, events_1.unionByName(events_2), versions).collect()}
    want = {}
    for table in (edges, one, two):
        want |= {(r.id, r.version): tuple(r) for r in table.collect()}
    assert got == want and ("e2", 3) in want and ("e2", 2) in want and ("e2", 1) in want


def test_reserved_predicates_are_not_walked(spark):
    edges = spark.createDataFrame([("a", "supersedes", "b"), ("a", "supports", "c")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.node for r in graph.traverse(edges, seeds)[0].collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        graph.traverse(edges, seeds, predicates=("supersedes",))


def test_history_shares_rounds_between_directions(spark):
    """Chains longer and shorter than the steps, an id that isn't there: plain walks give the same rows."""
    size = 11
    rows = [(f"c{i}", f"c{i - 1}" if i else None, f"c{i + 1}" if i < size - 1 else None) for i in range(size)] + [("lone", None, None)]
    memories = spark.createDataFrame(rows, "id string, supersedes string, superseded_by string")
    ids = spark.createDataFrame([("c0",), ("c5",), ("lone",), ("gone",)], "id string")
    for steps in (0, 1, 3, 4, 64):
        got = sorted(map(tuple, revise.history(memories, ids, steps).collect()))
        assert got == sorted([(f"c{a}", f"c{b}", b - a) for a in (0, 5) for b in range(size) if abs(b - a) <= steps] + [("lone", "lone", 0)])
    assert revise.history(memories.limit(0), ids).collect() == []
