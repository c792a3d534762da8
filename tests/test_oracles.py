"""Every registered query with SQL against DuckDB on the driver's smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from recollect.jobs import registry

DATA = "/root/testdata/sf0.001"
#: Also on ten times the rows: results that depend on frames, files or rounds.
LARGER = "/root/testdata/sf0.01"
LARGE = ("ingest_trace_stream", "task_state_stream", "usage_windows_stream", "fold_task_state", "near_duplicates", "select_proposals", "latency_percentiles", "traverse_stats", "graph_expand", "knn_search")


@pytest.fixture(scope="module")
def duck():
    found = {}
    for data in (DATA, LARGER):
        found[data] = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            found[data].execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return found


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "None" if math.isnan(value) else repr(round(value, 5) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return repr(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in found)


@pytest.mark.parametrize("data, name", [(DATA, name) for name in sorted(registry.queries())] + [(LARGER, name) for name in LARGE])
def test_query(spark, duck, data, name):
    df = registry.queries()[name](spark, data)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        found = duck[data].execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, found.fetchall())
    else:
        assert got
