"""Time lenses, scopes and enumeration over memory tables.

Intervals are half open. Every lens takes its instant; nothing reads a clock.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.scopes import ancestors, scope_match


def valid_at(t: Column) -> Column:
    return (F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))


def known_by(t: Column) -> Column:
    return F.col("known_at") <= t


def in_system_at(t: Column) -> Column:
    return (F.coalesce("sys_created", "known_at") <= t) & (F.col("sys_closed").isNull() | (F.col("sys_closed") > t))


def as_of(memories: DataFrame, t: Column) -> DataFrame:
    """Rows valid at ``t``."""
    return memories.where(valid_at(t))


def known_as_of(memories: DataFrame, t: Column) -> DataFrame:
    return memories.where(known_by(t))


def sys_as_of(memories: DataFrame, t: Column) -> DataFrame:
    return memories.where(in_system_at(t))


def in_categories(memories: DataFrame, categories: list[str] | None) -> DataFrame:
    """Rows of the categories; null takes all, an empty list none."""
    return memories if categories is None else memories.where(F.col("category").isin(*categories))


def as_of_join(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """Pairs of requests (query_id, scope, scope_match, as_of and, if there, known_as_of, sys_as_of) and memories they see.

    A memory's scope gives each scope above it, so that prefix matches are an equi-join; times are residual.
    """
    asked = requests.select([F.col(c).alias(f"_{c}") for c in requests.columns])
    above = memories.withColumn("_above", F.explode(ancestors(F.col("scope"))))
    seen = above.join(asked, F.col("_above") == F.col("_scope")).where(scope_match(F.col("scope"), F.col("_scope"), F.col("_scope_match")))
    seen = seen.where(valid_at(F.col("_as_of")))
    for name, lens in (("known_as_of", known_by), ("sys_as_of", in_system_at)):
        if name in requests.columns:
            seen = seen.where(F.col(f"_{name}").isNull() | lens(F.col(f"_{name}")))
    return seen.withColumn("query_id", F.col("_query_id")).select("query_id", *memories.columns)


LENS = ("scope", "scope_match", "as_of", "known_as_of", "sys_as_of", "categories")
TIMES = ("valid_from", "valid_until", "known_at", "sys_created", "sys_closed")
SEEN_BY = ("scope", "category", *TIMES)
NEVER = np.iinfo("i8").min


def lens_of(queries: DataFrame) -> list[str]:
    """The columns of ``queries`` that say what they may see."""
    return [c for c in LENS if c in queries.columns]


def at_present(queries: DataFrame, now: Column) -> DataFrame:
    """``queries`` whose as_of is ``now`` where they name none, whatever other lens they have: a request sees what is valid when it is made."""
    given = [F.col("as_of")] if "as_of" in queries.columns else []
    return queries.withColumn("as_of", F.coalesce(*given, now))


class Lens:
    """What each query of a block may see of a batch of memories."""

    def __init__(self, queries: pa.Table):
        self.n = queries.num_rows
        self.times = {c: self._time(queries.column(c)) for c in ("as_of", "known_as_of", "sys_as_of") if c in queries.column_names}
        self.scopes: dict[str, list[int]] = {}
        self.exact = np.zeros(self.n, bool)
        self.free = np.ones(self.n, bool)
        if "scope" in queries.column_names:
            for i, scope in enumerate(queries.column("scope").to_pylist()):
                if scope is not None:
                    self.free[i] = False
                    self.scopes.setdefault(scope, []).append(i)
        self.categories = queries.column("categories").to_pylist() if "categories" in queries.column_names else None
        if "scope_match" in queries.column_names:
            self.exact = np.array([m == "exact" for m in queries.column("scope_match").to_pylist()], bool)

    @staticmethod
    def _time(column) -> np.ndarray:
        """Microseconds; the least number where there is none."""
        values = column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(NEVER)
        return values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.combine_chunks().to_numpy(zero_copy_only=False)

    def mask(self, batch: pa.RecordBatch) -> np.ndarray:
        allowed = np.ones((self.n, batch.num_rows), bool)
        if not self.free.all():
            codes = batch.column("scope").dictionary_encode()
            table = np.zeros((self.n, len(codes.dictionary) + 1), bool)
            for c, scope in enumerate(codes.dictionary.to_pylist()):
                parts = scope.split("/")
                for depth in range(1, len(parts) + 1):
                    for i in self.scopes.get("/".join(parts[:depth]), ()):
                        table[i, c] = depth == len(parts) or not self.exact[i]
            table[self.free] = True
            allowed &= table[:, codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)]
        if self.categories is not None:
            codes = batch.column("category").dictionary_encode()
            names = codes.dictionary.to_pylist()
            table = np.array([[wanted is None or name in wanted for name in names] + [wanted is None] for wanted in self.categories], bool).reshape(self.n, -1)
            allowed &= table[:, codes.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
        time = {c: self._time(batch.column(c)) for c in TIMES if c in batch.schema.names}
        tests = {
            "as_of": lambda t: (time["valid_from"] != NEVER) & (time["valid_from"] <= t) & ((time["valid_until"] == NEVER) | (time["valid_until"] > t)),
            "known_as_of": lambda t: (time["known_at"] != NEVER) & (time["known_at"] <= t),
            "sys_as_of": lambda t: (created(time) != NEVER) & (created(time) <= t) & ((time["sys_closed"] == NEVER) | (time["sys_closed"] > t)),
        }
        created = lambda time: np.where(time["sys_created"] == NEVER, time["known_at"], time["sys_created"])
        for name, at in self.times.items():
            at = at[:, None]
            allowed &= (at == NEVER) | tests[name](at)
        return allowed


def seen(pairs: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """``pairs`` (query_id, id and others) that the scopes and lenses of ``queries`` allow.

    ``queries`` has query_id and any of scope, scope_match, as_of, known_as_of, sys_as_of and categories (an
    array; an empty one allows nothing); what is null or missing allows all. Pairs are tested one by one, so that a query that may see every memory costs no more
    than its hits do.
    """
    lens = lens_of(queries)
    if not lens:
        return pairs
    own = memories.select("id", *[c for c in SEEN_BY if c in memories.columns])
    rows = pairs.join(own, "id").join(queries.select("query_id", *[F.col(c).alias(f"_{c}") for c in lens]), "query_id")
    if "scope" in lens:
        match = F.coalesce("_scope_match", F.lit("prefix")) if "scope_match" in lens else F.lit("prefix")
        rows = rows.where(F.col("_scope").isNull() | scope_match(F.col("scope"), F.col("_scope"), match))
    if "categories" in lens:
        rows = rows.where(F.col("_categories").isNull() | F.array_contains("_categories", F.col("category")))
    for name, test in (("as_of", valid_at), ("known_as_of", known_by), ("sys_as_of", in_system_at)):
        if name in lens:
            rows = rows.where(F.col(f"_{name}").isNull() | test(F.col(f"_{name}")))
    return rows.select(pairs.columns)


def scope_prefix_join(memories: DataFrame, scopes: DataFrame) -> DataFrame:
    """(asked, id) for each asked scope and each memory at or under it."""
    above = memories.select("id", F.explode(ancestors(F.col("scope"))).alias("asked"))
    return scopes.select(F.col("scope").alias("asked")).distinct().join(above, "asked").select("asked", "id")


def read_by_ids(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id, status): ``ok`` for requests (request_id, id, scope) of the memory's scope, else ``scope_denied``.

    Ids may carry the table's prefix; missing ids give no row.
    """
    bare = requests.withColumn("id", F.regexp_replace("id", "^memory:", "")).withColumnRenamed("scope", "_asked")
    status = F.when(F.col("scope") == F.col("_asked"), "ok").otherwise("scope_denied")
    return bare.join(memories.select("id", "scope", "version"), "id").select("request_id", "id", status.alias("status"), "version")


def list_memories(memories: DataFrame, limit: int, cursor: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """A page, newest first, and the cursor (valid_from, id) of the next one: empty after the last page.

    The order with a limit is a top-k in each partition; no whole sort.
    """
    rows = memories
    if cursor is not None:
        at, last = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col("valid_from") < at) | ((F.col("valid_from") == at) & (F.col("id") < last)))
    page = rows.orderBy(F.desc("valid_from"), F.desc("id")).limit(limit + 1)
    numbered = page.withColumn("_n", F.count("*").over(_all_of_page()))
    taken = page.orderBy(F.desc("valid_from"), F.desc("id")).limit(limit)
    following = taken.orderBy("valid_from", "id").limit(1).join(numbered.where(F.col("_n") > limit).select("_n").limit(1), F.lit(True)).select("valid_from", "id")
    return taken, following


def _all_of_page():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def count_memories(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table: a snapshot's manifest."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out
