"""Approximate neighbours by lists around centroids: a query is scored against the rows of its nearest lists only.

The number of lists follows the table's size. Centroids are fitted on a bounded sample; every row is in the list of its nearest
centroid, and a list is stored as blocks of a bounded number of rows, so that a crowded one is many keys. A
query's lists are taken in order of their centroids' cosine. Queries and blocks meet by (list, block), each vector
once for a block and a chunk of queries, and a block gives each query its ``k`` best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from recollect.operators.lenses import SEEN_BY, Lens, lens_of
from recollect.operators.lexical import top_k_per_query
from recollect.operators.vectors import BLOCK_ROWS, knn_search, units
from recollect.sources.shared import saved

SAMPLE_ROWS = 16_384
MOST_LISTS = 4096
STEPS = 6
SHARE = 0.06
CHUNK_QUERIES = 256
#: Up to so many rows of vectors a search by lists costs more than it saves.
EXACT_ROWS = 200_000


def list_count(n: int) -> int:
    """How many lists for ``n`` rows: twice the square root, 4,096 at most, so that centroids and rows in a list cost about the same."""
    return max(1, min(round(2 * math.sqrt(n)), MOST_LISTS))


def _drawn(rows: DataFrame, n: int | None) -> pa.Table:
    """The ``SAMPLE_ROWS`` rows of least hash. Of many rows (``n`` of them) those are looked for among four times as many, by a bound of the hash."""
    hashed = F.xxhash64("id")
    least = lambda df: df.orderBy(hashed, "id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    if n and n > 8 * SAMPLE_ROWS:
        some = least(rows.where(hashed < (1 << 64) * 4 * SAMPLE_ROWS // n - (1 << 63)))
        if some.num_rows == SAMPLE_ROWS:
            return some
    return least(rows)


def fit_lists(rows: DataFrame, dim: int, lists: int, seed: int = 5, n: int | None = None) -> np.ndarray:
    """Centroids of length 1 from at most ``SAMPLE_ROWS`` rows (id, embedding), those of least hash: spherical k-means.

    They decide how good the search is, not which rows take part. Similarities are made ``CHUNK_QUERIES`` rows at a time:
    all at once they would take the driver memory by rows and lists.
    """
    drawn = _drawn(rows, n)
    x = units(drawn.column("embedding").combine_chunks(), dim)
    draw = np.random.default_rng(seed)
    centres = x[np.sort(draw.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(STEPS):
        nearest = _nearest_list(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), centres)
    return centres


def _nearest_list(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    parts = [(x[low : low + CHUNK_QUERIES] @ centres.T).argmax(1) for low in range(0, len(x), CHUNK_QUERIES)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def _assigner(centres: np.ndarray, names: list[str]) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column("embedding"), centres.shape[1])
            own = _nearest_list(x, centres).astype("i4")
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own)], [*names, "list"])

    return assign


def _prober(centres: np.ndarray, probes: int, names: list[str]) -> Callable:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, CHUNK_QUERIES) for whole in batches for low in range(0, whole.num_rows, CHUNK_QUERIES)):
            near = units(batch.column("embedding"), centres.shape[1]) @ centres.T
            chosen = np.argsort(-near, 1, kind="stable")[:, :probes].astype("i4")
            take = pa.array(np.repeat(np.arange(batch.num_rows), chosen.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), pa.array(chosen.reshape(-1))], [*names, "list"])

    return probe


def _listed(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("list", IntegerType())])


def _table(structs: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([structs.field(i) for i in range(structs.type.num_fields)], [f.name for f in structs.type])


def _scorer(dim: int, k: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, asked = _table(batch.column("rows")[i].values), _table(batch.column("asked")[i].values)
                scores = units(asked.column("embedding"), dim) @ units(rows.column("embedding"), dim).T
                ranked = np.where(Lens(pa.Table.from_batches([asked])).mask(rows), np.round(scores, 9), -np.inf)
                names = np.array(rows.column("id").to_pylist(), object)
                found = []
                for j in range(len(ranked)):
                    able = np.flatnonzero(ranked[j] > -np.inf)
                    if len(able) > k:
                        able = able[ranked[j, able] >= np.partition(ranked[j, able], -k)[-k]]
                        able = able[np.lexsort((names[able], -ranked[j, able]))[:k]]
                    found.append(able)
                of = np.repeat(np.arange(len(found)), [len(f) for f in found])
                at = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(of)), pa.array(names[at], pa.string()), pa.array(scores[of, at])], ["query_id", "id", "score"])

    return score


class Lists:
    """An index of the vectors (id, embedding and, for lenses, scope and times) of one dimension."""

    def __init__(self, memories: DataFrame, dim: int, lists: int | None = None, seed: int = 5):
        self.dim = dim
        self.kept = [c for c in ("id", "embedding", *SEEN_BY) if c in memories.columns]
        rows = memories.where(F.size("embedding") == dim).select(self.kept)
        self.n = rows.count()
        self.centres = fit_lists(rows, dim, lists or list_count(self.n), seed, self.n) if self.n else np.zeros((0, dim))
        keyed = saved(rows.mapInArrow(_assigner(self.centres, self.kept), _listed(rows)), "listed") if self.n else None
        self.sizes = [0] * len(self.centres)  # at most MOST_LISTS
        if keyed is None:
            return
        for r in keyed.groupBy("list").agg(F.count("*").alias("n")).collect():
            self.sizes[r.list] = r.n
        self.parts = [max(1, -(-n // BLOCK_ROWS)) for n in self.sizes]
        part = F.pmod(F.xxhash64("id"), F.get(F.lit(self.parts), F.col("list"))).cast("int")
        blocks = keyed.groupBy("list", part.alias("part")).agg(F.collect_list(F.struct(*self.kept)).alias("rows"))
        self.blocks = saved(blocks, "list-blocks")

    def routed(self, queries: DataFrame, share: float = SHARE) -> DataFrame:
        """Each query once for each of its lists: the nearest ``share`` of all, at least one."""
        names = ["query_id", "embedding", *lens_of(queries)]
        own = queries.where(F.size("embedding") == self.dim).select(names)
        probes = max(1, math.ceil(share * len(self.centres)))
        return own.mapInArrow(_prober(self.centres, probes, names), _listed(own))

    def scored_pairs(self, queries: DataFrame, share: float = SHARE) -> DataFrame:
        """(query_id, scored, rows): how many of all rows a query is scored against."""
        counted = self.routed(queries, share).select("query_id", F.get(F.lit(self.sizes), F.col("list")).alias("n"))
        return counted.groupBy("query_id").agg(F.sum("n").alias("scored"), F.lit(self.n).cast("long").alias("rows"))

    def search(self, queries: DataFrame, k: int, share: float = SHARE) -> DataFrame:
        """(query_id, id, score, rank1) of the ``k`` nearest among the rows of each query's lists; fewer, where those have fewer."""
        names = ["query_id", "embedding", *lens_of(queries)]
        parts = F.get(F.lit(self.parts), F.col("list"))
        asked = self.routed(queries, share).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
        chunk = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(chunks))
        asked = asked.groupBy("list", "part", chunk.alias("chunk")).agg(F.collect_list(F.struct(*names)).alias("asked"))
        # Routed queries are many times the table that they come from, by whose size Spark would send them through the driver.
        pairs = asked.hint("merge").join(self.blocks, ["list", "part"]).select("rows", "asked")
        kind = queries.schema["query_id"].dataType.simpleString()
        return top_k_per_query(pairs.mapInArrow(_scorer(self.dim, k), f"query_id {kind}, id string, score double"), k)


def knn_search_lists(queries: DataFrame, memories: DataFrame, k: int, share: float = SHARE, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(query_id, id, score, rank1): each query's ``k`` nearest by cosine under its lenses, among the rows of its nearest lists.

    Vectors of each dimension have an index of their own; up to ``exact_rows`` of them are searched exactly, which is faster
    there, and so are queries that find fewer than ``k``. Queries and memories without values take no part.
    ``Lists.scored_pairs`` says what a search costs, ``vectors.knn_recall`` what it finds.
    """
    asked = saved(queries.where(F.size("embedding") > 0).select("query_id", "embedding", *lens_of(queries)), "asked")
    shapes = memories.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    found = None
    for dim, n in sorted(map(tuple, shapes.collect())):  # a row a dimension
        if n > exact_rows:
            some = Lists(memories, dim).search(asked, k, share)
            found = some if found is None else found.unionByName(some)
    if found is None:
        return knn_search(asked, memories, k)
    found = saved(found, "near")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = saved(asked.join(enough, "query_id", "left_anti"), "few")
    if not few.limit(1).count():
        return found
    return found.join(few.select("query_id"), "query_id", "left_anti").unionByName(knn_search(few, memories, k))
