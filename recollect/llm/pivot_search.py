"""Exact top-k inner products through a pivot-distance index.

Inner products become distances: with M the greatest norm, a candidate x gains the coordinate
sqrt(M^2 - |x|^2) and a query the coordinate 0, and then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Each candidate
is keyed by its nearest pivot and its distance from it; distances fall into annuli with exact least and
greatest distances, and an annulus is stored as blocks of a bounded number of rows, however many there are.
By the triangle inequality an annulus's best score for a query has an upper bound; a query visits annuli in
order of that bound, in rounds, and stops where it falls under the k-th score that it has.

Pivots and the annuli's edges are fitted on a bounded sample; every row is indexed, and they decide only
how much is pruned. Pivots grow with the square root of the rows between ``PIVOTS``; the annuli are as many
times ``RINGS``, which is all that goes through the driver.

Chunks of queries meet blocks by (annulus, span, group): an annulus's blocks are dealt into spans of
``BLOCKS_PER_KEY``, the chunks into groups of ``CHUNKS_PER_KEY``. Chunks go to each span of their annulus and
blocks to each group, so that a key's work is bounded however many rows and queries an annulus has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import slices, written

SAMPLE_ROWS = 2048
#: The least and the greatest number of pivots.
PIVOTS = (32, 256)
RINGS = 8
BLOCK_ROWS = 2048
CHUNK_QUERIES = 256
BLOCKS_PER_KEY = 16
CHUNKS_PER_KEY = 16
ROUNDS = (1, 6, None)
SCALE = 1024
#: Room for rounding in distances, as a share of the largest one.
SLACK = 1e-6
EXACT = float(1 << 53)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x (floor(1024 * component) as longs), norm2 and asks of the rows that take part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long"))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), x.alias("x"), "asks")
    return rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c))


def _distances(x: np.ndarray, pivots: np.ndarray, most2: float, query: bool) -> np.ndarray:
    """Distances of rows, as candidates or as queries, from the pivots, which are candidates."""
    x2, p2 = (x * x).sum(1)[:, None], (pivots * pivots).sum(1)[None, :]
    lift = 0.0 if query else np.sqrt(np.maximum(most2 - x2, 0) * np.maximum(most2 - p2, 0))
    own = x2 if query else most2
    return np.sqrt(np.maximum(own + most2 - 2 * (x @ pivots.T) - 2 * lift, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pivots_for(n: int) -> int:
    """A sixty-fourth of the root of ``n`` rows, within PIVOTS."""
    return min(max(PIVOTS[0], math.isqrt(n) // 64), PIVOTS[1])


def fit(rows: DataFrame, dim: int, most2: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` pivots, and each pivot's annulus edges, from at most SAMPLE_ROWS rows of least hash."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("x").collect()
    sample = np.array([r.x for r in drawn], "f8").reshape(-1, dim)
    chosen = [0]
    far = _distances(sample, sample[:1], most2, False)[:, 0]
    while len(chosen) < min(most, len(sample)) and far.max() > 0:  # the row farthest from all pivots so far
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]], most2, False)[:, 0])
    pivots = sample[chosen]
    d = _distances(sample, pivots, most2, False)
    nearest, least = d.argmin(1), d.min(1)
    share = np.linspace(0, 1, RINGS + 1)[1:-1]
    edges = np.array([np.quantile(least[nearest == p], share) if (nearest == p).any() else np.zeros(RINGS - 1) for p in range(len(pivots))])
    return pivots, edges


def _keyer(dim: int, pivots: np.ndarray, edges: np.ndarray, most2: float) -> Callable:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_matrix(batch.column("x"), dim).astype("f8"), pivots, most2, False)
            pivot, dist = d.argmin(1), d.min(1)
            ring = (edges[pivot] < dist[:, None]).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "vec_id", "x")), pa.array((pivot * RINGS + ring).astype("i4")), pa.array(dist)],
                ["row", "vec_id", "x", "annulus", "dist"],
            )

    return key


KEYED = "row long, vec_id long, x array<long>, annulus int, dist double"


def build_index(rows: DataFrame, dim: int, pivots: np.ndarray, edges: np.ndarray, most2: float) -> tuple[DataFrame, list[tuple]]:
    """The written index, a row for each block with annulus, span, rows, ids and vectors; and (annulus, low, high, spans) of the annuli.

    An annulus of more than a block's rows (a hot vector's, say) is dealt into several by a hash.
    """
    keyed = written(rows.select("row", "vec_id", "x").mapInArrow(_keyer(dim, pivots, edges, most2), KEYED), "pivot-keys")
    annuli = keyed.groupBy("annulus").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).orderBy("annulus").collect()
    parts = [1] * (len(pivots) * RINGS)
    for r in annuli:
        parts[r.annulus] = -(-r.n // BLOCK_ROWS)
    part = F.pmod(F.xxhash64("row", F.lit(11)), F.get(F.lit(parts), F.col("annulus")).cast("long"))
    blocks = keyed.groupBy("annulus", part.alias("part")).agg(F.collect_list(F.struct("row", "vec_id", "x")).alias("rows"))
    index = blocks.select(
        "annulus", F.floor(F.col("part") / BLOCKS_PER_KEY).cast("int").alias("span"), F.transform("rows", lambda r: r["row"]).alias("rows"), F.transform("rows", lambda r: r["vec_id"]).alias("ids"),
        F.flatten(F.transform("rows", lambda r: r["x"])).alias("vectors"),
    )
    return written(index, "pivot-blocks"), [(r.annulus, r.low, r.high, -(-parts[r.annulus] // BLOCKS_PER_KEY)) for r in annuli]


def met(asked: DataFrame, index: DataFrame, annuli: list[tuple], chunks: int) -> DataFrame:
    """Each chunk of queries beside each block of its annulus, with the key (annulus, span, group) where they met."""
    spans = [1] * (1 + max((a[0] for a in annuli), default=0))
    for name, _, _, n in annuli:
        spans[name] = n
    each = F.sequence(F.lit(0), F.get(F.lit(spans), F.col("annulus")) - 1)
    sent = asked.select("annulus", F.explode(each).alias("span"), F.floor(F.col("chunk") / CHUNKS_PER_KEY).cast("int").alias("group"), "asked")
    groups = F.sequence(F.lit(0), F.lit(-(-chunks // CHUNKS_PER_KEY) - 1))
    blocks = index.withColumn("group", F.explode(groups))
    return sent.join(blocks.hint("merge"), ["annulus", "span", "group"])


def _router(dim: int, pivots: np.ndarray, annuli: list[tuple], most2: float, first: int, last: int | None) -> Callable:
    """Rows (annulus, chunk, row, query_id, q, kth) for the annuli at places ``first`` to ``last`` of a query's order that its bound allows."""
    names = np.array([a[0] for a in annuli], "i4")
    pivot, low, high = names // RINGS, np.array([a[1] for a in annuli]), np.array([a[2] for a in annuli])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            q = _matrix(batch.column("q"), dim).astype("f8")
            d = _distances(q, pivots, most2, True)[:, pivot]
            gap = np.maximum(np.maximum(low - d, d - high), 0)
            gap = np.maximum(gap - SLACK * (1 + np.maximum(d, high)), 0)
            bound = ((q * q).sum(1)[:, None] + most2 - gap * gap) / 2
            bound += SLACK * np.abs(bound) + 1
            order = np.argsort(-bound, 1, kind="stable")[:, first:last]
            kth = batch.column("kth").to_numpy(zero_copy_only=False)
            keep = np.take_along_axis(bound, order, 1) >= np.where(np.isnan(kth), -np.inf, kth)[:, None]
            at, place = np.nonzero(keep)
            take = pa.array(at)
            kept = ("chunk", "row", "query_id", "q", "kth")
            yield pa.RecordBatch.from_arrays([pa.array(names[order[at, place]]), *(batch.column(c).take(take) for c in kept)], ["annulus", *kept])

    return route


ROUTED = "annulus int, chunk int, row long, query_id long, q array<long>, kth double"


def _scorer(dim: int, k: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values.to_numpy(zero_copy_only=False)
                ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                x = batch.column("vectors")[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                asked = batch.column("asked")[i].values
                query, own = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("query_id", "row"))
                q = asked.field("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                kth = asked.field("kth").to_numpy(zero_copy_only=False).astype("f8")
                if float(np.abs(x).max()) * float(np.abs(q).max()) * dim < EXACT:
                    scores = (q.astype("f8") @ x.astype("f8").T).astype("i8")
                else:
                    scores = q @ x.T
                out: list[tuple] = []
                for j, row in enumerate(scores):
                    able = np.flatnonzero((rows != own[j]) & ((row >= kth[j]) | np.isnan(kth[j])))
                    if len(able) > k:
                        able = able[np.lexsort((ids[able], -row[able]))[:k]]
                    out.append((np.full(len(able), query[j]), ids[able], row[able]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype("i8")) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return score


SCORED = "query_id long, vec_id long, score long"


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` highest inner products of quantised vectors.

    ``vectors`` has vec_id and embedding; ``is_query`` says which rows are queries. Vectors that are null or
    empty, hold null or non-finite components, or have no vec_id take no part, and a query is scored
    against vectors of its own dimension. Of rows that share a query's vec_id, the one of the least vector
    asks; all rows but this one are its candidates, and repeated ones count each. Ties go to
    the smaller vec_id. No queries, or no candidates, give no rows; other columns are left alone.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pivot-vectors")
    asking = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("dim", "x", "row")).alias("m")).select(F.col("vec_id").alias("query_id"), "m.*")
    asking = written(asking.withColumnRenamed("x", "q"), "pivot-queries")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shapes = rows.groupBy("dim").agg(F.max("norm2").alias("most2"), F.count("*").alias("n")).collect()  # a row a dimension
    for dim, most2, n in sorted(map(tuple, shapes)):
        out = out.unionByName(_of_dimension(rows.where(F.col("dim") == dim), asking.where(F.col("dim") == dim), dim, most2, n, k))
    return out


def _of_dimension(rows: DataFrame, asking: DataFrame, dim: int, most2: float, n: int, k: int) -> DataFrame:
    most2 = float(most2)
    pivots, edges = fit(rows, dim, most2, pivots_for(n))
    index, annuli = build_index(rows, dim, pivots, edges, most2)
    chunks = max(1, -(-asking.count() // CHUNK_QUERIES))
    queries = asking.select(F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), "row", "query_id", "q", F.lit(None).cast("double").alias("kth"))
    found = None
    first = 0
    for width in ROUNDS:
        last = None if width is None else first + width
        routed = queries.mapInArrow(_router(dim, pivots, annuli, most2, first, last), ROUTED)
        asked = routed.groupBy("annulus", "chunk").agg(F.collect_list(F.struct("row", "query_id", "q", "kth")).alias("asked"))
        pairs = met(asked, index, annuli, chunks).select("rows", "ids", "vectors", "asked")
        scored = pairs.mapInArrow(_scorer(dim, k), SCORED)
        found = best(scored if found is None else found.unionByName(scored), k)
        if width is None:
            return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found = written(found.select("query_id", "vec_id", "score"), "pivot-found")
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
        queries = queries.drop("kth").join(kth, "query_id", "left").select("chunk", "row", "query_id", "q", "kth")
        first = last
    raise AssertionError("the last round takes all blocks")
