"""Each query's best texts by weights of terms, without a row for every match.

Texts go to the tasks as rows of their weighted terms, or of their counted ones, which the tasks weigh; queries go as a broadcast block. A batch of texts knows each term's
greatest weight in it; a query whose greatest weights can't sum up to the k-th score that the task has found
for it, or that lacks a term it must have, passes over the batch. What leaves a task is ``k`` rows a query at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.lenses import SEEN_BY, Lens, lens_of
from recollect.sources.shared import saved

QUERY_ROWS = 4096
BATCH_ROWS = 2048
DIGITS = 9
#: Room for rounding in sums of greatest weights.
SLACK = 1e-10


class _Block:
    """Queries by number, with their terms by number."""

    def __init__(self, part: pa.Table):
        self.ids = part.column("query_id").combine_chunks()
        self.needed = part.column("n_terms").to_numpy()
        terms = part.column("terms").combine_chunks()
        coded = terms.flatten().dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.flat = coded.indices.to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
        self.idf = np.zeros(len(self.names))
        if "idf" in part.column_names:
            self.idf[self.flat] = part.column("idf").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.lens = Lens(part)


def _postings(batch: pa.RecordBatch, number: dict[str, int], n_terms: int, column: str = "weighted", value: str = "weight") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, rows, weights) of the block's terms in a batch of texts, by term."""
    weighted = batch.column(column)
    rows = np.repeat(np.arange(batch.num_rows), weighted.value_lengths().to_numpy(zero_copy_only=False))
    inner = weighted.flatten()
    coded = inner.field("term").dictionary_encode()
    of = np.array([number.get(name, -1) for name in coded.dictionary.to_pylist()] or [-1])[coded.indices.to_numpy(zero_copy_only=False)]
    weight = inner.field(value).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(of >= 0)
    kept = kept[np.argsort(of[kept], kind="stable")]
    return np.searchsorted(of[kept], np.arange(n_terms + 1)), rows[kept], weight[kept]


def _weighed(batch: pa.RecordBatch, number: dict[str, int], idf: np.ndarray, factor: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a batch of counted terms, weighed here."""
    starts, rows, tf = _postings(batch, number, len(idf), "held", "tf")
    lengths = batch.column("length").fill_null(0).to_numpy(zero_copy_only=False)
    return starts, rows, np.repeat(idf, np.diff(starts)) * factor(tf, lengths[rows])


def _finder(block, k: int, every: bool, factor: Callable | None) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Block = block.value
        number, n = {name: i for i, name in enumerate(asked.names)}, len(asked.ids)
        if not n:
            return
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object))] * n
        kth = np.full(n, -np.inf)
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(low, BATCH_ROWS)
                starts, rows, weights = _weighed(batch, number, asked.idf, factor) if factor else _postings(batch, number, len(asked.names))
                has = np.diff(starts) > 0
                most = np.zeros(len(has))
                most[has] = np.maximum.reduceat(weights, starts[:-1][has]) if has.any() else 0
                bound = np.add.reduceat(most[asked.flat], asked.starts[:-1]) + SLACK
                met = np.add.reduceat(has[asked.flat].astype("i8"), asked.starts[:-1])
                alive = np.flatnonzero((met == asked.needed if every else met > 0) & (np.round(bound, DIGITS) >= kth))
                if not len(alive):
                    continue
                mask = asked.lens.mask(batch)
                names = None
                for q in alive.tolist():
                    spans = [(starts[t], starts[t + 1]) for t in asked.flat[asked.starts[q] : asked.starts[q + 1]]]
                    at = np.concatenate([rows[a:b] for a, b in spans])
                    scores = np.bincount(at, np.concatenate([weights[a:b] for a, b in spans]), batch.num_rows)
                    count = np.bincount(at, minlength=batch.num_rows)
                    able = np.flatnonzero(mask[q] & (count == asked.needed[q] if every else count > 0) & (np.round(scores, DIGITS) >= kth[q]))
                    if not len(able):
                        continue
                    if names is None:
                        names = np.array(batch.column("id").to_pylist(), object)
                    score, name = np.concatenate([best[q][0], scores[able]]), np.concatenate([best[q][1], names[able]])
                    order = np.lexsort((name, -np.round(score, DIGITS)))[:k]
                    best[q] = score[order], name[order]
                    if len(order) == k:
                        kth[q] = round(float(score[order[-1]]), DIGITS)
        lengths = [len(score) for score, _ in best]
        of = pa.array(np.repeat(np.arange(n), lengths))
        yield pa.RecordBatch.from_arrays(
            [asked.ids.take(of), pa.array(np.concatenate([name for _, name in best]), pa.string()), pa.array(np.concatenate([score for score, _ in best]))], ["query_id", "id", "score"]
        )

    return find


def best_texts(queries: DataFrame, terms: DataFrame, weights: DataFrame, memories: DataFrame, k: int, match: str = "all") -> DataFrame:
    """(query_id, id, score): among these rows are the ``k`` best texts of each query, ``k`` rows a query and task at most.

    ``terms`` (query_id, term, n_terms) are the queries' distinct terms, ``weights`` (id, term, weight) what
    each is worth in each text; a text scores the sum, for all terms or for any. Ties, at 9 digits, go to the smaller id.
    Texts must be seen by a query's scope and lenses (see ``lenses.seen``). Queries go out in blocks of
    ``QUERY_ROWS``; each block is a pass over the weights.
    """
    weighted = weights.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("weighted"))  # a text's terms
    if lens_of(queries):
        weighted = weighted.join(memories.select("id", *seen_by(memories)), "id")
    return _passes(queries, terms, weighted, k, match)


def best_of_counts(queries: DataFrame, terms: DataFrame, factor: Callable, counts: DataFrame, k: int, match: str = "all") -> DataFrame:
    """``best_texts`` without a table of weights: ``counts`` are texts with held (an array of term and tf), weighed in the tasks, and their length in tokens.

    ``terms`` have idf too. A term is worth that times ``factor`` of its occurrences in a text and the text's length (arrays).
    """
    return _passes(queries, terms, counts, k, match, factor)


def seen_by(memories: DataFrame) -> list[str]:
    return [c for c in SEEN_BY if c in memories.columns]


def _passes(queries: DataFrame, terms: DataFrame, rows: DataFrame, k: int, match: str, factor: Callable | None = None) -> DataFrame:
    spark = queries.sparkSession
    idf = [F.collect_list("idf").alias("idf")] if factor else []
    listed = terms.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.first("n_terms").alias("n_terms"), *idf)
    asked = saved(listed.join(queries.select("query_id", *lens_of(queries)), "query_id"), "asked")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    rows = saved(rows, "weighted") if blocks > 1 and not factor else rows
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id string, score double"
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)) == block).toArrow()
        found = rows.mapInArrow(_finder(spark.sparkContext.broadcast(_Block(part)), k, match == "all", factor), kind)
        out = found if out is None else out.unionByName(found)
    return out
