"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text, weighted by 1 + log(count)
and the smoothed inverse document frequency over all training documents, at length 1. Training is follow
the regularised leader, coordinate by coordinate, with an elastic net: the l1 part keeps weights at 0, the
l2 part shrinks the others. It runs on a bounded sample, drawn evenly by language; a part of that sample
is kept back to set the temperature that divides the scores before they become probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import during_writes, sliced

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Labelled documents in the training sample, at most; corpus statistics are over all of them.
SAMPLE = 3000
KEPT_BACK = 5  # one in so many
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], "u4")


def counts_of(text: str) -> np.ndarray:
    """How often each feature occurs in a text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.zeros(FEATURES, "i8")
    with np.errstate(over="ignore"):
        for order in ORDERS:
            n = len(chars) - order + 1
            if n <= 0:
                continue
            h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, "u4")
            for k in range(order):
                h = (h ^ chars[k : k + n]) * MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(FEATURES - 1), minlength=FEATURES)
    return counts


def weighed(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's TF-IDF vector, at length 1."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / (np.sqrt(values @ values) or 1.0)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x labels
    bias: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        at, values = weighed(counts_of(text), self.idf)
        return values @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.scores(text) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that follow from the sums of gradients: 0 within l1, else the regularised leader's."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after EPOCHS passes over (indices, values, label)."""
    z, n = np.zeros((FEATURES + 1, n_labels)), np.zeros((FEATURES + 1, n_labels))
    for _ in range(EPOCHS):
        for at, values, label in examples:
            rows, x = np.append(at, FEATURES), np.append(values, 1.0)
            w = leader(z[rows], n[rows])
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = leader(z, n)
    return w[:FEATURES], w[FEATURES]


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log likelihood."""
    if not len(labels):
        return 1.0
    tried = np.geomspace(0.05, 5, 60)
    losses = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES, "i8")
    for batch in batches:
        for text in batch.column("text").to_pylist():
            df += counts_of(text) > 0
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(df[at])], ["feature", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages in ``labelled`` (text, lang; rows where either is null or empty don't count).

    Labels, their counts and document frequencies are over all rows; weights are fitted on at most
    ``sample`` different texts, as many of each language as there are, by the least hashes of the texts:
    copies of one text count once.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang")
    sizes = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("text")).alias("texts")).collect()}
    labels = sorted(sizes)
    df = np.zeros(FEATURES)
    if not labels:
        return Model([], df, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    counted = rows.select("text").mapInArrow(sliced(_document_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    with during_writes(labelled.sparkSession):
        found = counted.toArrow()  # FEATURES rows at most
    df[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1 + sum(r.n for r in sizes.values())) / (1 + df)) + 1
    quota = max(1, sample // len(labels))
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    odds = F.create_map(*[F.lit(v) for name in labels for v in (name, min(1.0, 1.3 * quota / sizes[name].texts))])
    drawn = rows.where(draw < F.element_at(odds, F.col("lang"))).distinct().withColumn("h", F.xxhash64("text", F.lit(3)))
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("place") <= quota)
    found = drawn.mapInArrow(sliced(_examples(idf, labels)), "h long, label int, at array<int>, value array<float>")
    with during_writes(labelled.sparkSession):
        found = found.toArrow()  # at most ``sample`` rows
    for batch in found.sort_by([("h", "ascending"), ("label", "ascending")]).to_batches():
        ends = batch.column("at").offsets.to_numpy()
        at, value = batch.column("at").values.to_numpy(), batch.column("value").values.to_numpy()
        examples += [(at[a:b], value[a:b], label) for a, b, label in zip(ends, ends[1:], batch.column("label").to_pylist())]
    back, used = examples[::KEPT_BACK], [x for i, x in enumerate(examples) if i % KEPT_BACK] or examples
    weights, bias = train(used, len(labels))
    scores = np.array([values @ weights[at] + bias for at, values, _ in back]).reshape(-1, len(labels))
    temperature = best_temperature(scores, np.array([label for _, _, label in back], int))
    return Model(labels, idf, weights, bias, temperature)


def _examples(idf: np.ndarray, labels: list[str]) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weighed(counts_of(text), idf) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("h"),
                    pa.array([labels.index(x) for x in batch.column("lang").to_pylist()], pa.int32()),
                    pa.array([at.astype("i4") for at, _ in found], pa.list_(pa.int32())),
                    pa.array([values.astype("f4") for _, values in found], pa.list_(pa.float32())),
                ],
                ["h", "label", "at", "value"],
            )

    return make


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score for each row of ``docs``; ``und`` and 0 where ``text`` has no letter."""
    fields = [docs.schema[c] for c in keep]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES rows by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(text) for text in batch.column("_text").to_pylist()]
            columns = [batch.column(i) for i in range(len(fields))]
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + made, [*keep, "lang_pred", "score"])

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(sliced(run), schema)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learns from the rows that aren't held out. Languages are those of these rows; without any, all rows are
    ``und``. Rows stand alone, also where a doc_id is null or repeated; an empty table gives no rows; other
    columns are left alone, and no prediction sees any column but the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows, model, ["doc_id", "held_out"])


def confident(docs: DataFrame, times: float = 1.5) -> DataFrame:
    """The rows of ``docs`` (text, lang and others) with a language: not ``und``, and not under ``times`` chance.

    The model learns from the rows of ``docs`` whose lang isn't null. Rows and columns that stay are unchanged.
    """
    model = fit(docs)
    least = min(times / max(1, len(model.labels)), 1.0)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever they are called, no name clashes
    found = predict(docs.toDF(*names), model, names, names[docs.columns.index("text")])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(names).toDF(*docs.columns)
