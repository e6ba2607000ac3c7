"""Text quality from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.llm.labelled import labelled_sample
from gatelake.llm.words import BLANK, LOWER, buffer_of, mix, slices, span_hashes

#: Word vectors are kept for this many hash buckets (4 MB); words of a bucket share a vector.
BUCKETS = 1 << 15
#: Length of a vector and number of its non-zero entries in a word's index vector.
SIZE, NONZERO = 32, 4
#: Neighbours on each side whose index vectors a word gathers.
REACH = 2
#: Labelled rows of each class that a fit uses at most.
SAMPLE_PER_CLASS = 4000
#: Units of the hidden layer.
HIDDEN = 16
#: Score from which a text is predicted to be of label 1.
GOOD = 0.3

#: 0 blank, 1 part of a word, 2 other sign.
_CLASS = np.array([0 if BLANK[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Stands before a word in capitals, as its own word.
_CAPITALS = 1


def index_vectors() -> np.ndarray:
    """Sparse vectors of +1 and -1, fixed by their seed."""
    random = np.random.default_rng(20)
    out = np.zeros((BUCKETS, SIZE), np.int8)
    place = random.random((BUCKETS, SIZE)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, random.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and run of signs, and token offsets of the texts.

    Letters are in lower case; a mark stands before each longer word of capitals.
    """
    kind = _CLASS[data]
    n = len(data)
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    bucket = (span_hashes(LOWER[data], starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    loud = (ends - starts > 1) & (capitals[ends] - capitals[starts] == ends - starts)
    at = np.arange(len(starts)) + np.cumsum(loud)
    out = np.full(len(starts) + int(loud.sum()), int(mix(np.array([_CAPITALS]))[0]) & (BUCKETS - 1), np.int64)
    out[at] = bucket
    of = np.searchsorted(starts, offsets)
    return out, of + np.concatenate([[0], np.cumsum(loud)])[of]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors for every bucket that a task has seen."""
    index = index_vectors()
    total = np.zeros((SIZE, BUCKETS))  # whole numbers, so sums are exact
    seen = np.zeros(BUCKETS, bool)
    for batch in batches:
        data, offsets = buffer_of(batch.column(0))
        for i, j in slices(data, offsets):
            words, of = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            text = np.repeat(np.arange(j - i), np.diff(of))
            own = index[words]
            near = np.zeros(own.shape, np.int16)
            for step in range(1, REACH + 1):
                same = (text[step:] == text[:-step])[:, None]
                near[step:] += own[:-step] * same
                near[:-step] += own[step:] * same
            for d in range(SIZE):
                total[d] += np.bincount(words, weights=near[:, d], minlength=BUCKETS)
            seen[words] = True
    found = np.flatnonzero(seen)
    columns = [pa.array(found.astype(np.int32)), *(pa.array(total[d, found].astype(np.int64)) for d in range(SIZE))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"c{d}" for d in range(SIZE))])


def word_vectors(documents: DataFrame, text: str) -> np.ndarray:
    """Unit context vector of every bucket, learned from all texts; zero where no word fell.

    Tasks sum inside themselves first; at most ``BUCKETS`` rows reach the driver.
    """
    columns = [f"c{d}" for d in range(SIZE)]
    schema = "bucket int, " + ", ".join(f"{c} long" for c in columns)
    rows = (
        documents.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(_gather, schema)
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in columns])
        .toPandas()
    )
    out = np.zeros((BUCKETS, SIZE))
    out[rows["bucket"].to_numpy(np.int64)] = rows[columns].to_numpy(float)
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0).astype(np.float32)


def _pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text, zero for a text without words."""
    words, of = _tokens(data, offsets)
    count = np.diff(of)
    out = np.zeros((len(count), vectors.shape[1]))
    has = np.flatnonzero(count)
    if len(has):
        out[has] = np.add.reduceat(vectors[words].astype(np.float64), of[has], axis=0) / count[has, None]
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; the logit is divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _loss(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    return float(np.sum(weight * (np.logaddexp(0, logit) - label * logit)))


def fit_network(x: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 400) -> Network:
    """Fit on three quarters of the rows, then choose the temperature on the last quarter.

    Full-batch Adam from a seeded start. With one class only, the probability is
    the share of label 1; with no row, one half.
    """
    n, size = x.shape
    share = float(np.average(label, weights=weight)) if n else 0.5
    if n < 8 or label.min() == label.max():
        bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), bias)
    check = np.arange(n) % 4 == 3
    fit_x, fit_y, fit_w = x[~check], label[~check], weight[~check] / weight[~check].sum()
    centre, scale = fit_x.mean(0), fit_x.std(0) + 1e-6
    random = np.random.default_rng(10)
    params = [
        random.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN),
        np.array(0.0),
    ]
    z = (fit_x - centre) / scale
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        w1, b1, w2, b2 = params
        hidden = np.tanh(z @ w1 + b1)
        gap = fit_w * (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500))) - fit_y)
        back = gap[:, None] * w2[None] * (1 - hidden**2)
        slopes = [z.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ gap + 1e-4 * w2, gap.sum()]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            step = 0.02 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-9)
            params[k] = params[k] - step
    net = Network(centre, scale, params[0], params[1], params[2], float(params[3]))
    logit = net.logits(x[check])
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    losses = [_loss(logit / c, label[check], weight[check]) for c in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def train(
    documents: DataFrame, key: str, text: str, labels: DataFrame, label: str, usable: Column | None = None,
    per_class: int = SAMPLE_PER_CLASS,
) -> QualityModel:
    """Word vectors from all texts, network from at most ``per_class`` labelled rows of each class.

    ``usable`` restricts the label rows. Sampled rows are weighted back to the
    class counts of all usable labels, so probabilities keep the prior.
    """
    vectors = word_vectors(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)
    sample = labelled_sample(documents, key, text, labels, label, per_class, usable)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            for i, j in slices(data, offsets):
                part = _pool(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                        pa.array(list(part), pa.list_(pa.float64())),
                    ],
                    ["key", "label", "x"],
                )

    kind = sample.schema["key"].dataType.simpleString()
    rows = sample.mapInArrow(pooled, f"key {kind}, label int, x array<double>").toPandas()
    rows = rows.sort_values("key", kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, SIZE))
    y = rows["label"].to_numpy(float)
    known = labels.where(usable) if usable is not None else labels
    totals = dict(known.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    weight = np.array([totals.get(int(c), 0) / max(1, np.sum(y == c)) for c in y])
    return QualityModel(vectors, fit_network(x, y, weight))


def quality(documents: DataFrame, key: str, text: str, model: QualityModel) -> DataFrame:
    """``key, score`` of every row: probability of label 1, from the whole text alone.

    Null and empty texts have a zero vector and the score that goes with it.
    Other columns and repeated keys don't matter.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for i, j in slices(data, offsets):
                x = _pool(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value.vectors)
                score = shared.value.network.probability(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], ["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
