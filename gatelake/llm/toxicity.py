"""Severity of toxic text by cumulative-link ordinal regression on sparse features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.decontaminate import _OUTSIDE
from gatelake.llm.labelled import labelled_sample
from gatelake.llm.words import buffer_of, mix, slices, span_hashes, word_spans

#: Features are hashed to this many weights (1 MB); it doesn't depend on the data.
FEATURES = 1 << 18
#: Bytes of a word's start that are a feature besides the word.
PREFIX = 5
#: Severity grades above 0 ("not toxic").
GRADES = 3
#: Labelled rows of each class that a fit uses at most.
SAMPLE_PER_CLASS = 4000
#: A feature is used if its documents show a class difference of this log-likelihood ratio.
EVIDENCE = 15.0
#: Probability of any toxicity from which a document is rejected.
REJECT = 0.5


@dataclass
class Severity:
    """Weights shared by all thresholds, and the thresholds in rising order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """Probability of at least grade 1, 2, ... for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every word and of every longer word's start, for texts in lower case."""
    starts, ends, of = word_spans(data, offsets, _OUTSIDE)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    long = ends - starts > PREFIX
    words = span_hashes(data, starts, ends)
    begins = mix(span_hashes(data, starts[long], starts[long] + PREFIX) + np.uint64(1))
    both = np.concatenate([words, begins]) & np.uint64(FEATURES - 1)
    return np.concatenate([text, text[long]]), both.astype(np.int64)


def _counted(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, count = np.unique(text * FEATURES + feature, return_counts=True)
    return pair // FEATURES, pair % FEATURES, np.log2(1 + count)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column(2))
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            _, feature, value = _counted(*_features(own, np.array([0, len(own)])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1),
                    pa.array([feature.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([value.astype(np.float32).tobytes()], pa.binary()),
                ],
                ["key", "label", "features", "values"],
            )


def _informative(row, feature, toxic, n) -> tuple[np.ndarray, np.ndarray]:
    """Features with enough evidence, and their log odds of toxicity."""
    rows = np.array([np.sum(~toxic), np.sum(toxic)], float)
    seen = np.stack([np.bincount(feature[toxic[row] == c], minlength=FEATURES) for c in (False, True)]).astype(float)
    share = seen.sum(0) / n

    def log_likelihood(k, m, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (m - k) * np.log(1 - p)

    gain = sum(
        log_likelihood(seen[c], rows[c], seen[c] / rows[c]) - log_likelihood(seen[c], rows[c], share) for c in (0, 1)
    )
    odds = np.log((seen[1] + 0.5) / (rows[1] - seen[1] + 0.5)) - np.log((seen[0] + 0.5) / (rows[0] - seen[0] + 0.5))
    return np.flatnonzero(2 * gain >= EVIDENCE), odds


def fit_ordinal(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, columns: int, grades: int,
    balance: np.ndarray, ridge: float = 1e-4, rounds: int = 300, step: float = 0.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the likelihood of the grades.

    ``P(grade >= k) = 1 / (1 + exp(threshold_k - score))`` with one score for all
    ``k``. Thresholds are a first one plus positive gaps, so they stay in order.
    ``balance`` weighs the rows. Adam on the whole sample, which is sparse
    (``row, column, value``); zero start, so the fit has no random part.
    """
    n = len(grade)
    theta = np.concatenate([np.zeros(columns), [1.0], np.zeros(grades - 1)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    lower, upper = grade >= 1, grade < grades
    for t in range(1, rounds + 1):
        cuts = theta[columns] + np.concatenate([[0.0], np.cumsum(np.exp(theta[columns + 1 :]))])
        score = np.bincount(row, weights=value * theta[column], minlength=n)
        at_least = np.where(lower, 1 / (1 + np.exp(-(score - cuts[np.maximum(grade - 1, 0)]))), 1.0)
        beyond = np.where(upper, 1 / (1 + np.exp(-(score - cuts[np.minimum(grade, grades - 1)]))), 0.0)
        mass = np.maximum(at_least - beyond, 1e-12)
        d_low = balance * at_least * (1 - at_least) / mass
        d_up = -balance * beyond * (1 - beyond) / mass
        d_score = d_low + d_up
        slope = np.zeros_like(theta)
        slope[:columns] = np.bincount(column, weights=value * d_score[row], minlength=columns) - ridge * theta[:columns]
        d_cut = -np.bincount(np.maximum(grade - 1, 0)[lower], weights=d_low[lower], minlength=grades)
        d_cut -= np.bincount(grade[upper], weights=d_up[upper], minlength=grades)
        slope[columns] = d_cut.sum()
        tail = np.cumsum(d_cut[::-1])[::-1]
        slope[columns + 1 :] = tail[1:] * np.exp(theta[columns + 1 :])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta += step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    cuts = theta[columns] + np.concatenate([[0.0], np.cumsum(np.exp(theta[columns + 1 :]))])
    return theta[:columns], cuts


def train(
    documents: DataFrame, key: str, text: str, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS
) -> Severity:
    """Fit on at most ``per_class`` labelled documents of each class.

    The labels only say toxic or not. Toxic rows get grade 1 to ``GRADES`` by
    equal shares of their weight of toxic features (log odds times log count);
    clean rows get 0. Without rows of both classes nothing can be learned: every
    document then has severity 0.
    """
    sample = labelled_sample(documents, key, text, labels, label, per_class)
    kind = sample.schema["key"].dataType.simpleString()
    sample = sample.withColumn("text", F.lower("text"))
    rows = sample.mapInArrow(_sample_rows, f"key {kind}, label int, features binary, values binary").toPandas()
    rows = rows.sort_values("key", kind="stable")
    toxic = rows["label"].to_numpy() == 1
    nothing = Severity(np.zeros(FEATURES, np.float32), np.full(GRADES, 1000.0))
    if not toxic.any() or toxic.all():
        return nothing
    features = [np.frombuffer(x, np.int32) for x in rows["features"]]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in features])
    feature = np.concatenate(features).astype(np.int64)
    value = np.concatenate([np.frombuffer(x, np.float32) for x in rows["values"]]).astype(float)
    chosen, odds = _informative(row, feature, toxic, len(rows))
    if not len(chosen):
        return nothing
    column_of = np.full(FEATURES, -1)
    column_of[chosen] = np.arange(len(chosen))
    used = column_of[feature] >= 0
    row, feature, value = row[used], feature[used], value[used]
    weight = np.bincount(row, weights=value * np.maximum(odds[feature], 0), minlength=len(rows))
    cuts = np.quantile(weight[toxic], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, weight, side="right"), 0)
    balance = np.ones(len(rows)) / len(rows)
    weights, thresholds = fit_ordinal(row, column_of[feature], value, grade, len(chosen), GRADES, balance)
    dense = np.zeros(FEATURES, np.float32)
    dense[chosen] = weights
    return Severity(dense, thresholds)


def _score_rows(batches: Iterator[pa.RecordBatch], model: Severity) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        for i, j in slices(data, offsets):
            text, feature = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            used = model.weights[feature] != 0
            text, feature, value = _counted(text[used], feature[used])
            score = np.bincount(text, weights=value * model.weights[feature], minlength=j - i)
            above = model.above(score)
            columns = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array((above > 0.5).sum(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *columns], ["key", "severity", "toxic_probability", "grade"]
            )


def severity(documents: DataFrame, key: str, text: str, model: Severity) -> DataFrame:
    """``key, severity, toxic_probability, grade`` of each row, from its whole text.

    ``severity`` is the expected grade, 0 to ``GRADES``: the sum of the
    probabilities of reaching each grade. ``grade`` counts those above one half.
    Null and empty texts score like a text without features. Rows are scored on
    their own; other columns and repeated keys don't matter.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias("key"), F.lower(F.col(text).cast("string")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(
        lambda batches: _score_rows(batches, shared.value),
        f"key {kind}, severity double, toxic_probability double, grade int",
    )
    return scored.withColumnRenamed("key", key)


def drop_toxic(documents: DataFrame, text: str, model: Severity, reject: float = REJECT) -> DataFrame:
    """Documents whose probability of any toxicity is below ``reject``, with all their columns.

    Rejected texts are matched by two hashes of the text, from which the decision
    follows; only these small rows meet the documents.
    """
    both = F.struct(F.xxhash64(text), F.hash(text))
    name = "_text_hash"
    while name in documents.columns:
        name += "_"
    marked = documents.withColumn(name, F.when(F.col(text).isNotNull(), both))
    bad = severity(marked, name, text, model).where(F.col("toxic_probability") >= reject)
    return marked.join(bad.select(F.col(name).alias("bad")).distinct(), F.col(name) == F.col("bad"), "left_anti").drop(name)
