"""Bounded samples of labelled documents, the only rows a model is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    documents: DataFrame, key: str, text: str, labels: DataFrame, label: str, per_class: int,
    usable: Column | None = None,
) -> DataFrame:
    """``key, label, text`` of at most ``per_class`` labelled rows of each class 0 and 1.

    The rows with the smallest hash of their key are taken, so the sample is the
    same in every run. Rows with a null key or label are left out; of several
    labels of a key the largest counts, of several texts the smallest.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * per_class rows
    texts = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, F.col("k") == F.col("key")).groupBy("key", "label").agg(F.min("text").alias("text"))
