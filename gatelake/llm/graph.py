"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.session import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node of its component, for nodes that aren't the smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        big, small = forest(batch["big"].to_numpy(), batch["small"].to_numpy())
        yield pd.DataFrame({"big": big, "small": small})


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges (longs in the first two columns).

    ``component`` is the smallest node that can be reached. Edges are first
    contracted batch by batch, then alternating star steps join the trees; each
    step writes its edges to the shared folder, so a lost executor costs one
    step. Edges with a null end are ignored, loops yield no row, no edges no rows.
    """
    a, b = edges.columns[:2]
    start = (
        edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .mapInPandas(_contract, "big long, small long")
    )
    now = cut_lineage(start, "components")
    seen = None
    while True:
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).union(
            now.select(F.col("small").alias("u"), F.col("big").alias("v"))
        )
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(lowest, now["small"] == lowest["u"]).select("big", F.col("m").alias("small")).distinct()
        low = large.groupBy("big").agg(F.min("small").alias("m"))
        small = (
            large.join(low, "big")
            .where(F.col("small") != F.col("m"))
            .select(F.col("small").alias("big"), F.col("m").alias("small"))
            .union(low.select("big", F.col("m").alias("small")))
            .distinct()
        )
        now = cut_lineage(small, "components")
        state = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).union(
        now.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    )
