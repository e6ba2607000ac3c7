"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.llm.graph import components, forest
from gatelake.session import cut_lineage

#: Leading principal dimensions of the grid.
GRID = 8
#: Vectors of one block of the order; two blocks are joined by one task.
BLOCK = 4096
#: Rows of the intervals that are compared or skipped inside a pair of blocks.
LEAF = 128
#: Blocks of one partition of the order have this many bits of a block's number.
BLOCK_BITS = 10
#: Children of an interval of the order are told apart by this many bits.
FANOUT_BITS = 4
#: Rounding of distances must not skip a pair.
SLACK = 1e-9


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are filled with zeros."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # no square can overflow or vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((size, size))
    for batch in batches:
        vectors = _matrix(batch.column(0), size)
        total += vectors.T @ vectors
    place = pa.array(np.arange(size * size, dtype=np.int32))
    yield pa.RecordBatch.from_arrays([place, pa.array(total.ravel())], ["at", "value"])


def _principal(vectors: DataFrame, size: int) -> np.ndarray:
    """The leading eigenvectors of the second moments, ``size`` by ``GRID`` at most."""
    rows = (
        vectors.mapInArrow(lambda b: _moments(b, size), "at int, value double")
        .groupBy("at")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )  # size * size numbers, whatever the number of vectors
    moments = np.zeros(size * size)
    moments[rows["at"]] = rows["value"]
    _, basis = np.linalg.eigh(moments.reshape(size, size))
    return np.ascontiguousarray(basis[:, ::-1][:, :GRID])


def _with_cells(batches: Iterator[pa.RecordBatch], basis: np.ndarray, eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit = _matrix(batch.column(2), len(basis))
        cells = np.floor(unit @ basis / eps).astype(np.int32)
        parts = [batch.column(0), batch.column(1), pa.array(list(cells), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*parts, pa.array([v.tobytes() for v in unit], pa.binary())],
                                         ["no", "same", "cells", "unit"])


def _blocks(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive vectors with the box of their leading coordinates."""
    from pyspark import TaskContext

    partition, number = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block(no, same, unit):
        lead = unit @ basis
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(partition << BLOCK_BITS) + number]), pa.array([lead.min(0)], pa.list_(pa.float64())),
                pa.array([lead.max(0)], pa.list_(pa.float64())), pa.array([no.tobytes()], pa.binary()),
                pa.array([same.tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary()),
            ],
            ["block", "low", "high", "no", "same", "unit"],
        )

    for batch in batches:
        unit = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, len(basis))
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), unit))
        while sum(len(h[0]) for h in held) >= BLOCK:
            no, same, unit = (np.concatenate(x) for x in zip(*held, strict=True))
            yield block(no[:BLOCK], same[:BLOCK], unit[:BLOCK])
            number += 1
            held = [(no[BLOCK:], same[BLOCK:], unit[BLOCK:])]
    if sum(len(h[0]) for h in held):
        yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Squared distance of each box of ``a`` to each box of ``b``."""
    gap = np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None])
    return (np.maximum(gap, 0) ** 2).sum(-1)


def _join_blocks(a: dict, b: dict | None, basis: np.ndarray, least: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Link counts and a spanning forest of the links of two blocks, or of one with itself."""
    other = b or a
    bound = 2 - 2 * least + SLACK
    boxes = []
    for side in (a, other):
        lead = side["unit"] @ basis
        first = np.arange(0, len(lead), LEAF)
        boxes.append((np.minimum.reduceat(lead, first), np.maximum.reduceat(lead, first)))
    close = _apart(*boxes[0], *boxes[1]) <= bound
    count_a, count_b = np.zeros(len(a["no"]), np.int64), np.zeros(len(other["no"]), np.int64)
    big = small = np.zeros(0, np.int64)
    for leaf in range(len(close)):
        rows = slice(leaf * LEAF, (leaf + 1) * LEAF)
        columns = np.flatnonzero(np.repeat(close[leaf], LEAF)[: len(other["no"])])
        if not len(columns):
            continue
        linked = a["unit"][rows] @ other["unit"][columns].T >= least
        if b is None:
            linked &= np.arange(len(a["no"]))[rows, None] != columns[None]
        count_a[rows] += linked @ other["same"][columns]
        count_b[columns] += a["same"][rows] @ linked
        i, j = np.nonzero(linked)
        if len(i):
            big, small = forest(
                np.concatenate([big, a["no"][rows][i]]), np.concatenate([small, other["no"][columns][j]])
            )
    counts = [(a["no"], count_a)] if b is None else [(a["no"], count_a), (other["no"], count_b)]
    no, links = (np.concatenate(x) for x in zip(*counts, strict=True))
    return pd.DataFrame({"a": no[links > 0], "b": links[links > 0]}), pd.DataFrame({"a": big, "b": small})


def _joined(batches: Iterator[pa.RecordBatch], basis: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            sides = []
            for first in (2, 5):
                no, same, unit = (batch.column(first + k)[row].as_buffer() for k in range(3))
                sides.append({
                    "no": np.frombuffer(no, np.int64), "same": np.frombuffer(same, np.int64),
                    "unit": np.frombuffer(unit).reshape(-1, len(basis)),
                })
            alone = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
            counts, edges = _join_blocks(sides[0], None if alone else sides[1], basis, least)
            for is_edge, found in ((False, counts), (True, edges)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), is_edge)), pa.array(found["a"]), pa.array(found["b"])],
                    ["edge", "a", "b"],
                )


def _close_pairs(blocks: DataFrame, bound: float, grid: int) -> DataFrame:
    """Pairs ``a <= b`` of blocks whose boxes are no further apart than the bound.

    Starts with the whole order and descends to shorter intervals of it; a pair
    of intervals is dropped as soon as its boxes are too far apart.
    """
    flat = blocks.select(
        "block", *[F.col("low")[k].alias(f"low{k}") for k in range(grid)],
        *[F.col("high")[k].alias(f"high{k}") for k in range(grid)],
    )
    flat = cut_lineage(flat, "vectors")
    top = flat.agg(F.max("block")).first()[0] or 0
    shifts = [0, BLOCK_BITS]
    while top >> shifts[-1]:
        shifts.append(shifts[-1] + FANOUT_BITS)
    pairs = flat.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for above, shift in zip(reversed(shifts[1:]), reversed(shifts[:-1]), strict=True):
        nodes = flat.groupBy(F.shiftright("block", shift).alias("node")).agg(
            *[F.min(f"low{k}").alias(f"low{k}") for k in range(grid)],
            *[F.max(f"high{k}").alias(f"high{k}") for k in range(grid)],
        )
        left, right = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns]) for side in "ab")
        gaps = [
            F.greatest(
                F.lit(0.0), F.col(f"a_low{k}") - F.col(f"b_high{k}"), F.col(f"b_low{k}") - F.col(f"a_high{k}")
            )
            for k in range(grid)
        ]
        far = sum((g * g for g in gaps), F.lit(0.0))
        step = above - shift
        pairs = (
            pairs.join(left, F.shiftright("a_node", step) == F.col("a"))
            .join(right, F.shiftright("b_node", step) == F.col("b"))
            .where((F.col("a_node") <= F.col("b_node")) & (far <= bound))
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        )
        pairs = cut_lineage(pairs, "vectors")
    return pairs


def link_vectors(rows: DataFrame, key: str, vector: str, least: float = 0.95) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row: cosine links of at least ``least``.

    Equal vectors become one with a count. Unit vectors are turned to their
    principal axes, put in epsilon grid order of the leading ones (``eps`` is the
    distance that belongs to ``least``) and cut into blocks. Intervals of the
    order are joined recursively and skipped when their boxes are further apart
    than ``eps``; the remaining pairs are compared exactly in double precision.
    A pair of blocks answers with link counts and a spanning forest, so no group
    is written out as pairs.

    ``n_links`` counts other rows, ``component_id`` is the smallest key reachable,
    itself included, ``kept`` tells whether the row has it. Vectors that are null,
    zero, or hold a null or non-finite number link with nothing. A shorter vector
    counts as filled with zeros. Null keys take part in links but name no group.
    """
    eps = math.sqrt(2 - 2 * least)
    own = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    good = own.where(_usable(F.col("vector")))
    distinct = cut_lineage(
        good.groupBy("vector")
        .agg(F.count("*").alias("same"), F.min("key").alias("lowest"))
        .select(F.monotonically_increasing_id().alias("no"), "same", "vector", "lowest"),
        "vectors",
    )
    shape = distinct.agg(F.count("*"), F.max(F.size("vector"))).first()
    bad = own.where(~_usable(F.col("vector"))).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    if not shape[0]:
        found = bad
    else:
        size = shape[1]
        basis = _principal(distinct.select("vector"), size)
        grid = basis.shape[1]
        celled = distinct.select("no", "same", "vector").mapInArrow(
            lambda b: _with_cells(b, basis, eps), "no long, same long, cells array<int>, unit binary"
        )
        ordered = celled.repartitionByRange(max(1, math.ceil(shape[0] / (2 * BLOCK))), "cells", "no")
        blocks = cut_lineage(
            ordered.sortWithinPartitions("cells", "no")
            .select("no", "same", "unit")
            .mapInArrow(
                lambda b: _blocks(b, basis),
                "block long, low array<double>, high array<double>, no binary, same binary, unit binary",
            ),
            "vectors",
        )
        pairs = _close_pairs(blocks, eps * eps + SLACK, grid)
        side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("block", "no", "same", "unit")])
        columns = ["a", "b", *[f"{s}_{c}" for s in "ab" for c in ("no", "same", "unit")]]
        tiles = pairs.join(side("b"), F.col("b") == F.col("b_block")).join(side("a"), F.col("a") == F.col("a_block"))
        links = cut_lineage(
            tiles.select(*columns).mapInArrow(lambda b: _joined(b, basis, least), "edge boolean, a long, b long"),
            "vectors",
        )
        counts = links.where("not edge").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("links"))
        label = components(links.where("edge").select("a", "b"))
        named = (
            distinct.join(counts, F.col("no") == F.col("c"), "left")
            .join(label, F.col("no") == F.col("node"), "left")
            .select(
                "vector", "lowest", F.coalesce("component", "no").alias("label"),
                (F.coalesce("links", F.lit(0)) + F.col("same") - 1).alias("n_links"),
            )
        )
        lowest = named.groupBy(F.col("label").alias("l")).agg(F.min("lowest").alias("component_id"))
        named = named.join(lowest, F.col("label") == F.col("l")).select(
            F.col("vector").alias("v"), "n_links", "component_id"
        )
        found = good.join(named, F.col("vector") == F.col("v")).select("key", "n_links", "component_id").union(bad)
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.select(F.col("key").alias(key), "n_links", "component_id", kept)
