"""Hard negatives of anchors by exact inner products over blocks with zone maps.

Candidates are sorted along a Hilbert curve over their leading dimensions and
packed into Parquet rows, each a block of neighbours with the smallest and the
largest value of every dimension. Interval arithmetic over these bounds tells
which blocks can hold an answer to an anchor's window; only those are sent to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.session import cut_lineage

#: Rows of a block, blocks of a part, queries of a tile. A part is what one task reads at most for one tile.
BLOCK_ROWS = 1024
PART_BLOCKS = 64
TILE = 512
#: Dimensions of largest variance that the curve runs through, and bits of each.
CURVE_DIMENSIONS = 8
CURVE_BITS = 7
#: Components are held as 64-bit integers.
_MOST = 1 << 62
_LEAST_LONG, _MOST_LONG = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BLOCK_SHIFT, _PART_SHIFT = 10, 16


class Shape(NamedTuple):
    """What all vectors have in common."""

    width: int
    largest: int  # of all components, without sign
    lead: list[int]
    low: list[float]
    high: list[float]

    @property
    def kind(self) -> str:
        return "<i2" if self.largest < 1 << 15 else "<i4" if self.largest < 1 << 31 else "<i8"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell on the Hilbert curve; ``cells`` has a row of whole numbers below ``2**bits`` each."""
    axes = [c.astype(np.int64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            flip = (axes[i] & q) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & p)
            axes[0] = axes[0] ^ np.where(flip, p, swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level & 1)
    return key


def _whole(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """``floor(scale * x)`` of each component as a row of ``width`` integers, zero behind a shorter vector."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()
    length = np.diff(offsets)
    out = np.zeros((len(length), width), np.int64)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(scale * values), -float(_MOST), float(_MOST))
    at = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], length)
    out[np.repeat(np.arange(len(length)), length), at] = scaled.astype(np.int64)
    return out


def _moments(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.diff(batch.column(0).cast(pa.large_list(pa.float64())).offsets.to_numpy())
        whole = _whole(batch.column(0), scale, int(lengths.max(initial=0)))
        real = whole.astype(float)
        for d in range(whole.shape[1]):
            own = real[:, d]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (d, int(whole[:, d].min()), int(whole[:, d].max()), own.sum(), own @ own)],
                ["d", "low", "high", "total", "square"],
            )


def _shape(vectors: DataFrame, scale: float) -> Shape | None:
    """None for an empty table. One row for each dimension reaches the driver."""
    n = vectors.count()
    parts = vectors.mapInArrow(lambda b: _moments(b, scale), "d long, low long, high long, total double, square double")
    rows = parts.groupBy("d").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("square").alias("square")
    ).collect()
    if not n:
        return None
    rows.sort(key=lambda r: r.square / n - (r.total / n) ** 2, reverse=True)
    lead = rows[:CURVE_DIMENSIONS]
    return Shape(
        max((r.d for r in rows), default=-1) + 1, max((max(abs(r.low), abs(r.high)) for r in rows), default=0),
        [r.d for r in lead], [min(r.low, 0) for r in lead], [max(r.high, 0) for r in lead],
    )


def _coded(batches: Iterator[pa.RecordBatch], shape: Shape, scale: float) -> Iterator[pa.RecordBatch]:
    """``key, label, anchor, curve, vector`` of ``key, label, anchor, vector``."""
    low, high = np.array(shape.low, float), np.array(shape.high, float)
    for batch in batches:
        whole = _whole(batch.column(3), scale, shape.width)
        cells = (whole[:, shape.lead] - low) / np.maximum(high - low, 1) * ((1 << CURVE_BITS) - 1)
        curve = hilbert_keys(cells.astype(np.int64), CURVE_BITS) if shape.lead else np.zeros(len(whole), np.int64)
        raw = np.ascontiguousarray(whole.astype(shape.kind))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(curve), pa.array([r.tobytes() for r in raw], pa.binary())],
            ["key", "label", "anchor", "curve", "vector"],
        )


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of a given length, the last one shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            at = 0
            while table.num_rows - at >= rows:
                yield table.slice(at, rows)
                at += rows
            held = table.slice(at).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype("<i8")


def _matrix(raw: list[bytes], shape: Shape) -> np.ndarray:
    return np.frombuffer(b"".join(raw), shape.kind).reshape(len(raw), shape.width)


def _blocks(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for nth, table in enumerate(_gathered(batches, BLOCK_ROWS)):
        block = part << _PART_SHIFT | nth
        matrix = _matrix(table.column("vector").to_pylist(), shape)
        label = _longs(table, "label")
        kinds, counts = np.unique(label, return_counts=True)
        no = (block << _BLOCK_SHIFT) + np.arange(len(label), dtype="<i8")
        columns = [no, _longs(table, "key"), label, matrix, matrix.min(0).astype("<i8"), matrix.max(0).astype("<i8"),
                   kinds, counts.astype("<i8")]
        anchors = pa.array([table.column("anchor").combine_chunks()], pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([block], pa.int64()),
             *[pa.array([c.tobytes()], pa.binary()) for c in columns], anchors],
            ["part", "block", *_BLOCK_COLUMNS, "anchors"],
        )


_BLOCK_COLUMNS = ["nos", "keys", "labels", "vectors", "lows", "highs", "kinds", "counts"]
_ZONE = ["part", "block", "lows", "highs", "kinds", "counts"]


def _anchor_rows(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at_row in range(batch.num_rows):
            row = batch.slice(at_row, 1).to_pylist()[0]
            at = np.flatnonzero(row["anchors"])
            nos, keys, labels = (np.frombuffer(row[c], "<i8")[at] for c in ("nos", "keys", "labels"))
            matrix = np.frombuffer(row["vectors"], shape.kind).reshape(-1, shape.width)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), row["block"])), pa.array(nos), pa.array(keys), pa.array(labels),
                 pa.array([r.tobytes() for r in np.ascontiguousarray(matrix)], pa.binary())],
                ["block", "no", "key", "label", "vector"],
            )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for nth, table in enumerate(_gathered(batches, TILE)):
        raw = [_longs(table, c).tobytes() for c in ("q", "no", "label")]
        windows = np.stack([_longs(table, c) for c in ("lo", "hi", "floor")])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | nth], pa.int64()), *[pa.array([r], pa.binary()) for r in raw],
             pa.array([b"".join(table.column("vector").to_pylist())], pa.binary()),
             pa.array([windows.tobytes()], pa.binary()),
             pa.array([np.unique(_longs(table, "block"))], pa.list_(pa.int64()))],
            ["tile", "nos", "keys", "labels", "vectors", "windows", "homes"],
        )


_TILE_SCHEMA = (
    "tile long, nos binary, keys binary, labels binary, vectors binary, windows binary, homes array<long>"
)


def scores(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """Exact inner products of all rows, held at the limits of 64 bits."""
    most = largest * largest * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most <= _MOST_LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = a.astype(object) @ b.astype(object).T
    return np.minimum(np.maximum(wide, _LEAST_LONG + 1), _MOST_LONG).astype(np.int64)


class Tile(NamedTuple):
    """Queries of one tile: anchors' rows, windows and what they ask for."""

    q: np.ndarray
    anchor: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, row: dict, shape: Shape) -> Tile:
        q, anchor, label = (np.frombuffer(row[c], "<i8") for c in ("nos", "keys", "labels"))
        windows = np.frombuffer(row["windows"], "<i8").reshape(3, -1)
        vectors = np.frombuffer(row["vectors"], shape.kind).reshape(-1, shape.width)
        return cls(q, anchor, label, vectors, *windows)


def _wanted(batches: Iterator[pa.RecordBatch], shape: Shape, same: bool) -> Iterator[pa.RecordBatch]:
    """``tile, part, block`` where the block may hold an answer to one of the tile's queries."""
    for batch in batches:
        tiles, parts, blocks = [], [], []
        for at_row in range(batch.num_rows):
            row = batch.slice(at_row, 1).to_pylist()[0]
            tile = Tile.of(row, shape)
            up = np.maximum(tile.vectors, 0).astype(float)
            down = np.minimum(tile.vectors, 0).astype(float)
            low, high = (
                np.stack([np.frombuffer(z[c], "<i8") for z in row["zones"]]).astype(float) for c in ("lows", "highs")
            )
            least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
            if shape.largest**2 * max(shape.width, 1) >= 1 << 53:  # room for rounding
                slack = 1e-9 * ((up - down) @ np.maximum(abs(low), abs(high)).T)
                least, most = least - slack, most + slack
            may = (most >= np.maximum(tile.low, tile.floor)[:, None]) & (least <= tile.high[:, None])
            for k, zone in enumerate(row["zones"]):
                kinds, counts = (np.frombuffer(zone[c], "<i8") for c in ("kinds", "counts"))
                at = np.minimum(np.searchsorted(kinds, tile.label), len(kinds) - 1)
                own = np.where(kinds[at] == tile.label, counts[at], 0)
                if (may[:, k] & (own > 0 if same else counts.sum() > own)).any():
                    tiles.append(row["tile"])
                    parts.append(row["part"])
                    blocks.append(zone["block"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (tiles, parts, blocks)], ["tile", "part", "block"]
        )


def _first(q: np.ndarray, key: np.ndarray, score: np.ndarray, want: int) -> tuple[np.ndarray, ...]:
    """The first ``want`` of each query by score, then key."""
    order = np.lexsort((key, -score, q))
    q, key, score = q[order], key[order], score[order]
    begins = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(begins, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < want
    return q[keep], key[keep], score[keep]


def _answers(tile: Tile, row: dict, shape: Shape, same: bool, want: int) -> tuple[np.ndarray, ...]:
    """Place of the query in the tile, key and score of a block's best rows."""
    no, key, label = (np.frombuffer(row[c], "<i8") for c in ("nos", "keys", "labels"))
    matrix = np.frombuffer(row["vectors"], shape.kind).reshape(-1, shape.width)
    _, one, again = np.unique(tile.anchor, return_index=True, return_inverse=True)
    score = scores(tile.vectors[one], matrix, shape.largest)[again]
    fits = ((tile.label[:, None] == label) == same) & (tile.anchor[:, None] != no)
    fits &= (score >= np.maximum(tile.low, tile.floor)[:, None]) & (score <= tile.high[:, None])
    score = np.where(fits, score, _LEAST_LONG)
    if want < score.shape[1]:
        fits &= score >= np.partition(score, -want, axis=1)[:, -want, None]
    q, at = np.nonzero(fits)
    return _first(q, key[at], score[q, at], want)


def _searched(batches: Iterator[pa.RecordBatch], shape: Shape, same: bool, want: int) -> Iterator[pa.RecordBatch]:
    """Rows come by tile and part, the tile itself before its blocks; one tile and one block are held at a time."""
    tile, found = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(tile.q[found[0]]), pa.array(found[1]), pa.array(found[2])], ["q", "key", "score"]
        )

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["kind"] == 0:
                if tile is not None:
                    yield done()
                tile, found = Tile.of(row, shape), tuple(np.zeros(0, np.int64) for _ in range(3))
            else:
                more = _answers(tile, row, shape, same, want)
                found = _first(*(np.concatenate(x) for x in zip(found, more, strict=True)), want)
    if tile is not None:
        yield done()


def _evaluate(tiles: DataFrame, reads: DataFrame, blocks: DataFrame, shape: Shape, same: bool, want: int) -> DataFrame:
    """``q, key, score``: the best rows of each query in each part that it reads."""
    columns = ["nos", "keys", "labels", "vectors"]
    asked = reads.select("tile", "part").distinct().join(tiles, "tile").select("tile", "part", F.lit(0).alias("kind"), *columns, "windows")
    given = reads.join(blocks, ["part", "block"]).select("tile", "part", F.lit(1).alias("kind"), *columns, F.lit(None).cast("binary").alias("windows"))
    rows = asked.union(given).repartition("tile", "part").sortWithinPartitions("tile", "part", "kind")
    return rows.mapInArrow(lambda b: _searched(b, shape, same, want), "q long, key long, score long")


def _search(queries: DataFrame, blocks: DataFrame, parts: int, shape: Shape, same: bool, want: int) -> DataFrame:
    """``q, key, score, rank``: the first ``want`` rows of each query.

    A query's own block answers first; its last answer there is a floor for what
    other blocks must reach. Zone maps then choose the blocks that are read.
    """
    def tiled(rows: DataFrame) -> DataFrame:
        n = max(1, math.ceil(rows.count() / (TILE * 8)))
        ordered = rows.repartitionByRange(n, "no", "q").sortWithinPartitions("no", "q")
        return cut_lineage(ordered.mapInArrow(_tiles, _TILE_SCHEMA), "negatives")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    home = tiled(queries.withColumn("floor", F.lit(_LEAST_LONG + 1)))
    own = home.select("tile", F.explode("homes").alias("block")).select("tile", F.shiftright("block", _PART_SHIFT).alias("part"), "block")
    near = _evaluate(home, own, blocks, shape, same, want)
    floors = (
        near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == want).select("q", F.col("score").alias("floor"))
    )
    raised = queries.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(_LEAST_LONG + 1)))
    tiles = tiled(raised)
    zones = blocks.select(*_ZONE).groupBy("part").agg(F.collect_list(F.struct(*_ZONE[1:])).alias("zones"))  # at most 64 a part
    asked = tiles.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    reads = cut_lineage(
        asked.join(zones, "part").mapInArrow(lambda b: _wanted(b, shape, same), "tile long, part long, block long"), "negatives"
    )
    found = _evaluate(tiles, reads, blocks, shape, same, want)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= want)


def mine_negatives(
    rows: DataFrame, key: str, vector: str, label: str, anchor: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor.

    Each component becomes ``floor(scale * x)``; a score is the integer inner
    product with the anchor, higher scores come first, ties by smaller key. An
    anchor's positives are its first other rows of the same label, at most
    ``positives``. A positive's negatives are the first rows of another label whose
    score lies from ``low`` to ``high`` per cent of the positive's score, at most
    ``negatives``. Every row is a candidate; nothing is approximate.

    Rows with a null key, label or vector, or with a null or non-finite component
    take no part. ``anchor`` tells the anchors; null counts as no. Shorter vectors
    count as filled with zeros, components are held within 2**62 and scores
    within 64 bits. Rows that repeat a key count each on their own, also as anchors.
    An empty table, and anchors without positives, give no rows; other columns
    are not read.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    used = rows.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("vector"), bad.alias("bad"),
    ).where("key is not null and label is not null and vector is not null and not bad").drop("bad")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    shape = _shape(used.select("vector"), scale)
    if shape is None:
        return rows.sparkSession.createDataFrame([], schema)
    coded = used.mapInArrow(
        lambda b: _coded(b, shape, scale), "key long, label long, anchor boolean, curve long, vector binary"
    )
    parts = max(1, math.ceil(used.count() / (BLOCK_ROWS * PART_BLOCKS)))
    ordered = coded.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key")
    binaries = ", ".join(f"{c} binary" for c in _BLOCK_COLUMNS)
    blocks = cut_lineage(
        ordered.mapInArrow(lambda b: _blocks(b, shape), f"part long, block long, {binaries}, anchors array<boolean>"),
        "negatives",
    )
    parts = blocks.agg(F.max("part")).first()[0] + 1
    anchors = cut_lineage(
        blocks.mapInArrow(lambda b: _anchor_rows(b, shape), "block long, no long, key long, label long, vector binary"),
        "negatives",
    )
    everything = [F.lit(_LEAST_LONG + 1).alias("lo"), F.lit(_MOST_LONG).alias("hi")]
    first = anchors.select(F.col("no").alias("q"), "block", "no", "label", "vector", *everything)
    near = _search(first, blocks, parts, shape, True, positives)
    exact = F.col("score").cast("decimal(20,0)")
    window = [
        F.ceil(exact * F.lit(low) / F.lit(100)).cast("long").alias("lo"),
        F.floor(exact * F.lit(high) / F.lit(100)).cast("long").alias("hi"),
    ]
    pairs = cut_lineage(
        near.select(
            (F.col("q") * positives + F.col("rank") - 1).alias("pair"), F.col("q").alias("no"),
            F.col("key").alias("positive_id"), F.col("score").alias("positive_score"), *window,
        ),
        "negatives",
    )
    second = pairs.where("lo <= hi").join(anchors, "no").select(
        F.col("pair").alias("q"), "block", "no", "label", "vector", "lo", "hi"
    )
    far = _search(second, blocks, parts, shape, False, negatives)
    named = pairs.join(anchors.select("no", F.col("key").alias("anchor_id")), "no")
    return far.join(named, F.col("q") == F.col("pair")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
