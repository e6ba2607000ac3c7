"""Weighted rendezvous sharding of records by a stable key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that make the uniform number of a (key, shard) pair.
DIGITS = 13
#: Rows that one task numbers at most, on average.
ROWS_PER_RANGE = 50_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, with the lowest ``-ln(u) / weight`` for this key.

    ``u`` is a uniform number from the MD5 of key and shard, so a key's choice
    depends on nothing but the key and the weights: a new last shard takes rows
    only into itself, and a shard's share is in proportion to its weight.
    A null key is hashed as an empty text. Weights must be above zero. Equal
    scores, which need equal hash prefixes, go to the lower shard.
    """
    if not weights or not all(w > 0 and math.isfinite(w) for w in weights):
        raise ValueError("every shard needs a finite weight above zero")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(text, F.lit(":"), shard.cast("string"))), 1, DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
        weight = F.lit(1.0) if len(set(weights)) == 1 else F.element_at(F.array(*map(F.lit, weights)), shard + 1)
        return F.struct((-F.log(u) / weight).alias("score"), shard.alias("shard"))

    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return F.array_min(F.transform(shards, score))["shard"]


def assign_shards(
    rows: DataFrame, key: str, weights: list[float], column: str = "shard", grown: str | None = None
) -> DataFrame:
    """Rows with their shard, and with ``grown`` the shard under one more of the last weight.

    No shuffle and no Python: one projection. An existing column of the same
    name is replaced. Empty tables stay empty; repeated rows meet in one shard.
    """
    out = {column: rendezvous(F.col(key), weights)}
    if grown:
        out[grown] = rendezvous(F.col(key), [*weights, weights[-1]])
    return rows.withColumns(out)


def number_slots(rows: DataFrame, shard: str, key: str, slot: str = "slot") -> DataFrame:
    """Gapless positions from 0 inside each shard, ordered by the MD5 of the key, then all columns.

    Equal rows are counted before the shuffle and numbered as a run, and a shard
    is cut into ranges of the MD5 whose number follows the row count, so neither
    a hot key nor a large shard meets in one task. Null keys count as empty
    texts. Columns must be sortable; their names are free.
    """
    names = rows.columns
    inner = [f"c{i}" for i in range(len(names))]
    at, by = inner[names.index(shard)], inner[names.index(key)]
    digits = max(0, math.ceil(math.log(max(1, rows.count() / ROWS_PER_RANGE), 16)))
    counted = (
        rows.toDF(*inner)
        .groupBy(*inner)
        .agg(F.count("*").alias("copies"))
        .withColumn("place", F.md5(F.coalesce(F.col(by).cast("string"), F.lit(""))))
        .withColumn("part", F.substring("place", 1, digits))
    )
    running = Window.rowsBetween(Window.unboundedPreceding, 0)
    parts = counted.groupBy(at, "part").agg(F.sum("copies").alias("size"))
    size_so_far = F.sum("size").over(running.partitionBy(at).orderBy("part"))
    parts = parts.select(F.col(at).alias("at"), F.col("part").alias("of"), (size_so_far - F.col("size")).alias("before"))
    inside = F.sum("copies").over(running.partitionBy(at, "part").orderBy("place", *inner))
    numbered = (
        counted.withColumn("inside", inside)
        .join(parts, F.col(at).eqNullSafe(F.col("at")) & (F.col("part") == F.col("of")))
        .withColumn("last", F.col("before") + F.col("inside") - 1)
        .select(*inner, F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))).alias("slot"))
    )
    return numbered.toDF(*names, slot)


def write_shards(rows: DataFrame, path: str, shard: str = "shard", files: int = 1) -> None:
    """Write one folder per shard, each dealt to ``files`` tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != shard]), F.lit(files))
    rows.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(path)
