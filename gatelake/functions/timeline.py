"""Ordered look-ups on long time lines without pairwise joins.

A range count or an as-of look-up is answered by one running aggregate over
the merged time line of points and probes.  The time line is cut into
``(key, bucket)`` pieces, each piece is scanned on its own and the pieces are
linked by a carry that has one row per bucket, so one busy key is spread over
as many tasks as it has buckets.  Equal instants are merged before the
shuffle, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def micros(ts: Column | str) -> Column:
    """Instant as BIGINT microseconds."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def probe_timeline(
    points: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    bucket_us: int = HOUR_US,
) -> DataFrame:
    """For every distinct probe ``(keys, t)``: how many points are at or before
    ``t`` (``n_upto``) and when the latest of them was (``last_t``).

    ``points`` needs ``keys, t, n`` (``n`` is a weight), ``probes`` ``keys, t``.
    """
    keys = list(keys)
    merged = (
        points.select(*keys, "t", F.col("n").cast("bigint").alias("n"), F.col("t").alias("pt"), F.lit(0).alias("q"))
        .unionByName(
            probes.select(
                *keys, "t", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("pt"), F.lit(1).alias("q")
            )
        )
        .withColumn("bucket", F.floor(F.col("t") / F.lit(bucket_us)).cast("bigint"))
        .groupBy(*keys, "bucket", "t")
        .agg(F.sum("n").alias("n"), F.max("pt").alias("pt"), F.max("q").alias("q"))
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        merged.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("n"), F.max("pt").alias("pt"))
        .select(*keys, "bucket", F.sum("n").over(before).alias("n_before"), F.max("pt").over(before).alias("pt_before"))
    )
    scanned = merged.select(
        *keys, "bucket", "t", "q", F.sum("n").over(inside).alias("n_in"), F.max("pt").over(inside).alias("pt_in")
    ).filter("q = 1")
    return scanned.join(carry, [*keys, "bucket"]).select(
        *keys,
        "t",
        (F.col("n_in") + F.coalesce("n_before", F.lit(0))).alias("n_upto"),
        F.coalesce("pt_in", "pt_before").alias("last_t"),
    )


def count_in_range(
    points: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    after: str,
    upto: str,
    name: str = "n_points",
    bucket_us: int = HOUR_US,
) -> DataFrame:
    """Add to each query row the weight of points with ``after < t <= upto``.

    ``after`` and ``upto`` are BIGINT microsecond columns of ``queries``.
    """
    keys = list(keys)
    probes = queries.select(*keys, F.explode(F.array(after, upto)).alias("t"))
    line = probe_timeline(points, probes, keys, bucket_us).select(*keys, "t", "n_upto")
    low = line.withColumnsRenamed({"t": after, "n_upto": "__low"})
    high = line.withColumnsRenamed({"t": upto, "n_upto": "__high"})
    return (
        queries.join(low, [*keys, after], "left")
        .join(high, [*keys, upto], "left")
        .withColumn(name, F.col("__high") - F.col("__low"))
        .drop("__low", "__high")
    )


def lead_in_time(
    df: DataFrame, keys: Sequence[str], t: str, name: str, bucket_us: int = HOUR_US, unit: Column | None = None
) -> DataFrame:
    """Next row's ``t`` within ``keys``, with ties broken by ``unit``.

    Rows are compared inside a bucket; only the last row of a bucket looks at
    the first instant of the next non-empty one.
    """
    keys = list(keys)
    order = [F.col(t)] + ([unit] if unit is not None else [])
    cut = df.withColumn("__b", F.floor(F.col(t) / F.lit(bucket_us)).cast("bigint"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    following = Window.partitionBy(*keys).orderBy("__b")
    carry = (
        cut.groupBy(*keys, "__b")
        .agg(F.min(t).alias("__first"))
        .select(*keys, "__b", F.lead("__first").over(following).alias("__next"))
    )
    return (
        cut.withColumn("__lead", F.lead(t).over(inside))
        .join(carry, [*keys, "__b"])
        .withColumn(name, F.coalesce("__lead", "__next"))
        .drop("__b", "__lead", "__next")
    )


def in_pieces(
    df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], context: int, rows: int, bucket_us: int = HOUR_US
) -> DataFrame:
    """Each key's rows in order, cut into pieces of equal depth for frames of the last ``context + 1`` rows.

    Adds ``row_no`` (from 0 within the key), ``piece`` and ``is_context``: the last
    ``context`` rows of a piece come again, as context, at the head of the next.  A
    window by ``keys, piece`` ordered by ``row_no`` then sees what it would see by
    ``keys`` alone, and no task holds more than ``rows + context`` rows of a key.
    Rows are numbered inside time buckets, which are linked by their counts.
    ``t`` are microseconds, ``order`` breaks ties; ``rows`` is at least ``context``.
    """
    keys = list(keys)
    cut = df.withColumn("__b", F.floor(F.col(t) / F.lit(bucket_us)).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(t, *order)
    numbered = cut.withColumn("__i", F.row_number().over(inside)).join(
        counts.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumnRenamed("__b", "__c"),
        [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__b").eqNullSafe(F.col("__c"))],
    )
    placed = numbered.withColumn("row_no", F.col("__n") + F.col("__i") - 1).drop("__b", "__c", "__i", "__n", *[f"__{k}" for k in keys])
    piece = F.floor(F.col("row_no") / rows).cast("bigint")
    again = F.when(F.col("row_no") % rows >= rows - context, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return placed.withColumn("__s", F.explode(again)).select(
        *placed.columns, (piece + F.col("__s")).alias("piece"), (F.col("__s") == 1).alias("is_context")
    )
