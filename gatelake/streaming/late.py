"""The error-rate gate on a stream whose late rows are kept aside and reconciled.

Each micro-batch adds its counts to a log by window.  A window is published once
the watermark has passed its end; rows that come for it afterwards go to a side
table.  Reconciliation counts again only the windows that the side table
touches and publishes a newer version of them; readers take the newest.

Every step writes partitions named by run and batch (or by its own name) and
replaces them when it is repeated, and what it reads was written by earlier
batches only, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions.timeline import micros
from gatelake.operators.gates import error_rate_gate_from_counts

# Fixed values -------------------------------------------------------------
WINDOW_MINUTES = 30
DELAY_MINUTES = 5
# ---------------------------------------------------------------------------

MINUTE_US = 60_000_000
COUNTS = "service string, start_us bigint, n bigint, e bigint, day bigint, batch bigint"
LATE = "service string, ts_us bigint, is_error bigint, start_us bigint, day bigint, batch bigint"
VERDICTS = (
    "service string, start_us bigint, total_events bigint, error_events bigint, error_rate double, threshold double, "
    "passed boolean, version bigint"
)
DAY_US = 86_400_000_000


def _write(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one where nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*[part.split()[0] for part in schema.split(", ")])


def _judged(totals: DataFrame, version: int, gate: dict) -> DataFrame:
    """Verdicts of ``service, start_us, n, e`` under a version."""
    named = totals.select("service", "start_us", F.col("n").alias("total_events"), F.col("e").alias("error_events"))
    verdicts = error_rate_gate_from_counts(named, **gate)
    return verdicts.select(
        "service", "start_us", "total_events", "error_events", F.col("error_rate").cast("double"),
        F.col("threshold").cast("double"), "passed", F.lit(version).cast("bigint").alias("version"),
    )


def _marks(spark: SparkSession, base: str, batch_id: int) -> int | None:
    """The watermark, in microseconds, that all batches before this one have reached."""
    seen = _read(spark, f"{base}/marks", "mark_us bigint, batch bigint").filter(F.col("batch") < batch_id)
    return seen.agg(F.max("mark_us")).first()[0]


def gate_batch(
    batch: DataFrame, batch_id: int, base: str, run: str, window_minutes: int = WINDOW_MINUTES,
    delay_minutes: int = DELAY_MINUTES, **gate,
) -> None:
    """One micro-batch of ``counts(service, ts, is_error)``; ``gate`` goes to the error-rate gate.

    Rows whose window was published go to the side table, all others to the log;
    windows that the watermark passes with this batch are published as version
    ``2 * batch_id``.  The watermark is the latest instant of any batch so far less
    the delay.  Rows without service or instant are left out.
    """
    spark, width = batch.sparkSession, window_minutes * MINUTE_US
    before = _marks(spark, base, batch_id)
    rows = batch.filter("service IS NOT NULL AND ts IS NOT NULL").select(
        "service", micros("ts").alias("ts_us"), F.coalesce(F.col("is_error").cast("bigint"), F.lit(0)).alias("is_error")
    )
    rows = rows.withColumn("start_us", F.floor(F.col("ts_us") / width).cast("bigint") * F.lit(width).cast("bigint")).withColumns(
        {"day": F.floor(F.col("start_us") / DAY_US).cast("bigint"), "batch": F.lit(batch_id).cast("bigint")}
    )
    late = F.lit(False) if before is None else F.col("start_us") + F.lit(width).cast("bigint") <= before
    _write(rows.filter(late), f"{base}/late", "day", "batch")
    fresh = rows.filter(~late).groupBy("service", "start_us", "day", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("is_error").alias("e"))
    _write(fresh, f"{base}/counts", "day", "batch")
    latest = rows.agg(F.max("ts_us")).first()[0]
    mark = max((m for m in (before, None if latest is None else latest - delay_minutes * MINUTE_US) if m is not None), default=None)
    if mark is not None:
        _publish_up_to(spark, base, batch_id, before, mark, width, gate)


def _publish_up_to(spark: SparkSession, base: str, batch_id: int, before: int | None, mark: int, width: int, gate: dict) -> None:
    log = _read(spark, f"{base}/counts", COUNTS).filter(F.col("batch") <= batch_id)
    end = F.col("start_us") + F.lit(width).cast("bigint")
    closed = log.filter(end <= mark)
    if before is not None:  # only days that can still hold an open window are opened
        closed = closed.filter((end > before) & (F.col("day") >= (before - width) // DAY_US))
    totals = closed.groupBy("service", "start_us").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    _write(_judged(totals, 2 * batch_id, gate).withColumn("step", F.lit(f"batch-{batch_id}")), f"{base}/verdicts", "step")
    # The mark comes last: a batch that died before it is taken as a whole again.
    row = spark.createDataFrame([(mark, batch_id)], "mark_us bigint, batch bigint")
    _write(row.coalesce(1), f"{base}/marks", "batch")


def reconcile(spark: SparkSession, base: str, **gate) -> None:
    """Count the windows again that late rows have touched since they were last judged.

    The new verdicts have an odd version behind that of the newest batch; a second
    run without new late rows writes nothing new.
    """
    newest = _read(spark, f"{base}/marks", "mark_us bigint, batch bigint").agg(F.max("batch")).first()[0]
    if newest is None:
        return
    version = 2 * newest + 1
    late = _read(spark, f"{base}/late", LATE).filter(F.col("batch") <= newest)
    side = late.groupBy("service", "start_us", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_error").alias("e"), F.max("batch").alias("last")
    )
    judged = _read(spark, f"{base}/verdicts", VERDICTS).groupBy("service", "start_us").agg(F.max("version").alias("seen"))
    # Late rows of batch b are in every version from 2 b + 1 on.
    touched = side.join(judged, ["service", "start_us"], "left").filter(F.col("seen").isNull() | (F.col("seen") < 2 * F.col("last") + 1))
    log = _read(spark, f"{base}/counts", COUNTS).filter(F.col("batch") <= newest)
    own = log.join(touched.select("service", "start_us", "day"), ["service", "start_us", "day"], "left_semi").select("service", "start_us", "n", "e")
    totals = own.union(touched.select("service", "start_us", "n", "e")).groupBy("service", "start_us").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    _write(_judged(totals, version, gate).withColumn("step", F.lit(f"late-{newest}")), f"{base}/verdicts", "step")


def close(spark: SparkSession, base: str, window_minutes: int = WINDOW_MINUTES, **gate) -> None:
    """Publish the windows that are still open, as at the end of a finite input."""
    newest = _read(spark, f"{base}/marks", "mark_us bigint, batch bigint").agg(F.max("batch"), F.max("mark_us")).first()
    if newest[0] is not None:
        _publish_up_to(spark, base, newest[0] + 1, newest[1], (1 << 63) - 1, window_minutes * MINUTE_US, gate)


def verdicts(spark: SparkSession, base: str) -> DataFrame:
    """The newest version of each window: ``service, window_start, total_events, ..., passed, version``."""
    rows = _read(spark, f"{base}/verdicts", VERDICTS)
    rest = [c for c in rows.columns if c not in ("service", "start_us", "version")]
    newest = rows.groupBy("service", "start_us").agg(F.max(F.struct("version", *rest)).alias("v"))
    return newest.select("service", F.timestamp_micros("start_us").alias("window_start"), *[f"v.{c}" for c in rest], "v.version")


def late_rows(spark: SparkSession, base: str) -> DataFrame:
    """The side table: every row that came after its window was published."""
    return _read(spark, f"{base}/late", LATE).select("service", F.timestamp_micros("ts_us").alias("ts"), "is_error", "batch")
