"""Starting streams over tables and landing their results."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.session import shared_dir

# Fixed values -------------------------------------------------------------
FILE_ROWS = 250_000
# ---------------------------------------------------------------------------


def stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files under a glob as a stream, with the schema of what is there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def in_turn(df: DataFrame, at: str, files: int, purpose: str, cuts: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` as a stream that reads one part of its time line after another.

    The parts begin at the given instants, or else at quantiles of ``at``, and are
    written to the shared folder in order; rows without an instant come first.
    Each micro-batch reads one part.  All parts have the same number of files, so many
    that none holds more than about ``FILE_ROWS`` rows; a part with fewer rows is filled
    up with empty ones.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    shares = [i / files for i in range(1, files)]
    if cuts:
        begins = [F.unix_seconds(F.lit(cut).cast("timestamp")) for cut in cuts]
    else:
        begins = (df.agg(F.percentile_approx(seconds, shares, 1000)).first()[0] if shares else None) or []
    part = sum(((seconds >= begin).cast("int") for begin in begins), F.lit(0))
    placed = F.coalesce(part, F.lit(0))
    most = df.groupBy(placed.alias("part")).count().agg(F.max("count")).first()[0] or 1
    each = -(-most // FILE_ROWS)
    for nth in range(len(begins) + 1):
        own = df.filter(placed == nth)
        (own.coalesce(1) if each == 1 else own.repartition(each)).write.mode("append").parquet(path)
        # A partition without rows writes no file.
        for _ in range(each * (nth + 1) - len(spark.read.schema(df.schema).parquet(path).inputFiles()) if each > 1 else 0):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def run_available(stream: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Process everything available into a Parquet table of the shared folder and read it.

    The file sink and its checkpoint live in the folder all executors share, so
    a restarted query continues where it stopped and commits every row once.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_timers(stream: DataFrame, purpose: str) -> DataFrame:
    """Like :func:`run_available` for a stream with processing-time timers.

    Such a stream always has another batch to run, so it is stopped after the
    first batch without input; entries that are not due stay in its state.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{base}/state")
        .trigger(processingTime="0 seconds")
        .start(f"{base}/out")
    )
    while query.isActive and not (query.recentProgress and query.recentProgress[-1]["numInputRows"] == 0):
        time.sleep(0.2)
    if query.exception() is not None:
        raise query.exception()
    query.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, purpose: str, write: Callable[[DataFrame, int, str, str], None]) -> str:
    """Process everything available through ``write(batch, batch_id, path, run)``; returns the path.

    ``run`` is the name of the folder that holds the checkpoint.
    """
    base = shared_dir(stream.sparkSession, purpose)
    path, run = f"{base}/out", base.rstrip("/").rsplit("/", 1)[-1]
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: write(batch, batch_id, path, run))
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path
