"""Result tables written by jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_gate_results(df: DataFrame, path: str, day: Column, mode: str = "overwrite") -> None:
    """Gate results as Parquet, one partition per day.

    Rows are hashed over several tasks per day so that one busy day is not
    written by one task; only the days in ``df`` are replaced.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(8))
    (
        df.withColumn("dt", F.date_format(day, "yyyy-MM-dd"))
        .repartition("dt", spread)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(path)
    )


def write_feeds(feeds: DataFrame, path: str) -> None:
    """Deploy payloads as text, one folder per provider."""
    feeds.select("provider", F.col("payload").alias("value")).write.mode("overwrite").partitionBy("provider").text(path)
