"""Continuous forms of the telemetry gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.operators.gates import error_rate_gate_from_counts
from gatelake.operators.text_policy import fix_refs, parse_commands

# Fixed values -------------------------------------------------------------
WATERMARK = "5 minutes"
LOOK_BACK, INTERVAL = "30 minutes", "1 minute"
FIX_WINDOW = "1 hour"
# ---------------------------------------------------------------------------


def timed(df: DataFrame, column: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Event time as TIMESTAMP with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def interval_counts(counts: DataFrame, interval: str = INTERVAL) -> DataFrame:
    """Events and errors per service and interval, stamped with the interval's last instant."""
    return (
        timed(counts)
        .groupBy("service", F.window("ts", interval).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_error").cast("bigint")).alias("e"))
        .select("service", F.window_time("w").alias("at"), "n", "e")
    )


def stream_error_rate(
    counts: DataFrame,
    baseline: float = 0.005,
    multiplier: float = 2.0,
    min_events: int = 100,
    look_back: str = LOOK_BACK,
    interval: str = INTERVAL,
) -> DataFrame:
    """Gate verdict per service for every look-back window, sliding by one interval.

    Events are reduced to interval counts first, so the sliding windows
    multiply counts and not events.
    """
    sliding = (
        interval_counts(counts, interval)
        .groupBy("service", F.window("at", look_back, interval).alias("w"))
        .agg(F.sum("n").alias("total_events"), F.sum("e").alias("error_events"))
        .select("service", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_events", "error_events")
    )
    return error_rate_gate_from_counts(sliding, baseline, multiplier, min_events)


def stream_canary(rates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Window rates against a static threshold per service and time-of-day slot.

    ``rates(service, slot, window_start, rate)``, ``baseline(service, slot,
    threshold)``; a service without a baseline passes.
    """
    return rates.join(baseline.select("service", "slot", "threshold"), ["service", "slot"], "left").withColumn(
        "regression", F.coalesce(F.col("rate") > F.col("threshold"), F.lit(False))
    )


def stream_verify_fix(fixes: DataFrame, errors: DataFrame, window: str = FIX_WINDOW) -> DataFrame:
    """Error events within the window after the deploy of a fix, or one row without event.

    ``fixes(pr, body, deployed_at)``, ``errors(event_id, ref, ts)``.
    """
    left = (
        fixes.withColumn("deployed_at", F.col("deployed_at").cast("timestamp"))
        .withColumn("ref", F.explode(fix_refs("body")))
        .select("pr", "ref", "deployed_at")
        .withWatermark("deployed_at", WATERMARK)
    )
    right = timed(errors).select(F.col("ref").alias("error_ref"), "event_id", "ts")
    within = F.expr(f"error_ref = ref AND ts > deployed_at AND ts <= deployed_at + INTERVAL {window}")
    return left.join(right, within, "left_outer").select("pr", "ref", "deployed_at", "event_id")


def stream_commands(comments: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Slash command of each comment, first delivery only.

    ``comments(comment_id, body, author_assoc, ts)``.
    """
    first = timed(comments, delay=delay).dropDuplicatesWithinWatermark(["comment_id"])
    return parse_commands(first)


def observe_sessions(
    counts: DataFrame,
    baseline: float = 0.005,
    multiplier: float = 2.0,
    min_events: int = 100,
    gap: str = "10 minutes",
    observe_minutes: int = 30,
    interval: str = INTERVAL,
) -> DataFrame:
    """Decision per telemetry session of a service: roll back, promote or extend.

    A gap in telemetry ends a session.  Failing the gate rolls back; a healthy
    session of at least ``observe_minutes`` promotes; a shorter one extends.
    Works on a stream and on a table alike.
    """
    sessions = (
        interval_counts(counts, interval)
        .groupBy("service", F.session_window("at", gap).alias("s"))
        .agg(
            F.sum("n").alias("total_events"),
            F.sum("e").alias("error_events"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
        )
        .drop("s")
    )
    minutes = F.expr("(unix_timestamp(last_at) - unix_timestamp(first_at)) div 60")
    judged = error_rate_gate_from_counts(sessions, baseline, multiplier, min_events).withColumn("minutes", minutes)
    decision = (
        F.when(~F.col("passed"), "rollback").when(F.col("minutes") >= observe_minutes, "promote").otherwise("extend")
    )
    return judged.withColumn("decision", decision)
