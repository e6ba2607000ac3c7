"""Delayed dispatch and follow-up queues: batch twins, stateful stream, queue table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values -------------------------------------------------------------
FIRE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
FOLLOWUP_MARKER = "agent-followup"
STALE_DAYS = {"issue": (60, 14), "pr": (30, 7)}
LOCK_DAYS = 30
# ---------------------------------------------------------------------------

FIRED = "key string, fire_at string, queued_us bigint, payload string, reason string"
_FIRED = Row("key", "fire_at", "queued_us", "payload", "reason")


# -- batch twins -------------------------------------------------------------------


def schedule(requests: DataFrame) -> DataFrame:
    """Queue entries with their due time: staged time plus the observation minutes.

    An unreadable staged time gives no due time.
    """
    staged = F.expr("try_to_timestamp(stg_deploy_time)")
    return requests.withColumn("due", staged + F.expr("make_interval(0, 0, 0, 0, 0, observation_minutes, 0)")).withColumn(
        "fire_at", F.date_format("due", FIRE_FORMAT)
    )


def newest_per_digest(queue: DataFrame, key: str = "digest", order: tuple[str, ...] = ("queued_at", "entry_id")) -> DataFrame:
    """One entry per digest: a later request replaces an earlier one.

    An aggregate rather than a window, so copies meet before the shuffle.
    """
    rest = [c for c in queue.columns if c != key and c not in order]
    packed = F.struct(*order, *rest)
    return queue.groupBy(key).agg(F.max(packed).alias("e")).select(key, "e.*")


def split_due(queue: DataFrame, now: str) -> DataFrame:
    """Entries marked due or pending at ``now``; an unreadable time is due."""
    status = F.when(F.col("due").isNull() | (F.col("due") <= F.expr(f"timestamp'{now}'")), "due").otherwise("pending")
    return queue.withColumn("status", status)


def parse_followups(comments: DataFrame, body: str = "body") -> DataFrame:
    """Follow-up markers of comments: due time, reason and task."""
    text = F.regexp_extract(body, rf"<!-- {FOLLOWUP_MARKER}:(\{{.*?\}}) -->", 1)
    fields = F.from_json("__m", "struct<due_at:string,reason:string,task:string>")
    return (
        comments.withColumn("__m", text)
        .filter("__m <> ''")
        .withColumn("__f", fields)
        .withColumns(
            {
                "due_at": F.col("__f.due_at"),
                "reason": F.coalesce("__f.reason", F.lit("")),
                "task": F.coalesce("__f.task", F.lit("issue-followup")),
                "due": F.expr("try_to_timestamp(__f.due_at)"),
            }
        )
        .drop("__m", "__f", body)
    )


def due_followups(markers: DataFrame, now: str) -> DataFrame:
    return split_due(markers, now)


def stale_sweep(items: DataFrame, now: str) -> DataFrame:
    """Action for each item: mark-stale, close, lock or none.

    ``items(kind, state, last_activity, stale_since, closed_at)``.
    """
    at = F.expr(f"timestamp'{now}'")
    age = lambda col: F.expr(f"(unix_timestamp(timestamp'{now}') - unix_timestamp(cast({col} as timestamp))) div 86400")
    issue = F.col("kind") == "issue"
    stale_after = F.when(issue, STALE_DAYS["issue"][0]).otherwise(STALE_DAYS["pr"][0])
    close_after = F.when(issue, STALE_DAYS["issue"][1]).otherwise(STALE_DAYS["pr"][1])
    still_stale = F.col("stale_since").isNotNull() & (F.col("last_activity") <= F.col("stale_since"))
    action = (
        F.when(F.col("state") == "closed", F.when(age("closed_at") >= LOCK_DAYS, "lock").otherwise("none"))
        .when(still_stale, F.when(age("stale_since") >= close_after, "close").otherwise("none"))
        .when(age("last_activity") >= stale_after, "mark-stale")
        .otherwise("none")
    )
    return items.withColumn("action", F.when(at.isNotNull(), action))


# -- stateful stream ---------------------------------------------------------------


class DelayQueue(StatefulProcessor):
    """One pending entry per key with a processing-time timer.

    A newer entry replaces the pending one; an entry without a readable due
    time fires at once; one without a queue time (-1 in the result) leaves as
    ``invalid`` and touches no other.  Rows are taken one by one, and the state is
    asked once a key: most keys have a handful of rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "fire_ms bigint, queued_us bigint, fire_at string, payload string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, rank = None, None
        for row in rows:
            if row.queued_us is None:
                # Without a queue time a record can't replace or be replaced: it leaves as it is.
                yield _FIRED(key[0], row.fire_at, -1, row.payload, "invalid")
                continue
            own = (row.queued_us, row.payload is None, row.payload or "")
            if last is None or own >= rank:
                last, rank = (row.fire_ms, row.queued_us, row.fire_at, row.payload), own
        if last is None:
            return
        pending = self.entry.get()
        if pending is not None:
            if last[1] < pending[1]:
                last = tuple(pending)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if last[0] is None or last[0] <= timerValues.getCurrentProcessingTimeInMs():
            if pending is not None:
                self.entry.clear()
            yield self._fired(key, last)
        else:
            self.entry.update(last)
            self.handle.registerTimer(last[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists():
            pending = self.entry.get()
            self.entry.clear()
            yield self._fired(key, pending)

    def close(self) -> None:
        pass

    @staticmethod
    def _fired(key, entry) -> Row:
        reason = "unparseable" if entry[0] is None else "due"
        return _FIRED(key[0], entry[2], entry[1], entry[3], reason)


def stream_delayed(entries: DataFrame) -> DataFrame:
    """Entries of a stream as they fall due.

    ``entries(key, due, fire_at, queued_at, payload)``; used for dispatches
    (key is the digest) and follow-ups (key is the issue).
    """
    return (
        entries.select(
            "key",
            F.unix_millis(F.col("due").cast("timestamp")).alias("fire_ms"),
            F.unix_micros(F.col("queued_at").cast("timestamp")).alias("queued_us"),
            "fire_at",
            "payload",
        )
        .groupBy("key")
        .transformWithState(DelayQueue(), FIRED, "append", "processingTime")
    )


# -- queue table ----------------------------------------------------------------------


def upsert_queue(batch: DataFrame, batch_id: int, path: str, run: str) -> None:
    """Write one micro-batch of requests as its own partition.

    ``run`` names the checkpoint of the stream: batch numbers start again with a
    new checkpoint, and must not meet those of an earlier one.  The partition is
    replaced as a whole, so a repeated batch of a run changes nothing.
    """
    newest_per_digest(batch).write.mode("overwrite").parquet(f"{path}/batch={run}-{batch_id}")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Current queue: the newest entry of each digest over all batches."""
    return newest_per_digest(spark.read.parquet(path).drop("batch"))


def compact_queue(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite the current queue as one batch of a new table, under a name no stream can have."""
    read_queue(spark, path).write.parquet(f"{target}/batch=base-{uuid.uuid4().hex}")
