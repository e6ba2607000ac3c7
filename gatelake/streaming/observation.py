"""Keyed memory in event time: repeated failures, and deploys watched over consecutive windows.

Both processors hold rows back until the watermark has passed them and then take
them in the order of event time, so the result does not depend on how rows fall
into micro-batches.  Instants are kept in state by the hour, deploys and counts by
six hours, since each entry that is read or written costs a call.  A service is watched
in ``WATCH_PARTS`` parts, each with some of its deploys and all of its counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gatelake.functions.timeline import HOUR_US, count_in_range, micros

# Fixed values -------------------------------------------------------------
REPEAT_HOURS = 6
OBSERVE_MINUTES = 30
WATERMARK = "5 minutes"
WATCH_PARTS = 16
TICK_ROWS = 500_000
# ---------------------------------------------------------------------------

MINUTE_US = 60_000_000
SLOT_US = 6 * HOUR_US


class _OneTimer(StatefulProcessor):
    """A key has one timer at most, at the earliest instant asked for, so it wakes once in a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wake(self, at_us: int) -> None:
        """Wake once the watermark, in milliseconds, has reached the instant."""
        ms = -(-at_us // 1000)
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or ms < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def close(self) -> None:
        pass


class RepeatMemory(_OneTimer):
    """Remembers the last report of a key; failures wait until the watermark has passed them."""

    def __init__(self, window_us: int, names: list[str]) -> None:
        self.window_us, self.names = window_us, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "hour bigint", "instants array<bigint>")
        self.last = handle.getValueState("last", "at_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            for hour, instants in chunk["at_us"].groupby(chunk["at_us"] // HOUR_US):
                slot = (int(hour),)
                held = list(self.waiting.getValue(slot)[0]) if self.waiting.containsKey(slot) else []
                self.waiting.updateValue(slot, (held + [int(i) for i in instants],))
                first = min(int(instants.min()), first or int(instants.min()))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.last.get()[0] if self.last.exists() else None
        found, rest = [], None
        for hour in sorted(k[0] for k in self.waiting.keys()):
            if hour * HOUR_US > mark:
                rest = min(self.waiting.getValue((hour,))[0])
                break
            instants = sorted(self.waiting.getValue((hour,))[0])
            for at in instants:
                if at <= mark and (last is None or at - last > self.window_us):
                    found.append(at)
                    last = at
            later = [i for i in instants if i > mark]
            if later:
                self.waiting.updateValue((hour,), (later,))
                rest = later[0]
                break
            self.waiting.removeKey((hour,))
        if rest is not None:
            self._wake(rest)
        if last is None or mark - last > self.window_us:
            self.last.clear()  # whatever comes now is far enough from the last report
        else:
            self.last.update((last,))
            self._wake(last + self.window_us + 1000)
        if found:
            yield pd.DataFrame({**dict(zip(self.names, ([k] * len(found) for k in key), strict=True)), "at_us": found})


def stream_repeat_suppression(
    failures: DataFrame, keys: tuple[str, ...] = ("target", "marker"), hours: int = REPEAT_HOURS, delay: str = WATERMARK
) -> DataFrame:
    """The failures of a stream that are reported: none reported for the key in the last ``hours``.

    ``failures(*keys, at)``; gives ``keys, at``.  A failure is reported as soon as
    the watermark has passed it, and one that never stops again whenever ``hours``
    have gone by since the last report, not since the last failure; nothing waits
    for the end of a run.  Failures of one instant are one, those without an
    instant are left out.  A key is forgotten ``hours`` after its last report.
    """
    timed = failures.select(*keys, F.col("at").cast("timestamp").alias("at")).filter("at IS NOT NULL").withWatermark("at", delay)
    names = list(keys)
    schema = StructType([timed.schema[k] for k in keys]).add("at_us", "long")
    rows = timed.withColumn("at_us", micros("at")).groupBy(*names)
    out = rows.transformWithStateInPandas(RepeatMemory(hours * HOUR_US, names), schema, "append", "eventTime")
    return out.select(*names, F.timestamp_micros("at_us").alias("at"))


# -- deploys -----------------------------------------------------------------------


def _limit(baseline: float, multiplier: float) -> int:
    """Error rates are cut to four places; the largest that passes, in ten-thousandths."""
    return int(Decimal(str(baseline)) * Decimal(str(multiplier)) * 10_000 // 1)


class DeployWatch(_OneTimer):
    """Open deploys of a part of a service and its telemetry, judged window by window as the watermark passes.

    Deploys are kept by the slot of their start, and all that wake together are judged together.
    """

    def __init__(self, window_us: int, interval_us: int, most: int, healthy: int, least: int, limit: int) -> None:
        self.window_us, self.interval_us = window_us, interval_us
        self.most, self.healthy, self.least, self.limit = most, healthy, least, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "slot bigint", "at array<bigint>, n array<bigint>, e array<bigint>")
        self.open = handle.getMapState(
            "open", "slot bigint", "deploy_id array<string>, start_us array<bigint>, window_no array<int>, streak array<int>"
        )

    def _told(self, told: pd.DataFrame) -> list[int]:
        """Keep new deploys; gives the starts of those that were not open."""
        known = {deploy for _, held in self.open.iterator() for deploy in held[0]}
        told = told.drop_duplicates("deploy_id")  # a deploy that is told twice counts once
        told = told[~told["deploy_id"].isin(known)]
        for nth, own in told.groupby(told["interval_us"] // SLOT_US):
            slot = (int(nth),)
            held = [list(c) for c in self.open.getValue(slot)] if self.open.containsKey(slot) else [[], [], [], []]
            for column, more in zip(held, (own["deploy_id"].tolist(), own["interval_us"].tolist(), [1] * len(own), [0] * len(own)), strict=True):
                column.extend(more)
            self.open.updateValue(slot, tuple(held))
        return told["interval_us"].tolist()

    def _count(self, ticks: pd.DataFrame) -> list[int]:
        """Add the counts of intervals; gives the ends of their slots."""
        summed = ticks.groupby("interval_us", as_index=False)[["n", "e"]].sum()
        slots = summed["interval_us"] // SLOT_US
        for nth, own in summed.groupby(slots):
            slot = (int(nth),)
            if self.counts.containsKey(slot):
                held = pd.DataFrame(dict(zip(own.columns, map(list, self.counts.getValue(slot)), strict=True)))
                own = pd.concat([held, own]).groupby("interval_us", as_index=False).sum()
            self.counts.updateValue(slot, tuple(own[c].tolist() for c in own.columns))
        return ((slots.unique() + 1) * SLOT_US).tolist()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = list(rows)
        told = [c.loc[c["deploy_id"].notna(), ["deploy_id", "interval_us"]] for c in chunks]
        # The others' intervals are closed.
        ticks = [c.loc[c["deploy_id"].isna() & (c["interval_us"] + self.interval_us > mark), ["interval_us", "n", "e"]] for c in chunks]
        wake = [start + self.window_us for start in self._told(pd.concat(told))] if any(map(len, told)) else []
        wake += self._count(pd.concat(ticks)) if any(map(len, ticks)) else []
        if wake:
            self._wake(min(wake))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        counts = {slot: held for (slot,), held in self.counts.iterator()}
        at, n, e = (np.array([x for slot in sorted(counts) for x in counts[slot][i]], dtype=np.int64) for i in range(3))
        # What all intervals before an interval hold; those of a slot are kept in order.
        sums = [np.concatenate(([0], np.cumsum(c))) for c in (n, e)]
        columns = ["deploy_id", "start", "window_no", "streak"]
        held = {slot: pd.DataFrame(dict(zip(columns, map(list, own), strict=True))) for (slot,), own in self.open.iterator()}
        left = pd.concat([own.assign(slot=slot) for slot, own in held.items()], ignore_index=True) if held else pd.DataFrame(columns=[*columns, "slot"])
        found, needed, wake, changed = [], mark, [], set()
        while len(left):
            end = left["start"] + left["window_no"] * self.window_us
            due = left[end <= mark].copy()
            if not len(due):
                needed = min(needed, int(end.min()) - self.window_us)
                wake.append(int(end.min()))
                break
            changed.update(due["slot"])
            high = end[due.index].to_numpy()
            first, behind = (np.searchsorted(at, x) for x in (high - self.window_us, high))
            events, errors = (s[behind] - s[first] for s in sums)
            enough = events >= self.least
            failed = enough & (errors * 10_000 // np.maximum(events, 1) > self.limit)
            due["streak"] = np.where(enough & ~failed, due["streak"] + 1, 0)
            cases = [failed, due["streak"] >= self.healthy, due["window_no"] >= self.most]
            decision = np.select(cases, ["rollback", "promote", "timeout"], "extend")
            found.append(pd.DataFrame({
                "deploy_id": due["deploy_id"], "service": key[0], "window_no": due["window_no"], "start_us": high - self.window_us, "end_us": high,
                "total_events": events, "error_events": errors, "decision": decision,
            }))
            due["window_no"] += 1
            left = pd.concat([left.drop(index=due.index), due[decision == "extend"]])
        rest = dict(list(left.groupby("slot")))
        for slot in changed:
            if slot in rest:
                self.open.updateValue((int(slot),), tuple(rest[slot][c].tolist() for c in columns))
            else:
                self.open.removeKey((int(slot),))
        # A deploy still to come begins behind the watermark, so older slots serve open deploys only.
        for slot in counts:
            if (slot + 1) * SLOT_US <= needed:
                self.counts.removeKey((slot,))
            else:
                wake.append(max((slot + 1) * SLOT_US, mark + SLOT_US))
        if wake:
            self._wake(min(wake))
        yield from found


OBSERVED = (
    "deploy_id string, service string, window_no int, start_us bigint, end_us bigint, total_events bigint, "
    "error_events bigint, decision string"
)


def _ticks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a task, counted per service and interval before anything is shuffled."""

    def counted(parts: list[pa.Table]) -> pa.Table:
        sums = [("at_us", "max"), ("n", "sum"), ("e", "sum")]
        own = pa.concat_tables(parts).group_by(["service", "interval_us"]).aggregate(sums)
        return own.rename_columns({f"{c}_{how}": c for c, how in sums}).select(["service", "interval_us", "at_us", "n", "e"])

    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) >= TICK_ROWS:
            held = [counted(held)]
            if len(held[0]) >= TICK_ROWS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from counted(held).to_batches()


def _first_interval(at: Column, interval_us: int) -> Column:
    """Start of the first interval that begins at or after the instant."""
    return F.expr("-1") * F.floor(-micros(at) / F.lit(interval_us)).cast("bigint") * interval_us


def stream_observe_deploys(
    deploys: DataFrame,
    counts: DataFrame,
    baseline: float = 0.005,
    multiplier: float = 2.0,
    min_events: int = 100,
    observe_minutes: int = OBSERVE_MINUTES,
    interval_minutes: int = 1,
    healthy_windows: int = 2,
    most_windows: int = 4,
    delay: str = WATERMARK,
) -> DataFrame:
    """Decision after each window that follows a deploy, from two streams.

    ``deploys(deploy_id, service, ts)``, ``counts(service, ts, is_error)``.  The
    windows of a deploy have ``observe_minutes`` each, follow one another, and
    begin with the first interval after it.  A window whose error rate is above
    ``baseline * multiplier`` rolls back; ``healthy_windows`` healthy ones in a row
    promote; a window with fewer than ``min_events`` events is neither; without a
    decision the deploy is extended, and after ``most_windows`` it times out, also
    if no telemetry ever came.  Gives a row for each window up to the final
    decision, as soon as the watermark of both streams has passed the window.
    Rows without service, instant or deploy id are left out.
    """
    interval_us = interval_minutes * MINUTE_US
    events = counts.filter("service IS NOT NULL AND ts IS NOT NULL").select(
        F.col("service").cast("string"), (F.floor(micros("ts") / F.lit(interval_us)).cast("bigint") * interval_us).alias("interval_us"),
        micros("ts").alias("at_us"), F.lit(1).cast("bigint").alias("n"), F.coalesce(F.col("is_error").cast("bigint"), F.lit(0)).alias("e"),
    )
    ticks = events.mapInArrow(_ticks, "service string, interval_us bigint, at_us bigint, n bigint, e bigint")
    # Each part of a service has some of its deploys and all of its counts.
    ticks = ticks.withColumns({"deploy_id": F.lit(None).cast("string"), "part": F.explode(F.sequence(F.lit(0), F.lit(WATCH_PARTS - 1)))})
    told = deploys.filter("deploy_id IS NOT NULL AND service IS NOT NULL AND ts IS NOT NULL").select(
        F.col("service").cast("string"), F.col("deploy_id").cast("string").alias("deploy_id"), _first_interval(F.col("ts"), interval_us).alias("interval_us"),
        micros("ts").alias("at_us"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("e"),
    ).withColumn("part", F.pmod(F.xxhash64("deploy_id"), F.lit(WATCH_PARTS)).cast("int"))
    columns = ["service", "part", "deploy_id", "interval_us", "at", "n", "e"]
    parts = [
        part.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", delay).select(*columns)
        for part in (told, ticks)
    ]
    watch = DeployWatch(observe_minutes * MINUTE_US, interval_us, most_windows, healthy_windows, min_events, _limit(baseline, multiplier))
    out = parts[0].union(parts[1]).groupBy("service", "part").transformWithStateInPandas(watch, OBSERVED, "append", "eventTime")
    return _observed(out)


def _observed(windows: DataFrame) -> DataFrame:
    return windows.select(
        "deploy_id", "service", "window_no", F.timestamp_micros("start_us").alias("window_start"),
        F.timestamp_micros("end_us").alias("window_end"), "total_events", "error_events", "decision",
    )


def observe_deploys(
    deploys: DataFrame,
    counts: DataFrame,
    baseline: float = 0.005,
    multiplier: float = 2.0,
    min_events: int = 100,
    observe_minutes: int = OBSERVE_MINUTES,
    interval_minutes: int = 1,
    healthy_windows: int = 2,
    most_windows: int = 4,
) -> DataFrame:
    """Batch twin of :func:`stream_observe_deploys` over tables that are complete.

    Events are counted per interval; the windows are range counts on the merged
    time line of a service, so no deploy is paired with telemetry.
    """
    interval_us, window_us = interval_minutes * MINUTE_US, observe_minutes * MINUTE_US
    ticks = (
        counts.filter("service IS NOT NULL AND ts IS NOT NULL")
        .groupBy(F.col("service").cast("string").alias("service"), (F.floor(micros("ts") / interval_us).cast("bigint") * interval_us).alias("t"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("is_error").cast("bigint"), F.lit(0))).alias("e"))
    )
    told = (
        deploys.filter("deploy_id IS NOT NULL AND service IS NOT NULL AND ts IS NOT NULL")
        .groupBy(F.col("deploy_id").cast("string").alias("deploy_id"), F.col("service").cast("string").alias("service"))
        .agg(_first_interval(F.min("ts"), interval_us).alias("start"))
    )
    width = F.lit(window_us).cast("bigint")
    windows = told.withColumn("window_no", F.explode(F.sequence(F.lit(1), F.lit(most_windows)))).select(
        "deploy_id", "service", "window_no",
        (F.col("start") + (F.col("window_no") - 1) * width).alias("start_us"), (F.col("start") + F.col("window_no") * width).alias("end_us"),
    ).withColumns({"after": F.col("start_us") - 1, "upto": F.col("end_us") - 1})
    counted = count_in_range(ticks.select("service", "t", "n"), windows, ["service"], "after", "upto", "total_events")
    counted = count_in_range(ticks.select("service", "t", F.col("e").alias("n")), counted, ["service"], "after", "upto", "error_events")
    enough = F.col("total_events") >= min_events
    failed = enough & (F.expr("error_events * 10000 div nullif(total_events, 0)") > _limit(baseline, multiplier))
    upto = Window.partitionBy("deploy_id", "service").orderBy("window_no").rowsBetween(Window.unboundedPreceding, 0)
    judged = counted.withColumn("failed", F.coalesce(failed, F.lit(False))).withColumn(
        "broken", F.coalesce(F.max(F.when(F.col("failed") | ~enough, F.col("window_no"))).over(upto), F.lit(0))
    )
    decision = (
        F.when(F.col("failed"), "rollback")
        .when(F.col("window_no") - F.col("broken") >= healthy_windows, "promote")
        .when(F.col("window_no") >= most_windows, "timeout")
        .otherwise("extend")
    )
    decided = judged.withColumn("decision", decision)
    before = Window.partitionBy("deploy_id", "service").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.count(F.when(F.col("decision") != "extend", 1)).over(before)
    return _observed(decided.withColumn("earlier", earlier).filter("earlier = 0"))
