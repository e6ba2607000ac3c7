"""Keyed memory in event time against plain Python, for several splits into micro-batches."""

import datetime
import random

import pandas as pd
import pytest

from gatelake.streaming import observation as o
from gatelake.streaming.runtime import in_turn, run_available, stream_parquet

T0 = datetime.datetime(2024, 1, 1)
FAILURE = "target string, marker string, at timestamp"
COUNT, DEPLOY = "service string, ts timestamp, is_error int", "deploy_id string, service string, ts timestamp"


def after(**delta):
    return T0 + datetime.timedelta(**delta)


def reported(rows, delay=datetime.timedelta(minutes=5), hours=6):
    mark = max(r[2] for r in rows if r[2]) - delay
    out = []
    for key in {r[:2] for r in rows}:
        last = None
        for at in sorted({r[2] for r in rows if r[:2] == key and r[2] and r[2] <= mark}):
            if last is None or at - last > datetime.timedelta(hours=hours):
                out.append((*key, at))
                last = at
    return sorted(out, key=repr)


@pytest.mark.parametrize("files", [1, 3, 7])
def test_repeats_are_remembered_for_hours_after_the_last_report(spark, files):
    draw = random.Random(1)
    rows = [("every five hours", "m", after(hours=5 * i)) for i in range(15)]
    rows += [("busy", "m", after(minutes=draw.randint(0, 4200))) for _ in range(300)]
    rows += [("exactly", "m", after(hours=6 * i)) for i in range(6)] + [("once", None, T0), ("once", None, T0), ("none", "m", None)]
    rows += [("end", "m", after(hours=75))]
    draw.shuffle(rows)
    stream = in_turn(spark.createDataFrame(rows, FAILURE), "at", files, "failures")
    got = sorted((tuple(r) for r in run_available(o.stream_repeat_suppression(stream), "repeats").collect()), key=repr)
    assert got == reported(rows)
    # The run that never ends is reported at its start and again, not only when it is over.
    assert sorted(g[2] for g in got if g[0] == "every five hours") == [after(hours=10 * i) for i in range(8)]
    assert sorted(g[2] for g in got if g[0] == "exactly") == [after(hours=12 * i) for i in range(3)]


def test_rows_out_of_order_within_the_delay_change_nothing(spark, tmp_path):
    rows = [("k", "m", after(minutes=m)) for m in (0, 4, 2, 361, 358, 363, 1000)]
    for part in (rows[:2], rows[2:4], rows[4:6], rows[6:]):
        spark.createDataFrame(part, FAILURE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FAILURE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(r.at for r in run_available(o.stream_repeat_suppression(stream), "repeats").collect())
    assert got == [T0, after(minutes=361)]


ARGS = {"baseline": 0.1, "multiplier": 2.0, "min_events": 15, "observe_minutes": 30}


def decided(deploys, events, min_events, observe_minutes, healthy=2, most=4, **_):
    out = []
    for deploy, service, at in deploys:
        start = at if at.second == at.microsecond == 0 else at.replace(second=0, microsecond=0) + datetime.timedelta(minutes=1)
        streak = 0
        for k in range(1, most + 1):
            low, high = (start + datetime.timedelta(minutes=observe_minutes * j) for j in (k - 1, k))
            bad = [e for s, t, e in events if s == service and low <= t < high]
            n, failed = len(bad), len(bad) >= min_events and sum(bad) * 10_000 // len(bad) > 2000
            streak = streak + 1 if n >= min_events and not failed else 0
            decision = "rollback" if failed else "promote" if streak >= healthy else "timeout" if k == most else "extend"
            out.append((deploy, service, k, low, high, n, sum(bad), decision))
            if decision != "extend":
                break
    return sorted(out)


@pytest.fixture(scope="module")
def estate():
    draw = random.Random(1)
    events = []
    for _ in range(4000):
        at = after(seconds=draw.randint(0, 86400))
        events.append((f"s{draw.randint(0, 3)}", at, int(draw.random() < (0.5 if at.hour % 6 == 3 else 0.02))))
    deploys = [(f"d{i}", f"s{draw.randint(0, 4)}", after(seconds=draw.randint(0, 80000))) for i in range(25)]
    return events, deploys + [("whole", "s0", after(hours=1))]


def test_batch_twin_follows_the_rule(spark, estate):
    events, deploys = estate
    got = o.observe_deploys(spark.createDataFrame(deploys, DEPLOY), spark.createDataFrame(events, COUNT), **ARGS)
    want = decided(deploys, events, **ARGS)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {w[-1] for w in want} == {"promote", "extend", "rollback", "timeout"}


@pytest.mark.parametrize("files", [1, 4])
def test_stream_of_deploys_equals_the_batch_for_any_split(spark, estate, files):
    events, deploys = estate
    streams = (
        in_turn(spark.createDataFrame([*deploys, deploys[0], (None, "s0", T0), ("x", "s1", None)], DEPLOY), "ts", files, "deploys"),
        in_turn(spark.createDataFrame([*events, (None, T0, 1), ("s1", None, 1)], COUNT), "ts", files, "counts"),
    )
    got = run_available(o.stream_observe_deploys(*streams, **ARGS), "observed")
    mark = min(max(e[1] for e in events), max(d[2] for d in deploys)) - datetime.timedelta(minutes=5)
    want = [w for w in decided(deploys, events, **ARGS) if w[4] <= mark]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_deploys_without_telemetry_time_out(spark, tmp_path):
    spark.createDataFrame([("d", "quiet", T0), ("e", "quiet", after(days=1))], DEPLOY).coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([("other", after(days=2), 0)], COUNT).coalesce(1).write.parquet(str(tmp_path / "c"))
    out = run_available(o.stream_observe_deploys(*(stream_parquet(spark, str(tmp_path / n)) for n in "dc"), **ARGS), "observed")
    assert sorted((r.deploy_id, r.window_no, r.decision) for r in out.collect()) == [("d", k, "timeout" if k == 4 else "extend") for k in range(1, 5)]
    empty = o.observe_deploys(spark.createDataFrame([], DEPLOY), spark.createDataFrame([], COUNT))
    assert empty.count() == 0


class Held:
    """State of one key in memory; counts the calls."""

    def __init__(self):
        self.kept, self.calls, self.watermark = {}, 0, 0

    def getMapState(self, *_):
        return self.getValueState()

    def getValueState(self, *_):
        part = Held()
        self.kept[id(part)] = part
        return part

    def registerTimer(self, ms):
        self.at = ms

    def deleteTimer(self, ms):
        self.at = None

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def __getattr__(self, name):
        def call(key=(), value=None):
            self.calls += 1
            if name in ("updateValue", "update"):
                self.kept[() if value is None else key] = key if value is None else value
            elif name in ("removeKey", "clear"):
                self.kept.pop(key, None)
            elif name in ("containsKey", "exists"):
                return key in self.kept
            elif name in ("getValue", "get"):
                return self.kept[key]
            else:
                return iter(list(self.kept if name == "keys" else self.kept.items()))

        return call


def test_watching_many_deploys_asks_the_state_a_few_times():
    draw = random.Random(2)
    us = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    deploys = [(f"d{i}", "s", after(minutes=draw.randint(0, 700))) for i in range(3000)]
    events = [("s", after(minutes=draw.randint(0, 1400)), int(draw.random() < 0.2)) for _ in range(3000)]
    rows = [(d, us(t), 0, 0) for d, _, t in deploys] + [(None, us(t), 1, bad) for _, t, bad in events]
    watch, state = o.DeployWatch(30 * o.MINUTE_US, o.MINUTE_US, 4, 2, 15, 2000), Held()
    watch.init(state)
    assert list(watch.handleInputRows(("s", 0), iter([pd.DataFrame(rows, columns=["deploy_id", "interval_us", "n", "e"])]), state)) == []
    got = []
    for hours in (3, 7, 24):
        state.watermark = us(after(hours=hours)) // 1000
        got += [r for frame in watch.handleExpiredTimer(("s", 0), state, None) for r in frame.itertuples(index=False, name=None)]
    want = [(d, s, k, us(a), us(b), *rest) for d, s, k, a, b, *rest in decided(deploys, events, **ARGS)]
    assert sorted(got) == want
    assert sum(part.calls for part in state.kept.values()) < 100

