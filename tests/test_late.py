"""Late rows: kept aside, counted again, and in the end the same as the batch gate."""

import datetime
import random

import pytest

from gatelake.operators.gates import error_rate_gate
from gatelake.streaming import late
from gatelake.streaming.runtime import run_batches

T0 = datetime.datetime(2024, 1, 1)
COUNT = "service string, ts timestamp, is_error int"
GATE = {"baseline": 0.05, "multiplier": 2.0, "min_events": 5}


def events(n=900):
    draw = random.Random(5)
    rows = [(f"s{draw.randint(0, 2)}", T0 + datetime.timedelta(seconds=draw.randint(0, 100_000)), int(draw.random() < 0.1)) for _ in range(n)]
    return [*rows, (None, T0, 1), ("s0", None, 1)]


def batch_gate(spark, rows):
    good = spark.createDataFrame([r for r in rows if None not in r[:2]], COUNT)
    out = error_rate_gate(good, window="30 minutes", **GATE)
    return sorted((r.service, r.window_start, r.total_events, r.error_events, r.passed) for r in out.collect())


def seen(spark, base):
    return sorted((r.service, r.window_start, r.total_events, r.error_events, r.passed) for r in late.verdicts(spark, base).collect())


def feed(spark, base, rows, batch_id):
    late.gate_batch(spark.createDataFrame(rows, COUNT), batch_id, base, "run", **GATE)


@pytest.mark.parametrize("order", ["shuffled", "in time"])
def test_stream_and_reconciliation_equal_the_batch(spark, tmp_path, order):
    rows, base = events(), str(tmp_path / "gate")
    if order == "shuffled":
        random.Random(2).shuffle(rows)
    else:
        rows.sort(key=lambda r: r[1] or T0)
    for i in range(4):
        feed(spark, base, rows[i * 226 : (i + 1) * 226], i)
        if i == 1:
            late.reconcile(spark, base, **GATE)
    feed(spark, base, rows[3 * 226 :], 3)  # repeated
    late.close(spark, base, **GATE)
    late.reconcile(spark, base, **GATE)
    assert seen(spark, base) == batch_gate(spark, rows)
    n_late = late.late_rows(spark, base).count()
    assert n_late == 0 if order == "in time" else n_late > 300


def test_only_touched_windows_get_a_new_version(spark, tmp_path):
    base, at = str(tmp_path / "gate"), lambda m: T0 + datetime.timedelta(minutes=m)
    feed(spark, base, [("a", at(1), 0)] * 6 + [("a", at(31), 0)] * 6 + [("a", at(95), 0)], 0)
    assert [v[:3] for v in seen(spark, base)] == [("a", T0, 6), ("a", at(30), 6)]
    feed(spark, base, [("a", at(2), 1)] * 3 + [("a", at(96), 1)], 1)
    assert seen(spark, base)[0] == ("a", T0, 6, 0, True)  # published, not yet reconciled
    assert late.late_rows(spark, base).count() == 3
    late.reconcile(spark, base, **GATE)
    got = {r.window_start: (r.total_events, r.passed, r.version) for r in late.verdicts(spark, base).collect()}
    assert got == {T0: (9, False, 3), at(30): (6, True, 0)}
    files = spark.read.parquet(f"{base}/verdicts").filter("step = 'late-1'")
    assert files.count() == 1
    late.reconcile(spark, base, **GATE)  # nothing new
    assert {r.window_start: r.version for r in late.verdicts(spark, base).collect()} == {T0: 3, at(30): 0}
    feed(spark, base, [("b", at(3), 1)] * 7, 2)  # a window that no on-time row ever made
    late.reconcile(spark, base, **GATE)
    assert ("b", T0, 7, 7, False) in seen(spark, base)


def test_a_batch_that_died_is_taken_as_a_whole_again(spark, tmp_path, monkeypatch):
    rows, base = sorted((r for r in events(300) if None not in r[:2]), key=lambda r: r[1]), str(tmp_path / "gate")
    feed(spark, base, rows[:150], 0)
    write, left = late._write, [0]

    def dying(df, path, *parts):
        if left[0] == 0:
            raise KeyboardInterrupt
        left[0] -= 1
        write(df, path, *parts)

    for writes in range(4):
        left[0] = writes
        with monkeypatch.context() as m:
            m.setattr(late, "_write", dying)
            with pytest.raises(KeyboardInterrupt):
                feed(spark, base, rows[150:], 1)
    feed(spark, base, rows[150:], 1)
    late.close(spark, base, **GATE)
    assert seen(spark, base) == batch_gate(spark, rows) and late.late_rows(spark, base).count() == 0


def test_a_stream_feeds_it(spark, tmp_path):
    rows = events(200)
    for i in range(3):
        spark.createDataFrame(rows[i::3], COUNT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COUNT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = run_batches(stream, "late", lambda *a: late.gate_batch(*a, **GATE))
    late.close(spark, base, **GATE)
    late.reconcile(spark, base, **GATE)
    assert seen(spark, base) == batch_gate(spark, rows)
