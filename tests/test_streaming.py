import datetime
import time
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gatelake.streaming import queues as q
from gatelake.streaming import runtime
from gatelake.streaming import telemetry as t
from gatelake.streaming.runtime import run_available, run_batches, run_timers, stream_parquet

T0 = datetime.datetime(2024, 1, 1)
QUEUE = "digest string, entry_id bigint, app string, stg_deploy_time string, observation_minutes int, queued_at timestamp"


def at(**delta):
    return T0 + datetime.timedelta(**delta)


def streamed(spark, tmp_path, rows, schema, name="in"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return stream_parquet(spark, str(tmp_path / name))


def entries(df):
    return q.schedule(df).selectExpr("digest AS key", "due", "fire_at", "queued_at", "app AS payload")


def test_due_and_pending_split_is_complete(spark):
    rows = [("d1", 1, "a", "2024-01-01T00:00:00Z", 30, T0), ("d2", 2, "a", "2024-01-01T11:45:00Z", 30, T0), ("d3", 3, "a", "bad", 30, T0),
            ("d1", 4, "late", "2024-01-01T11:59:00Z", 30, at(hours=1))]
    queue = q.schedule(q.newest_per_digest(spark.createDataFrame(rows, QUEUE)))
    split = q.split_due(queue, "2024-01-01 12:00:00")
    assert {x.digest: x.status for x in split.collect()} == {"d1": "pending", "d2": "pending", "d3": "due"}
    assert split.filter("status = 'due'").count() + split.filter("status = 'pending'").count() == queue.count()


def test_delay_queue_fires_replaces_and_keeps(spark, tmp_path):
    soon = datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(days=2)
    rows = [
        ("past", 1, "old", "2024-01-01T00:00:00Z", 30, T0), ("past", 2, "new", "2024-01-02T00:00:00Z", 30, at(hours=1)),
        ("bad", 3, "x", "NOT-A-DATE", 30, T0), ("future", 4, "y", soon.strftime("%Y-%m-%dT%H:%M:%SZ"), 30, T0),
    ]
    fired = run_timers(q.stream_delayed(entries(streamed(spark, tmp_path, rows, QUEUE))), "delay")
    assert sorted((x.key, x.payload, x.reason) for x in fired.collect()) == [("bad", "x", "unparseable"), ("past", "new", "due")]


def test_a_new_key_asks_the_state_once(spark):
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *given: calls.append(name)

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 1_000

    queue = q.DelayQueue()
    queue.handle = queue.entry = State()
    row = Row("fire_ms", "queued_us", "fire_at", "payload")
    rows = [row(5, 1, "a", "old"), row(7, 3, "b", "new"), row(6, 2, "c", "middle"), row(None, None, "d", "none")]
    fired = [tuple(x) for x in queue.handleInputRows(("k",), iter(rows), Clock())]
    assert fired == [("k", "d", -1, "none", "invalid"), ("k", "b", 3, "new", "due")]
    assert calls == ["get"]


def test_timer_fires_later(spark, tmp_path):
    due = datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(seconds=12)
    rows = [("k", 1, "p", due.strftime("%Y-%m-%dT%H:%M:%SZ"), 0, T0)]
    query = (
        q.stream_delayed(entries(streamed(spark, tmp_path, rows, QUEUE)))
        .writeStream.format("memory").queryName("later").outputMode("append").trigger(processingTime="0 seconds").start()
    )
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("later").count():
            time.sleep(0.5)
        assert [x.key for x in spark.table("later").collect()] == ["k"]
        assert time.time() >= due.timestamp() - 1
    finally:
        query.stop()


def test_repeated_batch_changes_nothing(spark, tmp_path):
    rows = [("d", i, f"a{i}", "x", 30, at(hours=i)) for i in range(4)] + [("e", 9, "z", "x", 30, T0)]
    df = spark.createDataFrame(rows, QUEUE)
    path = str(tmp_path / "queue")
    q.upsert_queue(df.filter("entry_id < 2 OR entry_id = 9"), 0, path, "first")
    q.upsert_queue(df.filter("entry_id >= 2"), 1, path, "first")
    before = sorted(map(tuple, q.read_queue(spark, path).collect()))
    q.upsert_queue(df.filter("entry_id < 2 OR entry_id = 9"), 0, path, "first")
    assert sorted(map(tuple, q.read_queue(spark, path).collect())) == before
    assert {x.digest: x.app for x in q.read_queue(spark, path).collect()} == {"d": "a3", "e": "z"}
    # A stream with a new checkpoint starts at batch 0 again and replaces nothing.
    q.upsert_queue(spark.createDataFrame([("f", 1, "new", "x", 30, T0)], QUEUE), 0, path, "second")
    assert {x.digest for x in q.read_queue(spark, path).collect()} == {"d", "e", "f"}
    before = sorted(map(tuple, q.read_queue(spark, path).collect()))
    q.compact_queue(spark, path, str(tmp_path / "compact"))
    assert sorted(map(tuple, q.read_queue(spark, str(tmp_path / "compact")).collect())) == before


def test_queue_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [(f"d{i % 3}", i, f"a{i}", "x", 30, at(minutes=i)) for i in range(12)]
    path = run_batches(streamed(spark, tmp_path, rows, QUEUE), "queue", q.upsert_queue)
    twin = q.newest_per_digest(spark.createDataFrame(rows, QUEUE))
    assert sorted((x.digest, x.entry_id) for x in q.read_queue(spark, path).collect()) == sorted((x.digest, x.entry_id) for x in twin.collect())


def test_verify_fix_stream(spark, tmp_path):
    fixes = streamed(spark, tmp_path, [(1, "Fixes #7", T0), (2, "closes #8", T0), (3, "none", T0), (9, "fixes #1", at(days=3))],
                     "pr int, body string, deployed_at timestamp", "fixes")
    errors = streamed(spark, tmp_path, [(10, "7", at(minutes=60)), (11, "7", at(minutes=61)), (12, "7", T0), (13, "z", at(days=3))],
                      "event_id int, ref string, ts timestamp", "errors")
    got = {(x.pr, x.event_id) for x in run_available(t.stream_verify_fix(fixes, errors), "fix").collect()}
    assert got == {(1, 10), (2, None)}


def test_first_delivery_wins(spark, tmp_path):
    rows = [(1, "/close", "OWNER", T0), (1, "/close", "OWNER", at(minutes=1)), (2, "/help", "NONE", T0)]
    comments = streamed(spark, tmp_path, rows, "comment_id int, body string, author_assoc string, ts timestamp")
    got = sorted((x.comment_id, x.command) for x in run_available(t.stream_commands(comments), "commands").collect())
    assert got == [(1, "close"), (2, "help")]


@pytest.mark.parametrize(
    "errors,minutes,decision", [(0, 31, "promote"), (0, 5, "extend"), (9, 31, "rollback")]
)
def test_sessions(spark, errors, minutes, decision):
    rows = [("s", at(minutes=minutes * i / 10), int(i < errors)) for i in range(11)]
    df = spark.createDataFrame(rows, "service string, ts timestamp, is_error int")
    row = t.observe_sessions(df, min_events=5).first()
    assert (row.decision, row.total_events) == (decision, 11)


def test_followup_markers(spark):
    body = '<!-- agent-followup:{"due_at":"2024-01-02T00:00:00Z","reason":"r"} -->\ntext'
    df = spark.createDataFrame([(1, body), (2, "no marker"), (3, '<!-- agent-followup:{"due_at":"?"} -->')], "n int, body string")
    got = {x.n: (x.task, x.status) for x in q.due_followups(q.parse_followups(df), "2024-01-01 00:00:00").collect()}
    assert got == {1: ("issue-followup", "pending"), 3: ("issue-followup", "due")}


def test_stale_sweep(spark):
    cases = [
        ("issue", "open", 60, None, None, "mark-stale"), ("issue", "open", 59, None, None, "none"), ("pr", "open", 30, None, None, "mark-stale"),
        ("issue", "open", 80, 14, None, "close"), ("issue", "open", 80, 13, None, "none"), ("pr", "open", 40, 7, None, "close"),
        ("issue", "open", 5, 20, None, "none"), ("pr", "closed", 90, None, 30, "lock"), ("pr", "closed", 90, None, 29, "none"),
    ]
    ago = lambda d: None if d is None else T0 - datetime.timedelta(days=d)
    df = spark.createDataFrame([(i, c[0], c[1], *map(ago, c[2:5])) for i, c in enumerate(cases)],
                               "i int, kind string, state string, last_activity timestamp, stale_since timestamp, closed_at timestamp")
    assert {x.i: x.action for x in q.stale_sweep(df, "2024-01-01 00:00:00").collect()} == {i: c[5] for i, c in enumerate(cases)}


def test_a_part_of_many_rows_is_many_files_of_one_batch(spark, monkeypatch):
    monkeypatch.setattr(runtime, "FILE_ROWS", 10, raising=False)
    rows = [(n, at(days=0)) for n in range(95)] + [(95, at(days=2))] + [(n, at(days=6)) for n in range(96, 110)]
    df = spark.createDataFrame(rows, "n int, ts timestamp")
    turns = runtime.in_turn(df, "ts", 4, "turns", ("2024-01-02", "2024-01-04", "2024-01-06"))
    seen = {}

    def step(batch, batch_id, base, run):
        held = batch.withColumn("file", F.input_file_name()).collect()
        files = Counter(x.file for x in held)
        seen[batch_id] = (sorted(x.n for x in held), len(files) > 5, max(files.values(), default=0) < 20)

    run_batches(turns, "turns-out", step)
    assert seen == {
        0: (list(range(95)), True, True), 1: ([95], False, True), 2: ([], False, True), 3: (list(range(96, 110)), seen[3][1], True),
    }
