"""The queue table: nothing is lost or fired twice, wherever a change dies."""

import datetime

import pytest

from gatelake.streaming import queue_table as t
from gatelake.streaming.runtime import in_turn, run_batches

T0 = datetime.datetime(2024, 1, 1)
REQUEST = "digest string, entry_id bigint, app string, stg_deploy_time string, observation_minutes int, queued_at timestamp"


def request(digest, entry, hours=0, staged="2024-01-01T00:00:00Z", minutes=30):
    return (digest, entry, f"app{entry}", staged, minutes, T0 + datetime.timedelta(hours=hours))


def add(spark, base, rows, batch_id, run="r"):
    t.add_requests(spark.createDataFrame(rows, REQUEST), batch_id, base, run)


def left(spark, base):
    return sorted((r.digest, r.entry_id) for r in t.waiting(spark, base).collect())


def out(frame):
    return sorted((r.digest, r.entry_id) for r in frame.collect())


def test_due_entries_fire_and_the_rest_is_written_back(spark, tmp_path):
    base = str(tmp_path / "q")
    add(spark, base, [request("due", 1), request("wait", 2, staged="2099-01-01T00:00:00Z"), request("bad", 3, staged="NOT-A-DATE")], 0)
    assert out(t.poll(spark, base, "2024-01-01 12:00:00", "p1")) == [("bad", 3), ("due", 1)]
    assert left(spark, base) == [("wait", 2)]
    # The same poll again fires nothing new, another one finds nothing.
    assert out(t.poll(spark, base, "2024-01-01 12:00:00", "p1")) == [("bad", 3), ("due", 1)]
    assert out(t.poll(spark, base, "2024-01-01 12:00:00", "p2")) == []
    assert out(t.fired(spark, base)) == [("bad", 3), ("due", 1)]


def test_a_newer_request_replaces_and_may_fire_again(spark, tmp_path):
    base = str(tmp_path / "q")
    add(spark, base, [request("d", 1, staged="2099-01-01T00:00:00Z"), request("d", 2, 1), (None, 9, "x", "x", 1, T0), ("n", 9, "x", "x", 1, None)], 0)
    assert left(spark, base) == [("d", 2)]
    assert out(t.poll(spark, base, "2024-01-02 00:00:00", "p1")) == [("d", 2)]
    add(spark, base, [request("d", 1)], 1)  # told again later, but older than what has fired
    assert left(spark, base) == [] and out(t.poll(spark, base, "2024-01-02 00:00:00", "p2")) == []
    add(spark, base, [request("d", 4, 5)], 2)
    assert out(t.poll(spark, base, "2024-01-02 00:00:00", "p3")) == [("d", 4)]


def test_replays_change_nothing_even_after_compaction(spark, tmp_path):
    base = str(tmp_path / "q")
    first = [request("a", 1), request("b", 2, staged="2099-01-01T00:00:00Z")]
    add(spark, base, first, 0)
    t.poll(spark, base, "2024-01-02 00:00:00", "p1")
    t.compact(spark, base, keep_hours=0)
    add(spark, base, first, 0)
    add(spark, base, first, 0, "another stream")  # refused: older than what is remembered
    assert left(spark, base) == [("b", 2)] and out(t.poll(spark, base, "2024-01-02 00:00:00", "p2")) == []
    add(spark, base, [request("a", 7, 3)], 1)
    assert left(spark, base) == [("a", 7), ("b", 2)]


def test_reading_costs_what_is_waiting(spark, tmp_path):
    base = str(tmp_path / "q")
    for i in range(4):
        add(spark, base, [request(f"d{i}-{k}", i * 10 + k, i) for k in range(5)] + [request(f"w{i}", 100 + i, i, "2099-01-01T00:00:00Z")], i)
        t.poll(spark, base, "2024-06-01 00:00:00", f"p{i}")
        t.compact(spark, base, keep_hours=0)
        now = t.read_manifest(spark, base)
        assert len(now.live) == 1 and spark.read.parquet(f"{base}/log/{now.live[0]}").count() == i + 1
    assert t.fired(spark, base).count() == 20 and len(left(spark, base)) == 4
    assert t.vacuum(spark, base) > 0 and t.vacuum(spark, base) == 0
    assert t.fired(spark, base).count() == 20 and len(left(spark, base)) == 4


@pytest.mark.parametrize("dies", ["before any write", "after the folder", "before the renaming", "after the renaming"])
@pytest.mark.parametrize("change", ["add", "poll", "compact"])
def test_a_crash_between_any_two_writes_loses_nothing(spark, tmp_path, monkeypatch, change, dies):
    base = str(tmp_path / "q")
    add(spark, base, [request("a", 1), request("b", 2, staged="2099-01-01T00:00:00Z")], 0)
    run = {
        "add": lambda: add(spark, base, [request("c", 3, 1), request("b", 4, 2)], 1),
        "poll": lambda: t.poll(spark, base, "2024-06-01 00:00:00", "p"),
        "compact": lambda: t.compact(spark, base),
    }[change]

    class Dead(Exception):
        pass

    def die(*args, **more):
        raise Dead

    with monkeypatch.context() as m:
        publish, files = t._publish, t._files
        if dies == "before any write":
            m.setattr(t, "_newest", die)
        elif dies == "after the folder":
            m.setattr(t, "_publish", die)
        elif dies == "before the renaming":
            m.setattr(t, "_files", lambda spark, path: die() if "draft" in path else files(spark, path))
        else:
            m.setattr(t, "_publish", lambda *a: (publish(*a), die()))
        with pytest.raises(Dead):
            run()
    run()  # what any job does after a restart
    t.poll(spark, base, "2024-06-01 00:00:00", "last")
    t.compact(spark, base)
    got = out(t.fired(spark, base)), left(spark, base)
    if change == "add":
        assert got == ([("a", 1), ("b", 4), ("c", 3)], [])
    else:
        assert got == ([("a", 1)], [("b", 2)])


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    base = str(tmp_path / "q")
    add(spark, base, [request("a", 1)], 0)
    now = t.read_manifest(spark, base)
    with pytest.raises(RuntimeError):
        t._publish(spark, base, now)


def test_stream_of_requests(spark, tmp_path):
    rows = [request(f"d{i % 4}", i, i) for i in range(12)]
    base = run_batches(in_turn(spark.createDataFrame(rows, REQUEST), "queued_at", 3, "requests"), "queue", t.add_requests)
    assert left(spark, base) == [("d0", 8), ("d1", 9), ("d2", 10), ("d3", 11)]
    assert len(t.read_manifest(spark, base).batches) == 1
