import datetime
import random

import pytest
from pyspark.sql import functions as F

from gatelake.functions.order_stats import nearest_rank, ranked_values
from gatelake.functions.timeline import count_in_range, lead_in_time, probe_timeline
from gatelake.operators import gates


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize(
    "total,errors,baseline,multiplier,passed,rate",
    [
        (10000, 10, 0.005, 2.0, True, 0.001),
        (10000, 500, 0.005, 2.0, False, 0.05),
        (50, 10, 0.005, 2.0, True, 0.0),
        (0, 0, 0.005, 2.0, True, 0.0),
        (10000, 500, 0.001, 100, True, 0.05),
        (10000, 100, 0.005, 2.0, True, 0.01),
        (10000, 29, 0.005, 2.0, True, 0.0029),
        (30000, 89, 0.005, 2.0, True, 0.0029),
    ],
)
def test_error_rate(spark, total, errors, baseline, multiplier, passed, rate):
    df = spark.createDataFrame([(total, errors)], "total_events bigint, error_events bigint")
    row = one(gates.error_rate_gate_from_counts(df, baseline, multiplier))
    assert (row.passed, row.error_rate) == (passed, rate)


def rates(spark, values, current):
    day = datetime.date(2024, 1, 1)
    rows = [("s", day + datetime.timedelta(i), 0, v) for i, v in enumerate(values)]
    rows.append(("s", day + datetime.timedelta(len(values)), 0, current))
    return spark.createDataFrame(rows, "service string, day date, slot int, rate double"), len(values)


@pytest.mark.parametrize("current,regression", [(0.006, False), (0.10, True)])
def test_canary(spark, current, regression):
    df, last = rates(spark, [0.005, 0.006, 0.005, 0.007, 0.006, 0.005, 0.006], current)
    row = gates.canary_3sigma(df).orderBy("day").collect()[last]
    assert row.regression is regression
    assert (row.mean, row.stddev) == (0.005714, 0.000756)


def test_canary_without_history_passes(spark):
    df, _ = rates(spark, [], 0.5)
    row = one(gates.canary_3sigma(df))
    assert row.regression is False and row.mean is None


def test_canary_missing_day_is_not_replaced(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("s", day, 0, 0.9), ("s", day + datetime.timedelta(8), 0, 0.1)]
    df = spark.createDataFrame(rows, "service string, day date, slot int, rate double")
    assert gates.canary_3sigma(df).orderBy("day").collect()[1].n_history == 0


def test_later_history_never_changes_verdicts(spark):
    rnd = random.Random(3)
    df, n = rates(spark, [rnd.random() / 100 for _ in range(20)], 0.5)
    cut = datetime.date(2024, 1, 12)
    full = gates.canary_3sigma(df).filter(F.col("day") <= cut)
    part = gates.canary_3sigma(df.filter(F.col("day") <= cut))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, part.collect()))


def test_nearest_rank_is_not_percentile_disc(spark):
    df = spark.range(20).select(F.lit("s").alias("service"), F.lit("r").alias("run_id"), (F.col("id") / 1000).alias("latency_s"))
    row = one(gates.latency_percentiles(df))
    assert (row.p50, row.p95, row.n_probes) == (10, 19, 20)


def test_failed_probe_counts_as_ten_seconds(spark):
    df = spark.createDataFrame([("s", "r", None)], "service string, run_id string, latency_s double")
    assert one(gates.latency_percentiles(df)).p95 == 9999


def test_order_statistics_on_a_hot_group(spark):
    rnd = random.Random(5)
    data = {"hot": [rnd.choice([1.0, 1.0, 2.5]) for _ in range(3000)], "cold": [rnd.uniform(-50, 50) for _ in range(101)]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r.p for r in ranked_values(df, ["k"], "v", {"p": nearest_rank(95)}).collect()}
    assert got == {k: sorted(vs)[len(vs) * 95 // 100] for k, vs in data.items()}


def test_perf_regression(spark):
    df = spark.createDataFrame(
        [("s", 1, 1, 100), ("s", 2, 1, 130), ("s", 3, 1, 170), ("s", 4, 1, 170)],
        "service string, run_id int, p50 bigint, p95 bigint",
    )
    rows = gates.perf_regression(df).orderBy("run_id").collect()
    assert [r.first_run for r in rows] == [True, False, False, False]
    assert [r.regress_percent for r in rows] == [None, 30.0, 30.8, 0.0]
    assert [r.regressed for r in rows] == [False, False, True, False]


@pytest.mark.parametrize(
    "ts,env,ok",
    [
        ("2024-01-03 10:00:00", "production", True),
        ("2024-01-03 16:59:00", "production", True),
        ("2024-01-03 17:00:00", "production", False),
        ("2024-01-03 09:59:00", "production", False),
        ("2024-01-06 12:00:00", "production", False),
        ("2024-01-06 12:00:00", "staging", True),
    ],
)
def test_deploy_window(spark, ts, env, ok):
    df = spark.sql(f"SELECT timestamp'{ts}' AS ts, '{env}' AS env")
    assert one(gates.deploy_window(df)).in_window is ok


@pytest.mark.parametrize(
    "staged,minutes,verdict",
    [
        ("2024-01-01T11:25:00Z", 30, "ok"),
        ("2024-01-01T11:55:00Z", 30, "too-early"),
        ("2024-01-01T12:00:00Z", 0, "ok"),
        ("not-a-date", 30, "error"),
    ],
)
def test_observation_window(spark, staged, minutes, verdict):
    df = spark.createDataFrame([(staged, minutes)], "stg_deploy_time string, observation_minutes int")
    assert one(gates.observation_window(df, "2024-01-01 12:00:00")).observation == verdict


@pytest.mark.parametrize(
    "mode,pct,verdict",
    [("pr", 75.0, "warning"), ("stg", 75.0, "blocking"), ("prd", 75.0, "blocking"), ("dev", 75.0, "unknown-mode"), ("prd", 80.0, "ok")],
)
def test_coverage_gate(spark, mode, pct, verdict):
    df = spark.createDataFrame([(mode, pct)], "mode string, coverage_percent double")
    assert one(gates.coverage_gate(df)).verdict == verdict


def test_timeline_against_brute_force(spark):
    rnd = random.Random(7)
    points = [("a" if rnd.random() < 0.7 else "b", rnd.randrange(0, 4000)) for _ in range(800)]
    queries = [(i, rnd.choice("abc"), t := rnd.randrange(-100, 4000), t + rnd.randrange(0, 900)) for i in range(200)]
    p = spark.createDataFrame(points, "k string, t bigint").withColumn("n", F.lit(1))
    q = spark.createDataFrame(queries, "i int, k string, lo bigint, hi bigint")
    got = {r.i: r.n_points for r in count_in_range(p, q, ["k"], "lo", "hi", bucket_us=250).collect()}
    assert got == {i: sum(pk == k and lo < t <= hi for pk, t in points) for i, k, lo, hi in queries}
    last = probe_timeline(p, q.select("k", F.col("hi").alias("t")), ["k"], bucket_us=250)
    for r in last.collect():
        assert r.last_t == max((t for k, t in points if k == r.k and t <= r.t), default=None)


def test_lead_crosses_buckets(spark):
    rows = [("a", 1, 10), ("a", 2, 10), ("a", 3, 990), ("a", 4, 5000), ("b", 5, 7)]
    df = spark.createDataFrame(rows, "k string, i int, t bigint")
    got = {r.i: r.nxt for r in lead_in_time(df, ["k"], "t", "nxt", bucket_us=100, unit=F.col("i")).collect()}
    assert got == {1: 10, 2: 990, 3: 5000, 4: None, 5: None}


def test_probes_are_graded_on_any_2xx(spark):
    rows = [("a", "r", 1, 1, 204, 3.0), ("a", "r", 2, 2, 200, 40.0), ("b", "r", 1, 3, 301, 1.0), ("b", "r", 2, 4, 202, 9.0), ("c", "r", 1, 5, 500, 1.0),
            ("d", "r", 11, 6, 200, 1.0)]
    df = spark.createDataFrame(rows, "service string, run_id string, attempt int, probe_id int, http_code int, latency_s double")
    got = {r.service: (r.passed, r.grade) for r in gates.probe_summary(df).collect()}
    assert got == {"a": (True, "pass"), "b": (False, "warn"), "c": (False, "fail"), "d": (False, "fail")}


@pytest.mark.parametrize("last, piece", [(4, 4), (4, 7), (10, 10_000), (1, 3), (2, 2)])
def test_flaky_runs_look_at_the_last_results_in_run_order(spark, last, piece):
    draw = random.Random(last * piece)
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for key, choices in (("a", ["success"] * 4 + ["failure", "timed_out", "skipped"]), ("hot", ["success"] * 9 + ["failure"]), ("slow", ["timed_out"]), (None, ["success", "failure"]), ("ok", ["success"])):
        for run in range(60):
            at = t0 + datetime.timedelta(minutes=draw.choice([0, 0, 30, 61, 200, 2000]) * (key != "hot") + run // 5)
            rows.append(("r", key, "s", run, at, draw.choice(choices)))
    rows.append(("r", "a", "s", 99, None, "failure"))
    df = spark.createDataFrame(rows, "repo string, job string, step string, run_id int, started_at timestamp, conclusion string").repartition(5)
    got = {(r.job, r.run_id): (r.passes, r.failures, r.timeouts, r.flips, r.reason) for r in gates.flaky_runs(df, last, piece).collect()}
    want = {}
    for key in ("a", "hot", "slow", None, "ok"):
        own = sorted((r for r in rows if r[1] == key and r[4] and r[5] != "skipped"), key=lambda r: (r[4], r[3]))
        for i in range(len(own)):
            seen = [r[5] for r in own[max(0, i - last + 1) : i + 1]]
            p, f, t = (seen.count(c) for c in ("success", "failure", "timed_out"))
            flips = sum((x == "success") != (y == "success") for x, y in zip(seen, seen[1:], strict=False))
            if (p and f) or t:
                want[key, own[i][3]] = (p, f, t, flips, "mixed" if p and f else "timeout")
    assert got == want and (last == 1 or any(k[0] == "slow" for k in got))
