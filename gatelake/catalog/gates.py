"""Gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.registry import query
from gatelake.catalog.views import project, view
from gatelake.operators import gates, upkeep

NOW = "2024-02-01 00:00:00"
SLOT_RATES = """
    SELECT service, CAST(ts AS DATE) AS d, hour(ts) // 6 AS slot,
      CAST(sum(is_error) AS DOUBLE) / count(*) AS rate
    FROM v_counts GROUP BY ALL"""


def day_runs(spark, sf):
    """Counts with the calendar day as the run id."""
    return view(spark, sf, "v_counts").withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))


def text_ts(col="window_start"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


ERROR_RATE_SQL = """
    SELECT service, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
      count(*) AS total_events, CAST(sum(is_error) AS BIGINT) AS error_events,
      CASE WHEN count(*) < 60 THEN 0.0 ELSE (sum(is_error) * 10000 // count(*)) / 10000.0 END AS error_rate,
      CAST(0.2 AS DOUBLE) AS threshold,
      count(*) < 60 OR (sum(is_error) * 10000 // count(*)) <= 2000 AS passed
    FROM v_counts GROUP BY 1, 2"""


@query("error_rate_gate", ERROR_RATE_SQL)
def error_rate_gate(spark, sf):
    out = gates.error_rate_gate(view(spark, sf, "v_counts"), 0.1, 2.0, 60, "1 day")
    return out.withColumn("window_start", text_ts())


def slot_rates(spark, sf):
    counts = view(spark, sf, "v_counts")
    return counts.groupBy("service", F.to_date("ts").alias("day"), F.expr("hour(ts) div 6").alias("slot")).agg(
        (F.sum("is_error").cast("double") / F.count(F.lit(1))).alias("rate")
    )


@query(
    "canary_3sigma",
    f"""
    WITH r AS ({SLOT_RATES}),
    h AS (SELECT *, count(rate) OVER w AS n_history, round(avg(rate) OVER w, 6) AS mean,
        round(coalesce(stddev_samp(rate) OVER w, 0), 6) AS sd
      FROM r WINDOW w AS (PARTITION BY service, slot ORDER BY d
        RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT service, strftime(d, '%Y-%m-%d') AS day, slot, round(rate, 9) AS rate, n_history, mean,
      CASE WHEN n_history > 0 THEN sd END AS stddev, round(mean + 3 * sd, 6) AS threshold,
      coalesce(rate > round(mean + 3 * sd, 6), false) AS regression
    FROM h""",
)
def canary_3sigma(spark, sf):
    out = gates.canary_3sigma(slot_rates(spark, sf))
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "rate": F.round("rate", 9)})


PERCENTILES = """
    SELECT service, run_id, max(n) AS n_probes,
      max(CASE WHEN i = n * 50 // 100 THEN ms END) AS p50, max(CASE WHEN i = n * 95 // 100 THEN ms END) AS p95
    FROM (SELECT service, strftime(ts, '%Y-%m-%d') AS run_id,
        CAST(round(latency_s * 1000) AS BIGINT) AS ms,
        row_number() OVER (PARTITION BY service, strftime(ts, '%Y-%m-%d') ORDER BY latency_s) - 1 AS i,
        count(*) OVER (PARTITION BY service, strftime(ts, '%Y-%m-%d')) AS n
      FROM v_counts) GROUP BY 1, 2"""


@query("latency_percentiles", PERCENTILES)
def latency_percentiles(spark, sf):
    return gates.latency_percentiles(day_runs(spark, sf))


@query(
    "perf_regression",
    f"""
    WITH p AS ({PERCENTILES}), b AS (SELECT *, lag(p95) OVER (PARTITION BY service ORDER BY run_id) AS baseline_p95 FROM p)
    SELECT *, coalesce(baseline_p95, 0) = 0 AS first_run,
      CASE WHEN coalesce(baseline_p95, 0) <> 0 THEN round((p95 - baseline_p95) * 100.0 / baseline_p95, 1) END AS regress_percent,
      coalesce(round((p95 - baseline_p95) * 100.0 / nullif(baseline_p95, 0), 1) > 30, false) AS regressed, false AS blocked
    FROM b""",
)
def perf_regression(spark, sf):
    return gates.perf_regression(latency_percentiles(spark, sf))


@query(
    "coverage_gate",
    """
    WITH c AS (SELECT repo, run_id, CASE run_id % 4 WHEN 0 THEN 'pr' WHEN 1 THEN 'stg' WHEN 2 THEN 'prd' ELSE 'dev' END AS mode,
        CASE WHEN run_id % 7 <> 0 THEN round(100.0 * count(*) FILTER (WHERE conclusion = 'success') / count(*), 2) END AS coverage_percent
      FROM v_jobs GROUP BY 1, 2, 3)
    SELECT *, coalesce(coverage_percent >= 50, false) AS passed,
      CASE WHEN coverage_percent IS NULL THEN 'unknown-format' WHEN coverage_percent >= 50 THEN 'ok' WHEN mode = 'pr' THEN 'warning'
        WHEN mode IN ('stg', 'prd') THEN 'blocking' ELSE 'unknown-mode' END AS verdict FROM c""",
)
def coverage_gate(spark, sf):
    mode = F.expr("CASE run_id % 4 WHEN 0 THEN 'pr' WHEN 1 THEN 'stg' WHEN 2 THEN 'prd' ELSE 'dev' END")
    percent = (
        view(spark, sf, "v_jobs")
        .groupBy("repo", "run_id", mode.alias("mode"))
        .agg(F.round(100.0 * F.count_if(F.col("conclusion") == "success") / F.count(F.lit(1)), 2).alias("coverage_percent"))
    )
    # Every seventh run has a report of unknown format.
    known = F.when(F.col("run_id") % 7 != 0, F.col("coverage_percent"))
    return gates.coverage_gate(percent.withColumn("coverage_percent", known), 50)


@query(
    "deploy_window",
    """
    SELECT deploy_id, service, env,
      CASE WHEN env <> 'production' THEN 'not-checked' WHEN isodow(ts) > 5 THEN 'weekend'
        WHEN hour(ts) < 10 OR hour(ts) > 16 THEN 'hour' ELSE 'ok' END AS window_reason,
      env <> 'production' OR (isodow(ts) <= 5 AND hour(ts) BETWEEN 10 AND 16) AS in_window
    FROM v_deploys""",
)
def deploy_window(spark, sf):
    out = gates.deploy_window(view(spark, sf, "v_deploys"))
    return out.select("deploy_id", "service", "env", "window_reason", "in_window")


@query(
    "observation_window",
    """
    WITH e AS (SELECT entry_id, stg_deploy_time, observation_minutes,
        CAST(epoch(TIMESTAMP '1998-01-01 00:00:00' - try_strptime(stg_deploy_time, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) // 60 AS elapsed_min
      FROM v_queue)
    SELECT *, CASE WHEN elapsed_min IS NULL THEN 'error' WHEN elapsed_min < observation_minutes THEN 'too-early'
      ELSE 'ok' END AS observation FROM e""",
)
def observation_window(spark, sf):
    staged = view(spark, sf, "v_queue").select("entry_id", "stg_deploy_time", "observation_minutes")
    return gates.observation_window(staged, "1998-01-01 00:00:00")


LATEST = """
    l AS (SELECT service, arg_max(digest, (ts, deploy_id)) FILTER (WHERE env = 'staging') AS stg_digest,
        max(ts) FILTER (WHERE env = 'staging') AS stg_ts,
        arg_max(digest, (ts, deploy_id)) FILTER (WHERE env = 'production') AS prd_digest,
        max(ts) FILTER (WHERE env = 'production') AS prd_ts
      FROM v_deploys GROUP BY 1)"""


@query(
    "version_alignment",
    f"WITH {LATEST} SELECT service, stg_digest, prd_digest, stg_digest IS NOT DISTINCT FROM prd_digest AS aligned FROM l",
)
def version_alignment(spark, sf):
    return gates.version_alignment(view(spark, sf, "v_deploys")).drop("stg_ts", "prd_ts")


@query(
    "precheck",
    f"""
    WITH {LATEST}, g AS (SELECT service, CAST(sum(is_error) AS BIGINT) * 10000 // count(*) <= 2000 AS p FROM v_counts
      GROUP BY 1), g2 AS (SELECT CASE service WHEN 'svc-3' THEN 'svc-9' ELSE service END AS service, p FROM g)
    SELECT l.service, stg_digest, prd_digest, stg_digest IS NOT DISTINCT FROM prd_digest AS aligned,
      coalesce(epoch(TIMESTAMP '{NOW}' - stg_ts) // 60 >= 3000, false) AS observed, p AS rate_passed, p IS NULL AS rate_skipped,
      stg_digest IS NOT DISTINCT FROM prd_digest AND coalesce(epoch(TIMESTAMP '{NOW}' - stg_ts) // 60 >= 3000, false)
        AND coalesce(p, true) AS ready
    FROM l LEFT JOIN g2 USING (service)""",
)
def precheck(spark, sf):
    """One service reports its telemetry under another name, so its rate is skipped."""
    counts = view(spark, sf, "v_counts").replace("svc-3", "svc-9", ["service"])
    totals = counts.groupBy("service").agg(
        F.count(F.lit(1)).alias("total_events"), F.sum(F.col("is_error").cast("bigint")).alias("error_events")
    )
    rate = gates.error_rate_gate_from_counts(totals, 0.1, 2.0, 1)
    return gates.precheck(view(spark, sf, "v_deploys"), rate, NOW, 3000).drop("stg_ts", "prd_ts")


def _gate_columns() -> str:
    cols = []
    for g in gates.PULL_REQUEST_GATES:
        raw = f"coalesce((max({{'s': started_at, 'c': conclusion}}) FILTER (WHERE job = '{g}'))['c'], 'skipped')"
        cols += [f"{raw} AS {g}_result", f"{raw} = 'success' AS {g}_passed"]
    return ", ".join(cols)


MATRIX = f"SELECT repo, run_id, {_gate_columns()} FROM v_jobs GROUP BY 1, 2"


@query("gate_matrix", MATRIX)
def gate_matrix(spark, sf):
    return gates.gate_matrix(view(spark, sf, "v_jobs"))


@query(
    "gate_totals",
    f"""
    WITH m AS ({MATRIX})
    SELECT coalesce(repo, 'ALL') AS repo, count(*) AS runs, """
    + ", ".join(f"count(*) FILTER (WHERE {g}_passed) AS {g}_passed" for g in gates.PULL_REQUEST_GATES)
    + " FROM m GROUP BY ROLLUP (repo)",
)
def gate_totals(spark, sf):
    return gates.gate_totals(gate_matrix(spark, sf))


CVE = """
    cve AS (SELECT repo, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
      count(*) FILTER (WHERE severity = 'HIGH') AS high_count FROM v_findings GROUP BY 1)"""


def some_repos_critical(spark, sf):
    """Counts by repository, with the critical count kept only where it is high."""
    found = upkeep.cve_counts(view(spark, sf, "v_findings"))
    return found.withColumn(
        "critical_count", F.when(F.col("critical_count") * 6 > F.col("high_count") * 2, F.col("critical_count")).otherwise(0)
    )


SOME_CRITICAL = """
    partly AS (SELECT repo, high_count, CASE WHEN critical_count * 6 > high_count * 2 THEN critical_count ELSE 0 END AS critical_count FROM cve)"""


@query(
    "deploy_readiness",
    f"""
    WITH {CVE}, {SOME_CRITICAL}, r AS (SELECT repo, run_id,
        coalesce(bool_or(job = 'build' AND conclusion = 'failure'), false) AS sign_failed,
        coalesce(bool_or(job = 'scan_deps' AND conclusion = 'failure'), false) AS pins_failed FROM v_jobs GROUP BY 1, 2)
    SELECT repo, run_id, sign_failed, pins_failed, coalesce(critical_count, 0) > 0 OR sign_failed AS blocked,
      coalesce(critical_count, 0) > 0 OR sign_failed OR pins_failed AS failed,
      NOT (coalesce(critical_count, 0) > 0 OR sign_failed) AS ready
    FROM r LEFT JOIN partly USING (repo)""",
)
def deploy_readiness(spark, sf):
    return gates.deploy_readiness(
        view(spark, sf, "v_jobs"), some_repos_critical(spark, sf), sign_job="build", pin_job="scan_deps"
    )


@query(
    "failure_classes",
    f"""
    WITH {CVE}, {SOME_CRITICAL}, r AS (SELECT repo, run_id,
        coalesce(bool_or(job = 'build' AND conclusion = 'failure'), false) AS b,
        coalesce(bool_or(job = 'scan_secrets' AND conclusion = 'failure'), false) AS p,
        coalesce(bool_or(job = 'coverage' AND conclusion = 'failure'), false) AS m,
        coalesce(bool_or(job = 'test' AND conclusion = 'failure'), false) AS s FROM v_jobs GROUP BY 1, 2),
    c AS (SELECT repo, run_id, list_filter([CASE WHEN coalesce(critical_count, 0) > 0 OR p THEN 'security' END,
        CASE WHEN b THEN 'build' END, CASE WHEN m THEN 'migration' END, CASE WHEN s THEN 'smoke' END,
        CASE WHEN coalesce(high_count, 0) > 0 AND coalesce(critical_count, 0) = 0 THEN 'advisory' END],
        lambda x: x IS NOT NULL) AS cl FROM r LEFT JOIN partly USING (repo))
    SELECT repo, run_id, array_to_string(cl, ',') AS classes, cl[1] AS primary_class,
      CASE cl[1] """
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in gates.FAILURE_ACTIONS.items())
    + " END AS action FROM c WHERE len(cl) > 0",
)
def failure_classes(spark, sf):
    return gates.failure_classes(
        view(spark, sf, "v_jobs"),
        some_repos_critical(spark, sf),
        {"pins": "scan_secrets", "migration": "coverage", "smoke": "test"},
    )


METRICS = """
    m AS (SELECT service, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_end, name,
        CAST(count(*) AS DOUBLE) AS value
      FROM (SELECT service, ts, concat('event_', category, '_count') AS name FROM v_counts) GROUP BY 1, 2, 3)"""
THRESHOLDS = [
    ("event_purchase_count", 1.0, 0.5, "low"),
    ("event_error_count", 1.0, 3.0, "high"),
    ("event_click_count", 2.0, 4.0, "high"),
]
BREACHES = f"""
    {METRICS}, t(name, warning, critical, direction) AS (VALUES ('event_purchase_count', 1.0, 0.5, 'low'),
      ('event_error_count', 1.0, 3.0, 'high'), ('event_click_count', 2.0, 4.0, 'high')),
    e AS (SELECT service, window_end, name,
        CASE WHEN (direction = 'low' AND value <= critical) OR (direction = 'high' AND value >= critical) THEN 2
          WHEN (direction = 'low' AND value <= warning) OR (direction = 'high' AND value >= warning) THEN 1 ELSE 0 END AS rank
      FROM m JOIN t USING (name)),
    w AS (SELECT service, window_end, count(*) AS checked, count(*) FILTER (WHERE rank > 0) AS violations,
        max(rank) AS max_rank, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE rank > 0), '') AS violated
      FROM e GROUP BY 1, 2)"""


def hourly_metrics(spark, sf):
    return (
        view(spark, sf, "v_counts")
        .groupBy(
            "service",
            F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("window_end"),
            F.concat(F.lit("event_"), "category", F.lit("_count")).alias("name"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


@query("evaluate_thresholds", f"WITH {BREACHES} SELECT * FROM w")
def evaluate_thresholds(spark, sf):
    limits = spark.createDataFrame(THRESHOLDS, "name string, warning double, critical double, direction string")
    return gates.evaluate_thresholds(hourly_metrics(spark, sf), limits)


@query(
    "service_state",
    f"""
    WITH {BREACHES} SELECT service, CASE max(max_rank) WHEN 2 THEN 'critical' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS state,
      CAST(sum(violations) AS BIGINT) AS violations, count(*) AS windows FROM w GROUP BY 1""",
)
def service_state(spark, sf):
    return gates.service_state(evaluate_thresholds(spark, sf))


@query(
    "log_slo",
    """
    WITH q AS (SELECT category AS prefix, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
        CASE WHEN attempt > 8 THEN 500 ELSE 200 END AS status, latency_s * 1000 AS duration_ms FROM v_counts)
    SELECT prefix, window_start, 'error_rate' AS name, round(count(*) FILTER (WHERE status >= 500) / count(*), 6) AS value FROM q GROUP BY 1, 2
    UNION ALL
    SELECT prefix, window_start, 'p99_ms', round(quantile_cont(duration_ms, 0.99), 6) FROM q GROUP BY 1, 2""",
)
def log_slo(spark, sf):
    requests = view(spark, sf, "v_counts").select(
        F.col("category").alias("prefix"),
        "ts",
        F.when(F.col("attempt") > 8, 500).otherwise(200).alias("status"),
        (F.col("latency_s") * 1000).alias("duration_ms"),
    )
    return gates.log_slo(requests, "6 hours").select("prefix", text_ts(), "name", F.round("value", 6).alias("value"))


@query(
    "probe_summary",
    """
    WITH p AS (SELECT service, strftime(ts, '%Y-%m-%d') AS run_id, event_id, attempt,
        CASE category WHEN 'view' THEN 204 WHEN 'click' THEN 301 WHEN 'purchase' THEN 201 ELSE http_code END AS http_code, latency_s * 50 AS s FROM v_counts),
    a AS (SELECT service, run_id, count(*) AS attempts, coalesce(bool_or(http_code = 200 AND attempt <= 5), false) AS passed,
        min(attempt) FILTER (WHERE http_code = 200 AND attempt <= 5) AS passed_on,
        arg_min(http_code, (attempt, event_id)) = 200 AS first_try_pass,
        arg_min(s, (attempt, event_id)) FILTER (WHERE http_code BETWEEN 200 AND 299 AND attempt <= 5) AS hit
      FROM p GROUP BY 1, 2)
    SELECT service, run_id, attempts, passed, passed_on, first_try_pass,
      CASE WHEN hit IS NULL THEN 'fail' WHEN hit < 0.5 THEN 'pass' WHEN hit < 1.5 THEN 'warn' ELSE 'fail' END AS grade FROM a""",
)
def probe_summary(spark, sf):
    code = F.expr("CASE category WHEN 'view' THEN 204 WHEN 'click' THEN 301 WHEN 'purchase' THEN 201 ELSE http_code END")
    probes = day_runs(spark, sf).withColumns({"latency_s": F.col("latency_s") * 50, "probe_id": F.col("event_id"), "http_code": code})
    return gates.probe_summary(probes, 5, 0.5, 1.5)


@query(
    "eval_metrics",
    """
    WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, concat(service, '/', category) AS name, attempt, value > 20 AS passed
      FROM (SELECT *, latency_s * 1000 AS value FROM v_counts)),
    f AS (SELECT run_id, name, attempt, bool_and(passed) AS passed, count(*) AS n, count(*) FILTER (WHERE passed) AS n_pass FROM c GROUP BY 1, 2, 3),
    k AS (SELECT run_id, name, bool_or(n_pass > 0) AS any_pass, bool_and(passed) AS all_pass,
        coalesce(bool_or(n_pass > 0 AND attempt <= 3), false) AS pass_k, arg_min(passed, attempt) AS first,
        sum(n) AS n, sum(n_pass) AS n_pass FROM f GROUP BY 1, 2)
    SELECT run_id, count(*) AS checks, round(sum(n_pass) / sum(n), 6) AS pass_rate,
      count(*) FILTER (WHERE any_pass AND NOT all_pass) AS flaky_count, count(*) FILTER (WHERE first) AS first_try_pass,
      round(count(*) FILTER (WHERE pass_k) / count(*), 6) AS pass_at_k FROM k GROUP BY 1""",
)
def eval_metrics(spark, sf):
    checks = day_runs(spark, sf).select(
        "run_id",
        F.concat("service", F.lit("/"), "category").alias("name"),
        "attempt",
        (F.col("latency_s") * 1000 > 20).alias("passed"),
    )
    return gates.eval_metrics(checks)


LOG_RULES = " ".join(
    "WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{cat}'"
    for cat, words in {
        **gates.LOG_KEYWORDS,
    }.items()
)


@query(
    "classify_logs",
    f"SELECT conv_id, turn, CASE {LOG_RULES} ELSE 'unknown' END AS category FROM (SELECT conv_id, turn, lower(body) AS t FROM v_comments)",
)
def classify_logs(spark, sf):
    return gates.classify_logs(view(spark, sf, "v_comments"), "body").select("conv_id", "turn", "category")


@query(
    "flaky_steps",
    """
    WITH d AS (SELECT repo, job, CAST(started_at AS DATE) AS day, count(*) FILTER (WHERE conclusion = 'success') AS p,
        count(*) FILTER (WHERE conclusion = 'failure') AS f FROM v_jobs GROUP BY 1, 2, 3),
    w AS (SELECT repo, job, day, CAST(sum(p) OVER r AS BIGINT) AS recent_passes, CAST(sum(f) OVER r AS BIGINT) AS recent_failures,
        CAST(0 AS BIGINT) AS recent_timeouts, coalesce(lag(f > p) OVER o <> (f > p), false) AS flipped FROM d
      WINDOW r AS (PARTITION BY repo, job ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
        o AS (PARTITION BY repo, job ORDER BY day))
    SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM w WHERE recent_passes > 0 AND recent_failures > 0""",
)
def flaky_steps(spark, sf):
    return gates.flaky_steps(view(spark, sf, "v_jobs")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


STEP_RESULTS = """
    SELECT concat('repo-', l_suppkey % 20) AS repo, concat('job-', l_linenumber % 4) AS job, concat('step-', l_partkey % 3) AS step, l_orderkey * 10 + l_linenumber AS run_id,
      l_shipdate AS started_at, CASE WHEN l_partkey % 3 = 2 AND l_suppkey % 20 = 3 THEN 'timed_out' WHEN l_returnflag = 'R' THEN CASE l_partkey % 7 WHEN 0 THEN 'timed_out' ELSE 'failure' END
        WHEN l_returnflag = 'A' OR l_quantity > 25 THEN 'success' ELSE 'skipped' END AS conclusion
    FROM {lineitem}"""


@query(
    "flaky_runs",
    f"""
    WITH s AS (SELECT * FROM ({STEP_RESULTS.replace("{lineitem}", "lineitem")}) WHERE conclusion <> 'skipped'),
    c AS (SELECT *, coalesce(CAST((lag(conclusion = 'success') OVER k <> (conclusion = 'success')) AS BIGINT), 0) AS changed FROM s
      WINDOW k AS (PARTITION BY repo, job, step ORDER BY started_at, run_id)),
    j AS (SELECT *, count(*) FILTER (WHERE conclusion = 'success') OVER f AS passes, count(*) FILTER (WHERE conclusion = 'failure') OVER f AS failures,
        count(*) FILTER (WHERE conclusion = 'timed_out') OVER f AS timeouts, CAST(sum(changed) OVER p AS BIGINT) AS flips FROM c
      WINDOW f AS (PARTITION BY repo, job, step ORDER BY started_at, run_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
        p AS (PARTITION BY repo, job, step ORDER BY started_at, run_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
    SELECT repo, job, step, run_id, strftime(started_at, '%Y-%m-%d') AS started_at, passes, failures, timeouts, flips,
      CASE WHEN passes > 0 AND failures > 0 THEN 'mixed' ELSE 'timeout' END AS reason FROM j WHERE (passes > 0 AND failures > 0) OR timeouts > 0""",
)
def flaky_runs(spark, sf):
    return gates.flaky_runs(project(spark, sf, STEP_RESULTS)).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd"))


@query(
    "infra_drift",
    """
    WITH r AS (SELECT concat('infra/', user_id) AS directory, ts, event_id AS run_id, event_id % 4 AS exit_code FROM v_counts)
    SELECT directory, arg_max(run_id, (ts, run_id)) AS run_id,
      CASE arg_max(exit_code, (ts, run_id)) WHEN 0 THEN 'false' WHEN 2 THEN 'true' ELSE 'unknown' END AS drift FROM r GROUP BY 1""",
)
def infra_drift(spark, sf):
    runs = view(spark, sf, "v_counts").select(
        F.concat(F.lit("infra/"), "user_id").alias("directory"),
        "ts",
        F.col("event_id").alias("run_id"),
        (F.col("event_id") % 4).alias("exit_code"),
    )
    return gates.infra_drift(runs)


@query(
    "agent_findings_rollup",
    """
    WITH f AS (SELECT concat('L', attempt % 4 + 1) AS level,
        CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
        category, concat('/r/', user_id) AS route, http_code = 200 AS tested FROM v_counts)
    SELECT coalesce(level, 'ALL') AS level, coalesce(severity, 'ALL') AS severity, count(*) AS findings,
      count(DISTINCT category) AS categories, count(DISTINCT route) FILTER (WHERE tested) AS routes_tested,
      count(DISTINCT route) AS routes_total FROM f GROUP BY ROLLUP (level, severity)""",
)
def agent_findings_rollup(spark, sf):
    findings = view(spark, sf, "v_counts").select(
        F.concat(F.lit("L"), F.col("attempt") % 4 + 1).alias("level"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END").alias("severity"),
        "category",
        F.concat(F.lit("/r/"), "user_id").alias("route"),
        (F.col("http_code") == 200).alias("tested"),
    )
    return gates.agent_findings_rollup(findings)


@query(
    "superseded_runs",
    """
    WITH r AS (SELECT concurrency_group, run_id, min(started_at) AS started_at, max(ended_at) AS ended_at FROM v_jobs GROUP BY 1, 2),
    n AS (SELECT *, lead(started_at) OVER (PARTITION BY concurrency_group ORDER BY started_at, run_id) AS nx FROM r)
    SELECT concurrency_group, run_id, strftime(started_at, '%Y-%m-%d') AS started_at, coalesce(nx < ended_at, false) AS superseded FROM n""",
)
def superseded_runs(spark, sf):
    out = gates.superseded_runs(view(spark, sf, "v_jobs"))
    return out.select("concurrency_group", "run_id", F.date_format("started_at", "yyyy-MM-dd").alias("started_at"), "superseded")
