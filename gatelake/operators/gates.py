"""Promotion gates: each is evaluated for every service, run or window at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions.order_stats import nearest_rank, ranked_values
from gatelake.functions.timeline import in_pieces, lead_in_time, micros

# Fixed values -------------------------------------------------------------
PULL_REQUEST_GATES = ("lint", "test", "coverage", "scan_secrets", "validate_pr_title", "scan_deps")
FAILED_PROBE_SECONDS = 9.999
FAILURE_CLASS_ORDER = ("security", "build", "migration", "smoke", "advisory")
FAILURE_ACTIONS = {
    "security": "create issue (security, priority:critical)",
    "build": "create issue (ci-failure)",
    "migration": "create issue (ci-failure, database)",
    "smoke": "create issue (ci-failure, quality)",
    "advisory": "create advisory issue (security, priority:high)",
}
LOG_KEYWORDS = {
    "security": ("cve-", "secret leaked", "policy violation"),
    "deploy": ("docker build", "registry push", "health check"),
    "infra": ("oom", "disk full", "network timeout", "runner"),
    "lint": ("style violation", "unused import"),
    "test": ("assertion", "flaky", "timeout"),
    "build": ("compilation error", "type error", "missing dependency"),
}
# ---------------------------------------------------------------------------


def error_rate_gate(
    counts: DataFrame,
    baseline: float = 0.005,
    multiplier: float = 2.0,
    min_events: int = 100,
    window: str = "30 minutes",
) -> DataFrame:
    """Error-rate verdict per service and tumbling window.

    ``counts(service, ts, is_error)`` may hold one row per event; counting is
    done before the shuffle.  The rate is cut (not rounded) to four places and
    compared with ``baseline * multiplier``; below ``min_events`` the gate
    passes with rate 0.
    """
    limit = Decimal(str(baseline)) * Decimal(str(multiplier))
    per_window = counts.groupBy("service", F.window(F.col("ts").cast("timestamp"), window).alias("w")).agg(
        F.count(F.lit(1)).alias("total_events"), F.sum(F.col("is_error").cast("bigint")).alias("error_events")
    )
    return _judge_rate(per_window.withColumn("window_start", F.col("w.start")).drop("w"), limit, min_events)


def error_rate_gate_from_counts(
    totals: DataFrame, baseline: float = 0.005, multiplier: float = 2.0, min_events: int = 100
) -> DataFrame:
    """The same verdict for rows that already hold ``total_events`` and ``error_events``."""
    return _judge_rate(totals, Decimal(str(baseline)) * Decimal(str(multiplier)), min_events)


def _judge_rate(df: DataFrame, limit: Decimal, min_events: int) -> DataFrame:
    enough = F.col("total_events") >= F.lit(min_events)
    units = F.when(
        enough & (F.col("total_events") > 0), F.expr("error_events * 10000 div total_events")
    ).otherwise(F.lit(0))
    limit_units = float(limit * 10000)
    return df.withColumns(
        {
            "error_rate": units / F.lit(10000.0),
            "threshold": F.lit(float(limit)),
            "passed": ~enough | (units <= F.lit(limit_units)),
        }
    )


def canary_3sigma(rates: DataFrame, history_days: int = 7, services: DataFrame | None = None) -> DataFrame:
    """Three-sigma check of a rate against the same slot on previous days.

    ``rates(service, day, slot, rate)`` holds one row per service, DATE and
    time-of-day slot.  The frame is a range over the day number, so a missing
    day never pulls in an older one.  ``services`` limits the check to services
    that were deployed recently.
    """
    if services is not None:
        rates = rates.join(services.select("service").distinct(), "service", "left_semi")
    numbered = rates.withColumn("day_no", F.unix_date("day").cast("bigint"))
    past = Window.partitionBy("service", "slot").orderBy("day_no").rangeBetween(-history_days, -1)
    mean = F.round(F.avg("rate").over(past), 6)
    sd = F.round(F.coalesce(F.stddev_samp("rate").over(past), F.lit(0.0)), 6)
    return (
        numbered.withColumns({"n_history": F.count("rate").over(past), "mean": mean, "stddev": sd})
        .withColumn("threshold", F.round(F.col("mean") + 3 * F.col("stddev"), 6))
        .withColumn("regression", F.coalesce(F.col("rate") > F.col("threshold"), F.lit(False)))
        .withColumn("stddev", F.when(F.col("n_history") > 0, F.col("stddev")))
        .drop("day_no")
    )


def latency_percentiles(latency: DataFrame, keys: Sequence[str] = ("service", "run_id")) -> DataFrame:
    """p50 and p95 in whole milliseconds by nearest rank, per run.

    A failed probe (NULL latency) counts as 9.999 s.  Rounding is monotone, so
    it is done before ranking, which bounds the histogram of one run.
    """
    ms = F.round(F.coalesce(F.col("latency_s"), F.lit(FAILED_PROBE_SECONDS)) * 1000).cast("bigint")
    return ranked_values(
        latency.select(*keys, ms.alias("ms")), keys, "ms", {"p50": nearest_rank(50), "p95": nearest_rank(95)}, width=100
    ).withColumnRenamed("n_values", "n_probes")


def perf_regression(percentiles: DataFrame, threshold: float = 30.0, enforce: bool = False) -> DataFrame:
    """p95 change against the previous run of the service, one decimal place.

    Runs follow each other by ``run_ts`` where the input has it, then by run id;
    ids that are numbers are compared as numbers.
    """
    when = ["run_ts"] if "run_ts" in percentiles.columns else []
    number = F.col("run_id").cast("string").try_cast("bigint")
    runs = Window.partitionBy("service").orderBy(*when, number, "run_id")
    base = F.col("baseline_p95")
    first = base.isNull() | (base == 0)
    change = F.when(~first, F.round((F.col("p95") - base) * 100.0 / base, 1))
    return (
        percentiles.withColumn("baseline_p95", F.lag("p95").over(runs))
        .withColumn("first_run", first)
        .withColumn("regress_percent", change)
        .withColumn("regressed", F.coalesce(F.col("regress_percent") > threshold, F.lit(False)))
        .withColumn("blocked", F.col("regressed") & F.lit(enforce))
    )


def coverage_gate(percent: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Coverage verdict; ``mode`` is a column (pr is advisory, stg and prd block).

    Without a percentage the report had an unknown format: that never passes.
    """
    percent_known = F.col("coverage_percent").isNotNull()
    below = ~F.coalesce(F.col("coverage_percent") >= F.lit(threshold), F.lit(False))
    verdict = (
        F.when(~percent_known, "unknown-format")
        .when(~below, "ok")
        .when(F.col("mode") == "pr", "warning")
        .when(F.col("mode").isin("stg", "prd"), "blocking")
        .otherwise("unknown-mode")
    )
    return percent.withColumns({"passed": ~below, "verdict": verdict})


def deploy_window(deploys: DataFrame, start_hour: int = 10, end_hour: int = 16, check: bool | None = None) -> DataFrame:
    """Deploys outside Monday-Friday, ``start_hour`` to ``end_hour`` UTC (end included).

    With ``check=None`` only production is checked.
    """
    ts = F.col("ts").cast("timestamp")
    checked = F.col("env") == "production" if check is None else F.lit(check)
    weekend = F.weekday(ts) > 4
    off_hours = (F.hour(ts) < start_hour) | (F.hour(ts) > end_hour)
    reason = F.when(~checked, "not-checked").when(weekend, "weekend").when(off_hours, "hour").otherwise("ok")
    return deploys.withColumn("window_reason", reason).withColumn(
        "in_window", F.col("window_reason").isin("ok", "not-checked")
    )


def observation_window(staged: DataFrame, now: str) -> DataFrame:
    """Whether each staged deploy was observed long enough at ``now``."""
    at = F.expr("try_to_timestamp(stg_deploy_time)")
    elapsed = F.expr(f"(unix_timestamp(timestamp'{now}') - unix_timestamp(__at)) div 60")
    return (
        staged.withColumn("__at", at)
        .withColumn("elapsed_min", elapsed)
        .withColumn(
            "observation",
            F.when(F.col("elapsed_min").isNull(), "error")
            .when(F.col("elapsed_min") < F.col("observation_minutes"), "too-early")
            .otherwise("ok"),
        )
        .drop("__at")
    )


def latest_by_env(deploys: DataFrame) -> DataFrame:
    """Newest staging and production deploy of each service, in one aggregation."""
    newest = F.struct("ts", "deploy_id", "digest")
    side = {
        env: F.max(F.when(F.col("env") == env, newest)).alias(env) for env in ("staging", "production")
    }
    return (
        deploys.groupBy("service")
        .agg(*side.values())
        .select(
            "service",
            F.col("staging.digest").alias("stg_digest"),
            F.col("staging.ts").alias("stg_ts"),
            F.col("production.digest").alias("prd_digest"),
            F.col("production.ts").alias("prd_ts"),
        )
    )


def version_alignment(deploys: DataFrame) -> DataFrame:
    """Production must run exactly the digest that staging runs."""
    return latest_by_env(deploys).withColumn("aligned", F.col("stg_digest").eqNullSafe(F.col("prd_digest")))


def precheck(deploys: DataFrame, rate_gate: DataFrame, now: str, observation_minutes: int = 30) -> DataFrame:
    """Alignment, observation window and error rate together, per service.

    ``rate_gate(service, passed)`` may miss a service; the rate is then skipped.
    """
    elapsed = F.expr(f"(unix_timestamp(timestamp'{now}') - unix_timestamp(cast(stg_ts as timestamp))) div 60")
    return (
        version_alignment(deploys)
        .withColumn("observed", F.coalesce(elapsed >= observation_minutes, F.lit(False)))
        .join(rate_gate.select("service", F.col("passed").alias("rate_passed")), "service", "left")
        .withColumn("rate_skipped", F.col("rate_passed").isNull())
        .withColumn(
            "ready", F.col("aligned") & F.col("observed") & F.coalesce("rate_passed", F.lit(True))
        )
    )


def gate_matrix(job_results: DataFrame, gates: Sequence[str] = PULL_REQUEST_GATES) -> DataFrame:
    """One row for every run: raw result of each gate (absent is skipped) and whether it succeeded.

    When a job ran several times the latest start counts.
    """
    last = {
        g: F.max(F.when(F.col("job") == g, F.struct("started_at", "conclusion"))).getField("conclusion") for g in gates
    }
    wide = job_results.groupBy("repo", "run_id").agg(
        *[F.coalesce(col, F.lit("skipped")).alias(f"{g}_result") for g, col in last.items()]
    )
    return wide.withColumns({f"{g}_passed": F.col(f"{g}_result") == "success" for g in gates})


def gate_totals(matrix: DataFrame, gates: Sequence[str] = PULL_REQUEST_GATES) -> DataFrame:
    """Passed gates per repository with an estate total (``repo`` is 'ALL')."""
    return (
        matrix.rollup("repo")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            *[F.sum(F.col(f"{g}_passed").cast("bigint")).alias(f"{g}_passed") for g in gates],
        )
        .withColumn("repo", F.coalesce("repo", F.lit("ALL")))
    )


def deploy_readiness(
    job_results: DataFrame,
    cve_counts: DataFrame,
    sign_job: str = "sign",
    pin_job: str = "pins",
    auto_deploy: bool = True,
) -> DataFrame:
    """Blocked by a critical finding or failed signing; a failed pin check fails without blocking."""
    failed = F.col("conclusion") == "failure"
    runs = job_results.groupBy("repo", "run_id").agg(
        F.coalesce(F.bool_or(failed & (F.col("job") == sign_job)), F.lit(False)).alias("sign_failed"),
        F.coalesce(F.bool_or(failed & (F.col("job") == pin_job)), F.lit(False)).alias("pins_failed"),
    )
    critical = F.coalesce(F.col("critical_count"), F.lit(0)) > 0
    return (
        runs.join(cve_counts.select("repo", "critical_count"), "repo", "left")
        .withColumn("blocked", critical | F.col("sign_failed"))
        .withColumn("failed", F.col("blocked") | F.col("pins_failed"))
        .withColumn("ready", ~F.col("blocked") & F.lit(auto_deploy))
        .drop("critical_count")
    )


def evaluate_thresholds(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Breaches per service and window; limits are inclusive in their direction."""
    def breach(limit: str) -> Column:
        low = (F.col("direction") == "low") & (F.col("value") <= F.col(limit))
        high = (F.col("direction") == "high") & (F.col("value") >= F.col(limit))
        return F.coalesce(low | high, F.lit(False))

    rank = F.when(breach("critical"), 2).when(breach("warning"), 1).otherwise(0)
    joined = metrics.join(thresholds, "name").withColumn("rank", rank)
    return joined.groupBy("service", "window_end").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("rank") > 0).alias("violations"),
        F.max("rank").alias("max_rank"),
        F.array_join(
            F.sort_array(F.collect_set(F.when(F.col("rank") > 0, F.col("name")))), ","
        ).alias("violated"),
    )


def service_state(evaluated: DataFrame) -> DataFrame:
    """Latest-window independent state: the worst severity seen per service."""
    worst = F.max("max_rank")
    state = F.when(worst == 2, "critical").when(worst == 1, "degraded").otherwise("healthy")
    return evaluated.groupBy("service").agg(
        state.alias("state"), F.sum("violations").alias("violations"), F.count(F.lit(1)).alias("windows")
    )


def log_slo(requests: DataFrame, window: str = "30 minutes") -> DataFrame:
    """Error rate and interpolated p99 duration as ``(name, value)`` rows per prefix and window."""
    timed = requests.withColumn("window_start", F.window(F.col("ts").cast("timestamp"), window).start)
    keys = ["prefix", "window_start"]
    rate = timed.groupBy(*keys).agg(
        (F.count_if(F.col("status") >= 500) / F.count(F.lit(1))).alias("value")
    ).withColumn("name", F.lit("error_rate"))
    pos = (F.col("n_values") - 1) * F.lit(0.99)
    p99 = ranked_values(timed, keys, "duration_ms", {"lo": F.floor(pos), "hi": F.ceil(pos)}, width=10.0)
    p99 = p99.withColumn("value", F.col("lo") + (F.col("hi") - F.col("lo")) * (pos - F.floor(pos)))
    return rate.select(*keys, "name", "value").unionByName(
        p99.withColumn("name", F.lit("p99_ms")).select(*keys, "name", "value")
    )


def probe_summary(probes: DataFrame, retries: int = 10, warn_after: float = 5.0, fail_after: float = 30.0) -> DataFrame:
    """Smoke result per service and run over all attempts within the retry limit.

    A run passes with a status of exactly 200.  Its grade follows the latency of
    the first attempt with any 2xx status.
    """
    ok = (F.col("http_code") == 200) & (F.col("attempt") <= retries)
    good = F.col("http_code").between(200, 299) & (F.col("attempt") <= retries)
    first = F.min(F.struct("attempt", "probe_id", "http_code", "latency_s"))
    decisive = lambda rule: F.min(F.when(rule, F.struct("attempt", "probe_id", "latency_s")))
    out = probes.groupBy("service", "run_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.coalesce(F.bool_or(ok), F.lit(False)).alias("passed"),
        first.alias("first"),
        decisive(ok).alias("hit"),
        decisive(good).alias("graded"),
    )
    latency = F.col("graded.latency_s")
    grade = (
        F.when(F.col("graded").isNull(), "fail")
        .when(latency < warn_after, "pass")
        .when(latency < fail_after, "warn")
        .otherwise("fail")
    )
    return out.select(
        "service",
        "run_id",
        "attempts",
        "passed",
        F.col("hit.attempt").alias("passed_on"),
        (F.col("first.http_code") == 200).alias("first_try_pass"),
        grade.alias("grade"),
    )


def eval_metrics(checks: DataFrame, k: int = 3) -> DataFrame:
    """pass rate, flaky checks, first-try passes and pass@k per run.

    ``checks(run_id, name, attempt, passed)``; a check is flaky when its
    attempts disagree.
    """
    won = F.col("passed")
    per_check = checks.groupBy("run_id", "name").agg(
        F.bool_or(won).alias("any_pass"),
        F.bool_and(won).alias("all_pass"),
        F.coalesce(F.bool_or(won & (F.col("attempt") <= k)), F.lit(False)).alias("pass_k"),
        F.min(F.struct("attempt", "passed")).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(won).alias("n_pass"),
    )
    return per_check.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("checks"),
        F.round(F.sum("n_pass") / F.sum("n"), 6).alias("pass_rate"),
        F.count_if(F.col("any_pass") & ~F.col("all_pass")).alias("flaky_count"),
        F.count_if(F.col("first.passed")).alias("first_try_pass"),
        F.round(F.count_if(F.col("pass_k")) / F.count(F.lit(1)), 6).alias("pass_at_k"),
    )


def failure_classes(
    job_results: DataFrame,
    cve_counts: DataFrame,
    jobs: Mapping[str, str] | None = None,
) -> DataFrame:
    """Failure classes of each run in order of severity, with the action of the worst.

    ``jobs`` maps the signals build, pins, migration and smoke to job names.
    """
    names = {"build": "build", "pins": "pins", "migration": "migration", "smoke": "smoke", **(jobs or {})}
    failed = F.col("conclusion") == "failure"
    runs = job_results.groupBy("repo", "run_id").agg(
        *[F.coalesce(F.bool_or(failed & (F.col("job") == j)), F.lit(False)).alias(s) for s, j in names.items()]
    )
    crit = F.coalesce(F.col("critical_count"), F.lit(0)) > 0
    high = F.coalesce(F.col("high_count"), F.lit(0)) > 0
    signal = {
        "security": crit | F.col("pins"),
        "build": F.col("build"),
        "migration": F.col("migration"),
        "smoke": F.col("smoke"),
        "advisory": high & ~crit,
    }
    listed = F.filter(
        F.array(*[F.when(signal[c], F.lit(c)) for c in FAILURE_CLASS_ORDER]), lambda c: c.isNotNull()
    )
    actions = F.create_map(*[F.lit(x) for pair in FAILURE_ACTIONS.items() for x in pair])
    return (
        runs.join(cve_counts.select("repo", "critical_count", "high_count"), "repo", "left")
        .withColumn("__classes", listed)
        .filter(F.size("__classes") > 0)
        .select(
            "repo",
            "run_id",
            F.array_join("__classes", ",").alias("classes"),
            F.element_at("__classes", 1).alias("primary_class"),
            actions[F.element_at("__classes", 1)].alias("action"),
        )
    )


def classify_logs(logs: DataFrame, text: str = "log") -> DataFrame:
    """Category of a failure log by keyword, most severe rule first; else 'unknown'."""
    low = F.lower(F.col(text))
    out = F.lit("unknown")
    for category, words in reversed(LOG_KEYWORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, category).otherwise(out)
    return logs.withColumn("category", out)


def flaky_runs(step_results: DataFrame, last: int = 10, piece_rows: int = 10_000) -> DataFrame:
    """Runs after which a step counts as flaky, judged by its last ``last`` results in run order.

    ``step_results(repo, job, step, run_id, started_at, conclusion)``; only
    success, failure and timed_out are results.  Gives how often each came, and
    how often the outcome changed from one result to the next (a timeout is no
    pass).  ``reason`` is ``mixed`` where passes and failures met, else ``timeout``
    where any result was one, so a step that only times out is listed too.  Rows
    without an instant are left out; ties go by ``run_id``.
    """
    keys = ["repo", "job", "step"]
    told = step_results.filter(F.col("conclusion").isin("success", "failure", "timed_out") & F.col("started_at").isNotNull())
    rows = told.select(*keys, "run_id", "started_at", "conclusion", micros("started_at").alias("t"))
    cut = in_pieces(rows, keys, "t", ["run_id", "conclusion"], last - 1, max(piece_rows, last))
    by_piece = Window.partitionBy(*keys, "piece").orderBy("row_no")
    frame, pairs = by_piece.rowsBetween(-(last - 1), 0), by_piece.rowsBetween(-(last - 2), 0)
    passed = F.col("conclusion") == "success"
    changed = (F.lag(passed).over(by_piece) != passed).cast("bigint")
    count = lambda c: F.sum((F.col("conclusion") == c).cast("bigint")).over(frame)
    judged = cut.withColumn("changed", F.coalesce(changed, F.lit(0))).withColumns(
        {
            "passes": count("success"), "failures": count("failure"), "timeouts": count("timed_out"),
            "flips": F.sum("changed").over(pairs) if last > 1 else F.lit(0).cast("bigint"),
        }
    )
    # Of the oldest row in a frame the change before it is not inside; pieces begin their context there.
    reason = F.when((F.col("passes") > 0) & (F.col("failures") > 0), "mixed").when(F.col("timeouts") > 0, "timeout")
    return (
        judged.filter(~F.col("is_context"))
        .withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .select(*keys, "run_id", "started_at", "passes", "failures", "timeouts", "flips", "reason")
    )


def flaky_steps(job_results: DataFrame, days: int = 7) -> DataFrame:
    """Days on which a job has both passed and failed within the last ``days`` days.

    Results are counted per day before the window, so a busy job costs one row
    a day.
    """
    daily = job_results.groupBy("repo", "job", F.col("started_at").cast("date").alias("day")).agg(
        F.count_if(F.col("conclusion") == "success").alias("passes"),
        F.count_if(F.col("conclusion") == "failure").alias("failures"),
        F.count_if(F.col("conclusion") == "timed_out").alias("timeouts"),
    )
    by_day = Window.partitionBy("repo", "job").orderBy("day_no")
    recent = by_day.rangeBetween(-(days - 1), 0)
    red = F.col("failures") > F.col("passes")
    return (
        daily.withColumn("day_no", F.unix_date("day").cast("bigint"))
        .withColumns(
            {
                "recent_passes": F.sum("passes").over(recent),
                "recent_failures": F.sum("failures").over(recent),
                "recent_timeouts": F.sum("timeouts").over(recent),
                "flipped": F.coalesce(F.lag(red).over(by_day) != red, F.lit(False)),
            }
        )
        .filter("recent_passes > 0 AND recent_failures > 0")
        .drop("day_no", "passes", "failures", "timeouts")
    )


def infra_drift(plan_runs: DataFrame) -> DataFrame:
    """Drift state of each directory from the exit code of its latest plan run."""
    last = F.max(F.struct("ts", "run_id", "exit_code"))
    return (
        plan_runs.groupBy("directory")
        .agg(last.alias("last"))
        .select(
            "directory",
            F.col("last.run_id").alias("run_id"),
            F.when(F.col("last.exit_code") == 0, "false")
            .when(F.col("last.exit_code") == 2, "true")
            .otherwise("unknown")
            .alias("drift"),
        )
    )


def agent_findings_rollup(findings: DataFrame) -> DataFrame:
    """Finding counts by level and severity with totals, and route coverage."""
    return (
        findings.rollup("level", "severity")
        .agg(
            F.count(F.lit(1)).alias("findings"),
            F.count_distinct("category").alias("categories"),
            F.count_distinct(F.when(F.col("tested"), F.col("route"))).alias("routes_tested"),
            F.count_distinct("route").alias("routes_total"),
        )
        .withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("ALL")) for c in ("level", "severity")})
    )


def superseded_runs(job_results: DataFrame, cancelling: Column | bool = True) -> DataFrame:
    """Runs cancelled because a newer run of their concurrency group started before they ended."""
    runs = job_results.groupBy("concurrency_group", "run_id").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at")
    )
    keyed = runs.withColumns({"start_us": micros("started_at"), "end_us": micros("ended_at")})
    cancel = cancelling if isinstance(cancelling, Column) else F.lit(cancelling)
    day = 24 * 3_600_000_000
    return (
        lead_in_time(keyed, ["concurrency_group"], "start_us", "next_us", bucket_us=day, unit=F.col("run_id"))
        .withColumn("superseded", cancel & F.coalesce(F.col("next_us") < F.col("end_us"), F.lit(False)))
        .drop("start_us", "end_us")
    )
