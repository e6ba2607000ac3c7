"""Queries over report files; the files are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.gates import ERROR_RATE_SQL, error_rate_gate
from gatelake.catalog.matching import as_sql
from gatelake.catalog.registry import query
from gatelake.catalog.views import project, view
from gatelake.operators.workflow_audit import audit_workflows
from gatelake.session import shared_dir
from gatelake.sinks.results import write_feeds, write_gate_results
from gatelake.sources import reports as r

RAW_EVENTS = """
    SELECT o_orderkey AS event_id, 'issues' AS event_name, 'opened' AS event_action, 'auto' AS mode, concat('repo-', o_custkey % 20) AS repo,
      CASE WHEN o_orderkey % 3 = 0 THEN concat('{"number":', o_orderkey, ',"title":"Title ', o_custkey, '"}') END AS issue,
      CAST(NULL AS VARCHAR(10)) AS comment,
      CASE o_orderkey % 4 WHEN 0 THEN concat('{"title":"Payload ', o_custkey, '","issue":{"number":', o_custkey, '}}')
        WHEN 1 THEN concat('{"issue":{"number":', o_custkey, ',"title":"Nested ', o_custkey, '"}}')
        WHEN 2 THEN concat('{"event":"x', o_custkey, '"}') END AS client_payload,
      '{}' AS form, concat('["area/', o_custkey % 5, '","bug"]') AS area_labels,
      CASE WHEN o_orderkey % 2 = 0 THEN '["severity/high","bug"]' ELSE '[]' END AS severity_labels, '[]' AS duplicates
    FROM {orders}"""


@query(
    "normalize_events",
    """
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 4 IN (0, 1) THEN o_custkey END AS issue_number,
      CASE WHEN o_orderkey % 3 = 0 THEN concat('Title ', o_custkey) WHEN o_orderkey % 4 = 0 THEN concat('Payload ', o_custkey)
        WHEN o_orderkey % 4 = 1 THEN concat('Nested ', o_custkey) ELSE 'external issue event' END AS subject,
      concat('repo-', o_custkey % 20) AS repo, 'issues/opened/auto' AS event,
      concat('area/', o_custkey % 5, ',bug', CASE WHEN o_orderkey % 2 = 0 THEN ',severity/high,bug' ELSE '' END) AS labels
    FROM orders""",
)
def normalize_events(spark, sf):
    out = r.normalize_events(project(spark, sf, RAW_EVENTS))
    return out.select(
        "issue_number",
        "subject",
        F.col("repo.name").alias("repo"),
        F.concat_ws("/", "event.name", "event.action", "event.mode").alias("event"),
        F.array_join("management.labels_applied", ",").alias("labels"),
    )


DAY_STATS = """
    SELECT concat('svc-', user_id % 5) AS service, strftime(ts, '%Y-%m-%d') AS window_start,
      count(*) FILTER (WHERE event_type = 'view' OR event_type = 'click') AS quantity FROM events GROUP BY 1, 2"""


@query("read_outcome_stats", DAY_STATS)
def read_outcome_stats(spark, sf):
    """Writes one stats document per service and day, then reads them."""
    groups = (
        view(spark, sf, "v_counts")
        .withColumn("window_start", F.date_format("ts", "yyyy-MM-dd"))
        .withColumn("outcome", F.when(F.col("category").isin("view", "click"), "accepted").otherwise("filtered"))
        .groupBy("service", "window_start", "outcome", "category")
        .agg(F.count(F.lit(1)).cast("double").alias("q"))
    )
    documents = groups.groupBy("service", "window_start").agg(
        F.collect_list(
            F.struct(
                F.struct("outcome").alias("by"), F.create_map(F.lit("sum(quantity)"), F.col("q")).alias("totals")
            )
        ).alias("groups")
    )
    path = shared_dir(spark, "stats")
    documents.write.json(path)
    return r.read_outcome_stats(spark, path)


@query(
    "collect_metrics",
    """
    SELECT CASE event_type WHEN 'error' THEN 'errors' WHEN 'click' THEN 'product' ELSE 'logs' END AS provider,
      event_id % 7 <> 0 AS ok, count(*) AS metrics, round(coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN value END), 0), 3) AS total
    FROM events GROUP BY 1, 2""",
)
def collect_metrics(spark, sf):
    record = F.to_json(
        F.struct("service", F.date_format("ts", "yyyy-MM-dd").alias("window_end"), F.lit("v").alias("name"), F.round(F.col("latency_s") * 1000, 6).alias("value"))
    )
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"service": '), record)).otherwise(record)
    feed = view(spark, sf, "v_counts").withColumn("value", line)
    feeds = {
        "errors": feed.filter("category = 'error'").select("value"),
        "product": feed.filter("category = 'click'").select("value"),
        "logs": feed.filter("category NOT IN ('error', 'click')").select("value"),
    }
    out = r.collect_metrics(feeds).groupBy("provider", "ok")
    return out.agg(
        F.count(F.lit(1)).alias("metrics"),
        F.round(F.coalesce(F.sum(F.when(F.col("ok"), F.col("value"))), F.lit(0.0)), 3).alias("total"),
    )


@query(
    "read_cve_report",
    """
    SELECT repo, run_id, count(v) AS findings FROM (
      SELECT concat('repo-', o_custkey % 20) AS repo, CAST(o_orderkey AS VARCHAR) AS run_id,
        unnest(CASE WHEN o_orderkey % 4 = 0 THEN [NULL] WHEN o_orderkey % 4 = 1 THEN [1] ELSE [1, 2, 3] END) AS v FROM orders)
    GROUP BY 1, 2""",
)
def read_cve_report(spark, sf):
    """Writes one report per run (clean for some), then reads and counts them."""
    runs = view(spark, sf, "v_prs").select("repo", F.col("pr").alias("k"), F.col("pr").cast("string").alias("run_id"))
    vuln = F.struct(
        F.concat(F.lit("CVE-"), "k").alias("VulnerabilityID"), F.lit("pkg").alias("PkgName"), F.lit("HIGH").alias("Severity")
    )
    result = F.struct(F.lit("img").alias("Target"), F.array(vuln).alias("Vulnerabilities"))
    double = F.struct(F.lit("fs").alias("Target"), F.array(vuln, vuln).alias("Vulnerabilities"))
    kind = F.col("k") % 4
    results = F.when(kind == 1, F.array(result)).when(kind > 1, F.array(result, double))
    path = shared_dir(spark, "cve")
    runs.select("repo", "run_id", results.alias("Results")).write.json(path)
    return r.report_counts(runs.select("repo", "run_id"), r.read_cve_report(spark, path))


REPORTS = """
    SELECT CAST(o_orderkey AS VARCHAR(20)) AS run_id, CASE o_orderkey % 5 WHEN 0 THEN '[]'
      WHEN 1 THEN concat('[{"RuleID":"r1","File":"a', o_custkey, '","StartLine":3}]')
      WHEN 2 THEN concat('[{"RuleID":"r1","File":"a","StartLine":3},{"RuleID":"r2","File":"b","StartLine":', o_custkey, '}]')
      ELSE 'not json' END AS content
    FROM {orders}"""


@query(
    "secret_counts",
    """
    WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 5 < 3 THEN o_orderkey % 5 END AS n FROM orders)
    SELECT run_id, n IS NULL AS report_missing, coalesce(n, 0) AS secrets_count, coalesce(n, 0) > 0 AS found FROM n""",
)
def secret_counts(spark, sf):
    runs = view(spark, sf, "v_prs").select(F.col("pr").cast("string").alias("run_id"))
    return r.secret_counts(runs, project(spark, sf, REPORTS + " WHERE o_orderstatus <> 'F'"))  # the others' reports are missing


@query(
    "secret_findings",
    """
    WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey AS c, o_orderkey % 5 AS k FROM orders)
    SELECT run_id, 'r1' AS rule, concat('a', c) AS file, 3 AS line FROM o WHERE k = 1
    UNION ALL SELECT run_id, 'r1', 'a', 3 FROM o WHERE k = 2 UNION ALL SELECT run_id, 'r2', 'b', c FROM o WHERE k = 2""",
)
def secret_findings(spark, sf):
    return r.secret_findings(project(spark, sf, REPORTS))


COVERAGE_FILES = r"""
    SELECT o_orderkey AS run_id, CASE o_orderkey % 8 WHEN 0 THEN 'a.info' WHEN 1 THEN 'cover.out' WHEN 2 THEN 'sum.json' WHEN 3 THEN 'j.xml'
        WHEN 4 THEN 'c.xml' WHEN 5 THEN 'plain' WHEN 6 THEN 'report' ELSE 'other.txt' END AS path,
      CASE o_orderkey % 8
        WHEN 0 THEN concat('SF:a', chr(10), 'LF:', o_custkey + 10, chr(10), 'LH:', o_custkey, chr(10), 'end_of_record', chr(10), 'LF:7', chr(10), 'LH:2', chr(10))
        WHEN 1 THEN concat('mode: set', chr(10), 'p/f.go:1.1,2.2 ', o_custkey + 1, ' 1', chr(10), 'p/f.go:3.1,4.2 5 0', chr(10))
        WHEN 2 THEN concat('{"total":{"lines":{"pct":', o_custkey % 100, '.25}}}')
        WHEN 3 THEN concat('<report><counter type="LINE" missed="', o_custkey + 1, '" covered="80"/><counter type="LINE" missed="1" covered="4"/></report>')
        WHEN 4 THEN concat('<coverage line-rate="0.', o_custkey % 90 + 10, '"><class line-rate="0.1"/></coverage>')
        WHEN 5 THEN concat('TN:', chr(10), 'LF:0', chr(10), 'LH:0', chr(10))
        WHEN 6 THEN concat('<counter type="LINE" missed="3" covered="', o_custkey, '"/>') ELSE concat('nothing ', o_custkey) END AS content
    FROM {orders}"""


@query(
    "coverage_percent",
    """
    WITH f AS (SELECT o_orderkey AS run_id, o_orderkey % 8 AS k, o_custkey AS c FROM orders)
    SELECT run_id, CASE k WHEN 0 THEN 'lcov' WHEN 1 THEN 'go' WHEN 2 THEN 'istanbul' WHEN 3 THEN 'jacoco' WHEN 4 THEN 'cobertura'
        WHEN 5 THEN 'lcov' WHEN 6 THEN 'jacoco' ELSE 'unknown' END AS format,
      CASE k WHEN 0 THEN round((c + 2) / (c + 17) * 100, 2) WHEN 1 THEN round((c + 1) / (c + 6) * 100, 2) WHEN 2 THEN c % 100 + 0.25
        WHEN 3 THEN round(84 / (c + 86) * 100, 2) WHEN 4 THEN c % 90 + 10 WHEN 5 THEN 0 WHEN 6 THEN round(c / (c + 3) * 100, 2) END AS coverage_percent
    FROM f""",
)
def coverage_percent(spark, sf):
    rows = r.coverage_rows(project(spark, sf, COVERAGE_FILES))
    return r.coverage_percent(rows).select("run_id", "format", "coverage_percent")


TRANSCRIPTS = r"""
    SELECT conv_id * 100 + turn AS run_id, CASE turn % 3 WHEN 0 THEN text
        WHEN 1 THEN concat('{"type":"system","n":', conv_id, '}', chr(10), chr(10), '{"type":"result","result":"r', turn, '"}', chr(10))
        ELSE concat('{', chr(10), ' "type": "result",', chr(10), ' "result": "r', turn, '"', chr(10), '}') END AS content
    FROM {conversations}"""


@query(
    "read_transcripts",
    f"""
    WITH t AS ({as_sql(TRANSCRIPTS)})
    SELECT run_id, 'text' AS shape, 0 AS line_no, md5(content) AS raw_md5 FROM t WHERE run_id % 100 % 3 = 0
    UNION ALL SELECT run_id, 'json', 0, md5(content) FROM t WHERE run_id % 100 % 3 = 2
    UNION ALL SELECT run_id, 'jsonl', 0, md5(string_split(content, chr(10))[1]) FROM t WHERE run_id % 100 % 3 = 1
    UNION ALL SELECT run_id, 'jsonl', 1, md5(string_split(content, chr(10))[3]) FROM t WHERE run_id % 100 % 3 = 1""",
)
def read_transcripts(spark, sf):
    return r.shape_transcripts(project(spark, sf, TRANSCRIPTS)).select("run_id", "shape", "line_no", F.md5("raw").alias("raw_md5"))


WORKFLOW_FILES = r"""
    SELECT concat('repo-', o_orderkey // 14) AS repo, concat(CASE o_orderkey % 14
        WHEN 1 THEN 'workflows/reusable-a.yml' WHEN 4 THEN 'workflows/reusable-b.yml' WHEN 5 THEN 'steps/x/action.yml' WHEN 6 THEN 'steps/y/action.yml'
        WHEN 9 THEN 'scripts/a.sh' WHEN 10 THEN 'scripts/b.sh' WHEN 11 THEN 'workflows/ci-self-test.yml'
        WHEN 12 THEN 'workflows/reusable-c.yml' ELSE concat('workflows/w', o_orderkey % 14, '.yml') END) AS path,
      CASE o_orderkey % 14
        WHEN 0 THEN concat('name: n', chr(10), 'permissions: ', chr(123), chr(125), chr(10), 'jobs: x', chr(10))
        WHEN 1 THEN concat('permissions: ', chr(123), chr(125), chr(10), 'jobs: x', chr(10))
        WHEN 2 THEN concat('permissions:', chr(10), '  contents: read', chr(10), '  workflows: write', chr(10))
        WHEN 3 THEN concat('concurrency:', chr(10), '  group: g-', o_custkey, chr(10), 'jobs:', chr(10), '  go:', chr(10), '    uses: ./.ci/workflows/reusable-b.yml@main', chr(10))
        WHEN 4 THEN concat('concurrency:', chr(10), '  group: g-', o_custkey, chr(10))
        WHEN 5 THEN concat('  - uses: vendor/lib/$', chr(123), chr(123), ' steps.v ', chr(125), chr(125), '@abc', chr(10))
        WHEN 6 THEN concat('description: $', chr(123), chr(123), ' secrets.KEY_', o_custkey, ' ', chr(125), chr(125), chr(10))
        WHEN 7 THEN concat('  - run: bash verify-sha-consistency.sh', chr(10))
        WHEN 8 THEN concat('  with:', chr(10), '    fetch-depth: 0', chr(10), '  - run: bash verify-sha-consistency.sh', chr(10))
        WHEN 9 THEN concat('set -euo pipefail', chr(10), 'v="$(echo "$d" | awk ''{ print; exit }'')"', chr(10))
        WHEN 10 THEN concat('set -euo pipefail', chr(10), 'while read -r k; do break; done', chr(10))
        WHEN 11 THEN concat('on:', chr(10), '  push:', chr(10), '    paths:', chr(10), '      - "workflows/**"', chr(10))
        WHEN 12 THEN concat('concurrency:', chr(10), '  group: g-', o_custkey, chr(10))
        ELSE concat('permissions:', chr(10), '  id-token: write', chr(10)) END AS content
    FROM {orders}"""


@query(
    "audit_workflows",
    f"""
    WITH f AS (SELECT concat('repo-', o_orderkey // 14) AS repo, o_orderkey % 14 AS k, o_custkey AS c FROM orders)
    SELECT repo, CASE k WHEN 0 THEN 'workflows/w0.yml' WHEN 2 THEN 'workflows/w2.yml' WHEN 5 THEN 'steps/x/action.yml' WHEN 6 THEN 'steps/y/action.yml'
        WHEN 7 THEN 'workflows/w7.yml' WHEN 9 THEN 'scripts/a.sh' ELSE 'workflows/ci-self-test.yml' END AS path,
      CASE k WHEN 0 THEN 'W01' WHEN 2 THEN 'W02' WHEN 5 THEN 'A01' WHEN 6 THEN 'A02' WHEN 7 THEN 'R01' WHEN 9 THEN 'S01' ELSE 'T01' END AS rule
    FROM f WHERE k IN (0, 2, 5, 6, 7, 9, 11)
    UNION ALL SELECT a.repo, 'workflows/reusable-b.yml', 'W03' FROM f a JOIN f b ON a.repo = b.repo AND a.k = 3 AND b.k = 4
      AND a.c % 3 = b.c % 3""",
)
def audit(spark, sf):
    files = project(spark, sf, WORKFLOW_FILES.replace("//", "div").replace("'  group: g-', o_custkey", "'  group: g-', o_custkey % 3"))
    return audit_workflows(files)


@query("write_gate_results", f"WITH g AS ({ERROR_RATE_SQL}) SELECT *, window_start[1:10] AS dt FROM g")
def gate_results(spark, sf):
    """Writes the gate by day, then reads the table back."""
    path = shared_dir(spark, "gate-results")
    write_gate_results(error_rate_gate(spark, sf), path, F.to_timestamp("window_start"))
    return spark.read.parquet(path).withColumn("dt", F.col("dt").cast("string"))


@query("write_feeds", "SELECT provider, count(*) AS payloads FROM (VALUES ('release'), ('event'), ('capture'), ('run_tag'), ('ndjson')) p(provider), v_deploys GROUP BY 1")
def feeds(spark, sf):
    """Writes one folder of payloads per provider, then counts them."""
    from gatelake.catalog.release import deploy_event_feeds

    path = shared_dir(spark, "feeds")
    write_feeds(deploy_event_feeds(spark, sf), path)
    return spark.read.text(path).groupBy("provider").agg(F.count(F.lit(1)).alias("payloads"))
