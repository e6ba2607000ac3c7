"""Maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.registry import query
from gatelake.catalog.text import LABELS, scan_secrets
from gatelake.catalog.views import view
from gatelake.operators import upkeep as u

COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s.upper()}') AS {s}_count" for s in ("critical", "high", "medium"))


@query(
    "cve_counts",
    f"""WITH c AS (SELECT repo, {COUNTS} FROM v_findings GROUP BY 1)
      SELECT *, critical_count > 0 OR high_count > 0 AS found, critical_count > 0 AS blocked FROM c""",
)
def cve_counts(spark, sf):
    return u.cve_counts(view(spark, sf, "v_findings"))


@query(
    "cve_totals",
    f"""SELECT coalesce(repo, 'ALL') AS repo, coalesce(package, 'ALL') AS package, {COUNTS} FROM v_findings
      GROUP BY ROLLUP (repo, package)""",
)
def cve_totals(spark, sf):
    return u.cve_totals(view(spark, sf, "v_findings"))


UPDATES = f"""
    k AS (SELECT repo, pr, {LABELS.format("labels")} AS l FROM v_prs WHERE author IN ('renovate[bot]', 'dependabot[bot]', 'renovate')),
    kk AS (SELECT repo, pr, CASE WHEN list_has_any(l, ['major', 'breaking-change']) THEN 'major' WHEN list_contains(l, 'minor') THEN 'minor'
      WHEN list_contains(l, 'patch') THEN 'patch' ELSE 'minor' END AS kind FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY pr DESC) AS rn FROM kk),
    upd AS (SELECT repo, count(*) FILTER (WHERE kind = 'major') AS major_count, count(*) FILTER (WHERE kind = 'minor') AS minor_count,
      count(*) FILTER (WHERE kind = 'patch') AS patch_count,
      coalesce(string_agg(pr, ',' ORDER BY pr DESC) FILTER (WHERE kind = 'major' AND rn <= 20), '') AS major_prs,
      coalesce(string_agg(pr, ',' ORDER BY pr DESC) FILTER (WHERE kind = 'minor' AND rn <= 20), '') AS minor_prs FROM r GROUP BY 1)"""


#: The same over open requests alone, for the signals of the estate.
OPEN_UPDATES = UPDATES.replace("FROM v_prs WHERE", "FROM v_update_prs WHERE state = 'open' AND")


@query("dependency_updates", f"WITH {UPDATES} SELECT * FROM upd")
def dependency_updates(spark, sf):
    return u.dependency_updates(view(spark, sf, "v_prs"))


def signals(spark, sf):
    """Signals of the estate; secrets and static analysis come from the texts."""
    issues = view(spark, sf, "v_issues").select("number", F.concat(F.lit("repo-"), F.col("number") % 20).alias("repo"))
    secrets = scan_secrets(spark, sf).join(issues, "number").groupBy("repo").agg(F.sum("hits").alias("secrets_count"))
    sast = (
        view(spark, sf, "v_findings")
        .groupBy("repo")
        .agg(F.count_if((F.col("severity") == "CRITICAL") & (F.col("package") == "pkg7")).alias("sast_count"))
    )
    updates = u.dependency_updates(view(spark, sf, "v_update_prs"))
    return u.maintenance_signals(cve_counts(spark, sf), updates, secrets, sast)


SIGNALS = f"""
    {OPEN_UPDATES}, c AS (SELECT repo, {COUNTS}, count(*) FILTER (WHERE severity = 'CRITICAL' AND package = 'pkg7') AS sast_count
      FROM v_findings GROUP BY 1),
    x AS (SELECT concat('repo-', number % 20) AS repo, unnest(regexp_extract_all(body, '(?i)(?:token|secret|api_key|apikey|password)\\s*=\\s*"[0-9a-f]{{40}}"')) AS h FROM v_issues),
    s AS (SELECT repo, count(*) AS secrets_count FROM x GROUP BY 1),
    sig AS (SELECT repo, coalesce(critical_count, 0) AS critical_count, coalesce(high_count, 0) AS high_count,
        coalesce(medium_count, 0) AS medium_count, coalesce(major_count, 0) AS major_count, coalesce(minor_count, 0) AS minor_count,
        coalesce(patch_count, 0) AS patch_count, coalesce(secrets_count, 0) AS secrets_count, coalesce(sast_count, 0) AS sast_count
      FROM c FULL JOIN upd USING (repo) FULL JOIN s USING (repo))"""


@query(
    "maintenance_health",
    f"""
    WITH {SIGNALS}, h AS (SELECT *, CASE WHEN secrets_count > 0 OR critical_count > 0 THEN 'critical'
        WHEN high_count > 0 OR major_count > 0 OR sast_count > 0 THEN 'needs-attention' ELSE 'healthy' END AS health FROM sig)
    SELECT *, health <> 'healthy' AS has_issues FROM h""",
)
def maintenance_health(spark, sf):
    return u.maintenance_health(signals(spark, sf))


PRIORITY_ROWS = " UNION ALL ".join(
    f"SELECT repo, {rank} AS rank, {order} AS ord, '{name}' AS signal, {name} AS count, '{title}' AS t FROM sig WHERE {name} > 0"
    for order, (name, rank, title) in enumerate(u.SIGNALS)
)


@query(
    "maintenance_priorities",
    f"""
    WITH {SIGNALS}, p AS ({PRIORITY_ROWS})
    SELECT repo, concat('P', rank) AS priority, signal, count, concat(t, ' (', count, ')')[1:71] AS title,
      rank <= 2 AND row_number() OVER (PARTITION BY repo ORDER BY ord) <= 5 AS filed FROM p""",
)
def maintenance_priorities(spark, sf):
    return u.maintenance_priorities(signals(spark, sf))
