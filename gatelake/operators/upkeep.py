"""Maintenance sweep: CVE counts, update requests, health and priorities per repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.operators.text_policy import parse_labels

# Fixed values -------------------------------------------------------------
UPDATE_AUTHORS = ("renovate[bot]", "dependabot[bot]", "renovate")
UPDATE_LIST_CAP = 20
FILED_PER_RUN = 5
TITLE_CAP = 72
#: signal column, priority, title
SIGNALS = (
    ("secrets_count", 0, "Secrets detected in git history"),
    ("critical_count", 0, "Critical CVEs detected"),
    ("sast_count", 0, "High-severity static analysis findings"),
    ("high_count", 1, "High CVEs detected"),
    ("major_count", 2, "Major dependency updates pending"),
    ("minor_count", 3, "Minor dependency updates pending"),
    ("patch_count", 4, "Patch dependency updates pending"),
    ("medium_count", 4, "Medium CVEs detected"),
)
# ---------------------------------------------------------------------------


def cve_counts(findings: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """CRITICAL, HIGH and MEDIUM counts; critical blocks."""
    counted = findings.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s.upper()).alias(f"{s}_count") for s in ("critical", "high", "medium")]
    )
    return counted.withColumns(
        {
            "found": (F.col("critical_count") > 0) | (F.col("high_count") > 0),
            "blocked": F.col("critical_count") > 0,
        }
    )


def cve_totals(findings: DataFrame) -> DataFrame:
    """Severity counts by repository and package with subtotals."""
    return (
        findings.rollup("repo", "package")
        .agg(*[F.count_if(F.col("severity") == s.upper()).alias(f"{s}_count") for s in ("critical", "high", "medium")])
        .withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ("repo", "package")})
    )


def open_only(prs: DataFrame) -> DataFrame:
    """Requests in state ``open``; a table without a ``state`` column holds open ones only."""
    return prs.filter(F.lower("state") == "open") if "state" in prs.columns else prs


def dependency_updates(prs: DataFrame) -> DataFrame:
    """Open update requests by class: full counts, lists of the newest twenty.

    ``prs(repo, pr, author, labels, state)``; without ``state`` all count as open.
    """
    labels = parse_labels(F.coalesce("labels", F.lit("")))
    kind = (
        F.when(F.arrays_overlap("__l", F.array(F.lit("major"), F.lit("breaking-change"))), "major")
        .when(F.array_contains("__l", "minor"), "minor")
        .when(F.array_contains("__l", "patch"), "patch")
        .otherwise("minor")
    )
    updates = (
        open_only(prs)
        .filter(F.col("author").isin(*UPDATE_AUTHORS))
        .select("repo", "pr", labels.alias("__l"))
        .select("repo", "pr", kind.alias("kind"))
    )
    counts = updates.groupBy("repo").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("major", "minor", "patch")]
    )
    newest = Window.partitionBy("repo", "kind").orderBy(F.desc("pr"))
    listed = (
        updates.filter("kind <> 'patch'")
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= UPDATE_LIST_CAP)
        .groupBy("repo")
        .agg(
            *[
                F.array_join(
                    F.transform(
                        F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("rn", "pr")))),
                        lambda x: x["pr"].cast("string"),
                    ),
                    ",",
                ).alias(f"{k}_prs")
                for k in ("major", "minor")
            ]
        )
    )
    return counts.join(listed, "repo", "left").fillna("", ["major_prs", "minor_prs"])


def maintenance_signals(cves: DataFrame, updates: DataFrame, secrets: DataFrame, sast: DataFrame) -> DataFrame:
    """One row per repository with every count; a missing scan counts as zero."""
    joined = (
        cves.select("repo", "critical_count", "high_count", "medium_count")
        .join(updates.select("repo", "major_count", "minor_count", "patch_count"), "repo", "full_outer")
        .join(secrets.select("repo", "secrets_count"), "repo", "full_outer")
        .join(sast.select("repo", "sast_count"), "repo", "full_outer")
    )
    return joined.fillna(0)


def maintenance_health(signals: DataFrame) -> DataFrame:
    """critical, needs-attention or healthy."""
    c = F.col
    health = (
        F.when((c("secrets_count") > 0) | (c("critical_count") > 0), "critical")
        .when((c("high_count") > 0) | (c("major_count") > 0) | (c("sast_count") > 0), "needs-attention")
        .otherwise("healthy")
    )
    return signals.withColumn("health", health).withColumn("has_issues", F.col("health") != "healthy")


def maintenance_priorities(signals: DataFrame) -> DataFrame:
    """One row per signal that fired, ranked; P0 to P2 are filed, five at most per repository."""
    rows = F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(order).alias("order"),
                F.lit(name).alias("signal"),
                F.lit(title).alias("title"),
                F.col(name).cast("bigint").alias("count"),
            )
            for order, (name, rank, title) in enumerate(SIGNALS)
        ]
    )
    fired = F.filter(rows, lambda s: s["count"] > 0)
    return (
        signals.select("repo", F.posexplode(fired).alias("pos", "s"))
        .select(
            "repo",
            F.concat(F.lit("P"), F.col("s.rank")).alias("priority"),
            F.col("s.signal").alias("signal"),
            F.col("s.count").alias("count"),
            F.substring(F.concat("s.title", F.lit(" ("), "s.count", F.lit(")")), 1, TITLE_CAP - 1).alias("title"),
            ((F.col("s.rank") <= 2) & (F.col("pos") < FILED_PER_RUN)).alias("filed"),
        )
    )
