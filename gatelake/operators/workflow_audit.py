"""Rules over workflow, composite-step and script files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
PERMISSION_SCOPES = (
    "actions", "attestations", "checks", "contents", "deployments", "discussions", "id-token",
    "issues", "models", "packages", "pages", "pull-requests", "repository-projects",
    "security-events", "statuses",
)
PIN_CHECK_SCRIPT = "verify-sha-consistency.sh"
# ---------------------------------------------------------------------------

GROUP = r"(?m)^concurrency:[ \t]*\n[ \t]+group:[ \t]*(\S.*?)[ \t]*$"
CALLEE = r"(?m)uses:[ \t]*\./\S*?([^/\s]+\.ya?ml)"


def _rules() -> dict[str, Column]:
    content, path = F.col("content"), F.col("path")
    name = F.substring_index("path", "/", -1)
    workflow = path.rlike(r"(^|/)workflows/[^/]+\.ya?ml$")
    composite = path.rlike(r"(^|/)action\.ya?ml$")
    script = path.rlike(r"\.sh$")
    scopes = F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]+([a-z-]+):[ \t]*(?:read|write|none)[ \t]*$"), F.lit(1))
    return {
        "W01": workflow & ~F.startswith(name, F.lit("reusable-")) & content.rlike(r"(?m)^permissions:[ \t]*\{[ \t]*\}"),
        "W02": workflow & F.exists(scopes, lambda s: ~s.isin(*PERMISSION_SCOPES)),
        "A01": composite & content.rlike(r"(?m)uses:[ \t]*[^\s@]*\$\{\{"),
        "A02": composite & content.rlike(r"\$\{\{\s*secrets\."),
        "R01": workflow
        & F.contains(content, F.lit(PIN_CHECK_SCRIPT))
        & ~content.rlike(r"fetch-depth:[ \t]*0"),
        "S01": script
        & F.contains(content, F.lit("pipefail"))
        & content.rlike(r"(?m)echo [^|\n]*\|[ \t]*awk [^\n]*exit"),
        "T01": workflow
        & name.rlike("self-test|maintenance")
        & content.rlike(r"(?m)^[ \t]+paths:")
        & ~F.contains(content, F.lit("scripts/**")),
    }


def audit_workflows(files: DataFrame) -> DataFrame:
    """``(repo, path, rule)`` for every rule a file breaks.

    File rules are flags of one scan; only the shared concurrency group (W03)
    needs a join, on repository, called file and group.
    """
    fired = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in _rules().items()]), lambda r: r.isNotNull())
    single = files.select("repo", "path", F.explode(fired).alias("rule"))
    grouped = files.select(
        "repo",
        "path",
        F.substring_index("path", "/", -1).alias("name"),
        F.regexp_extract("content", GROUP, 1).alias("group"),
        F.array_distinct(F.regexp_extract_all("content", F.lit(CALLEE), F.lit(1))).alias("calls"),
    ).filter("`group` <> ''")
    callers = grouped.select("repo", "group", F.explode("calls").alias("name")).distinct()
    shared = grouped.select("repo", "path", "name", "group").join(callers, ["repo", "group", "name"], "left_semi")
    return single.unionByName(shared.select("repo", "path", F.lit("W03").alias("rule")))
