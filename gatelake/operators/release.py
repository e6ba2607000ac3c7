"""Release data: commit ranges, changelogs, version bumps, documentation drift, deploy feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import patterns as P
from gatelake.operators.text_policy import parse_labels

# Fixed values -------------------------------------------------------------
COMMITS_PER_RELEASE = 200
CHANGELOG_BULLETS = 30
SECTIONS = ("Breaking Changes", "Added", "Changed", "Fixed", "Security")
TYPE_SECTIONS = {
    "feat": "Added", "fix": "Fixed", "revert": "Fixed",
    "refactor": "Changed", "perf": "Changed", "build": "Changed",
}
DRIFT_CODE = ("ts", "tsx", "js", "py", "go", "java", "rs", "rb", "php")
FIRST_CODE = ("ts", "js", "py", "go")
DRIFT_EXCLUDE = "(test|spec|mock|fixture|__tests__)"
DRIFT_FILES, FIRST_FILES = 50, 20
FILE_BYTES, CONTEXT_BYTES, DIFF_BYTES = 2_048, 30_720, 40_960
# ---------------------------------------------------------------------------

PREFIX = r"^([a-z]+)(?:\([^)]*\))?(!?): "


def newest_commits(commits: DataFrame, keys: Sequence[str] = ("repo", "release_no"), limit: int = COMMITS_PER_RELEASE) -> DataFrame:
    """Newest commits of each range without merges."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("sha"))
    return (
        commits.filter(~F.startswith("subject", F.lit("Merge ")))
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= limit)
        .drop("rn")
    )


def is_breaking(labels: Column | None = None) -> Column:
    out = (F.regexp_extract("subject", PREFIX, 2) == "!") | F.contains(F.coalesce("body", F.lit("")), F.lit("BREAKING CHANGE:"))
    if labels is not None:
        marked = F.arrays_overlap(parse_labels(F.coalesce(labels, F.lit(""))), F.array(F.lit("breaking-change"), F.lit("major")))
        out = out | marked
    return out


def changelog(commits: DataFrame, prs: DataFrame | None = None, keys: Sequence[str] = ("repo", "release_no")) -> DataFrame:
    """Changelog sections per release: bullets newest first, thirty at most per release.

    Earlier sections keep their bullets when the cap is hit; empty sections do
    not appear.
    """
    if prs is not None:
        commits = commits.join(prs.select(F.col("pr"), F.col("labels").alias("__labels")), "pr", "left")
        breaking = is_breaking(F.col("__labels"))
    else:
        breaking = is_breaking()
    kind = F.regexp_extract("subject", PREFIX, 1)
    by_type = F.create_map(*[F.lit(x) for pair in TYPE_SECTIONS.items() for x in pair])
    section = (
        F.when(breaking, "Breaking Changes")
        .when(F.contains(F.lower(F.concat_ws(" ", "subject", "body")), F.lit("security")), "Security")
        .otherwise(F.try_element_at(by_type, kind))
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    text = F.regexp_replace("subject", PREFIX, "")
    bullet = F.concat(F.lit("- "), text, F.lit("."), F.when(F.col("pr").isNotNull(), F.concat(F.lit(" (#"), "pr", F.lit(")"))).otherwise(""))
    top = Window.partitionBy(*keys).orderBy("section_no", F.desc("ts"), "sha")
    return (
        commits.filter(~F.startswith("subject", F.lit("Merge ")))
        .withColumn("section", section)
        .filter(F.col("section").isNotNull())
        .select(*keys, "section", order.alias("section_no"), "ts", "sha", bullet.alias("bullet"))
        .withColumn("rn", F.row_number().over(top))
        .filter(F.col("rn") <= CHANGELOG_BULLETS)
        .groupBy(*keys, "section", "section_no")
        .agg(
            F.count(F.lit(1)).alias("bullets"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rn", "bullet"))), lambda x: x["bullet"]), "\n"
            ).alias("text"),
        )
    )


def semver(tag: Column | str) -> Column:
    """Ordered struct of a ``v1.2.3`` tag, NULL when it is none."""
    col = F.col(tag) if isinstance(tag, str) else tag
    part = lambda i: F.regexp_extract(col, r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)$", i).cast("bigint")
    return F.when(
        col.rlike(r"^v?[0-9]+\.[0-9]+\.[0-9]+$"),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def previous_tag(tags: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Highest tag per repository by version order, leaving out the one being released."""
    if current is not None:
        tags = tags.join(current.select("repo", F.col("version").alias("tag")), ["repo", "tag"], "left_anti")
    return tags.groupBy("repo").agg(F.max(semver("tag")).alias("v")).filter("v IS NOT NULL")


def version_bump(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Bump class and next version per repository from its commits."""
    level = F.when(is_breaking(), 3).when(F.regexp_extract("subject", PREFIX, 1) == "feat", 2).otherwise(1)
    bumps = commits.groupBy("repo").agg(F.max(level).alias("level"))
    zero = F.lit(0).cast("bigint")
    major, minor, patch = (F.coalesce(F.col(f"v.{p}"), zero) for p in ("major", "minor", "patch"))
    name = lambda a, b, c: F.concat(F.lit("v"), a, F.lit("."), b, F.lit("."), c)
    return bumps.join(previous_tag(tags), "repo", "left").select(
        "repo",
        F.when(F.col("level") == 3, "major").when(F.col("level") == 2, "minor").otherwise("patch").alias("bump"),
        F.when(F.col("v").isNotNull(), name(major, minor, patch)).otherwise("").alias("previous"),
        F.when(F.col("level") == 3, name(major + 1, zero, zero))
        .when(F.col("level") == 2, name(major, minor + 1, zero))
        .otherwise(name(major, minor, patch + 1))
        .alias("next"),
    )


def _ext(extensions: Sequence[str]) -> Column:
    return F.col("path").rlike(P.extension_pattern(tuple(extensions)))


def drift_files(commit_files: DataFrame, docs_path: str = "docs/") -> DataFrame:
    """Code files changed since the last documentation commit, per repository, in path order.

    Without documentation history every code file counts.  Changes are first
    reduced to the latest one per file.
    """
    files = commit_files.groupBy("repo", "path").agg(F.max("ts").alias("ts"))
    is_doc = _ext(["md"]) | F.startswith("path", F.lit(docs_path))
    last = files.groupBy("repo").agg(
        F.max(F.when(is_doc, F.col("ts"))).alias("last_doc"),
        F.max(F.when(_ext(["mdx"]), F.col("ts"))).alias("last_mdx"),
    )
    fresh = F.col("last_doc").isNotNull() & (F.col("ts") > F.col("last_doc"))
    code = F.when(F.col("last_doc").isNull(), _ext(FIRST_CODE)).otherwise(
        fresh & _ext(DRIFT_CODE) & ~F.col("path").rlike(DRIFT_EXCLUDE)
    )
    return files.join(last, "repo").filter(code)


def doc_drift(commit_files: DataFrame, docs_path: str = "docs/") -> DataFrame:
    """Whether the code of each repository moved on without documentation, with the first files.

    A repository without changed code has no file and no drift.
    """
    changed = drift_files(commit_files, docs_path)
    by_path = Window.partitionBy("repo").orderBy("path")
    counts = changed.groupBy("repo").agg(
        F.count(F.lit(1)).alias("code_files"),
        F.max("last_doc").alias("last_doc"),
        F.max("last_mdx").alias("last_mdx"),
    )
    listed = (
        changed.withColumn("rn", F.row_number().over(by_path))
        .filter(F.col("rn") <= DRIFT_FILES)
        .filter((F.col("rn") <= FIRST_FILES) | F.col("last_doc").isNotNull())
        .groupBy("repo")
        .agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("files"))
    )
    quiet = F.coalesce(F.col("last_mdx") <= F.col("last_doc"), F.lit(True))
    drift = F.col("code_files").isNotNull() & (F.col("last_doc").isNull() | quiet)
    return (
        commit_files.select("repo")
        .distinct()
        .join(counts, "repo", "left")
        .join(listed, "repo", "left")
        .select("repo", F.coalesce("code_files", F.lit(0)).alias("code_files"), drift.alias("drift"), F.coalesce("files", F.lit("")).alias("files"))
    )


def context_budget(
    files: DataFrame, per_file: int = FILE_BYTES, total: int = CONTEXT_BYTES, listed: int = DRIFT_FILES
) -> DataFrame:
    """Bytes of each listed file that fit the context, in path order.

    ``files(repo, path, size_bytes)``; the first ``listed`` paths of a
    repository are its list.  A file costs a header line, its first bytes and a
    line end; the sum over the list is cut at ``total``.
    """
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    files = files.withColumn("__rank", rank).filter(F.col("__rank") <= listed).drop("__rank")
    upto = Window.partitionBy("repo").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.octet_length(F.concat(F.lit("=== "), "path", F.lit(" ===\n"))) + F.least("size_bytes", F.lit(per_file)) + 1
    return (
        files.withColumn("cost", cost.cast("bigint"))
        .withColumn("upto", F.sum("cost").over(upto))
        .withColumn("used", F.greatest(F.lit(0), F.least(F.col("cost"), F.lit(total) - (F.col("upto") - F.col("cost")))).cast("bigint"))
        .drop("upto")
    )


def cap_bytes(text: Column | str, limit: int) -> Column:
    """The first ``limit`` bytes of a text, as binary."""
    col = F.col(text) if isinstance(text, str) else text
    return F.substring(F.encode(col, "UTF-8"), 1, limit)


def spec_staleness(commit_files: DataFrame, source: str, spec: str, change: str = "CHANGELOG.md") -> DataFrame:
    """Interface description and changelog older than what they describe, per repository.

    ``commit_files(repo, path, ts, is_merge)``; ``source`` and ``spec`` are
    path prefixes.
    """
    last = lambda cond: F.max(F.when(cond, F.col("ts")))
    spec_ts, change_ts = F.col("spec_ts"), F.col("change_ts")
    return (
        commit_files.groupBy("repo")
        .agg(
            last(F.startswith("path", F.lit(source))).alias("source_ts"),
            last(F.startswith("path", F.lit(spec))).alias("spec_ts"),
            last(F.col("path") == change).alias("change_ts"),
            last(F.col("is_merge")).alias("merge_ts"),
        )
        .select(
            "repo",
            (spec_ts.isNotNull() & F.coalesce(F.col("source_ts") > spec_ts, F.lit(False))).alias("api_stale"),
            (change_ts.isNotNull() & F.coalesce(F.col("merge_ts") > change_ts, F.lit(False))).alias("changelog_stale"),
        )
    )


def needs_update(drift: DataFrame, stale: DataFrame) -> DataFrame:
    """Any of drift, stale interface description, stale changelog."""
    return (
        stale.join(drift.select("repo", "drift"), "repo", "left")
        .withColumn("drift", F.coalesce("drift", F.lit(False)))
        .withColumn("needs_update", F.col("drift") | F.col("api_stale") | F.col("changelog_stale"))
    )


def deploy_event_feeds(deploys: DataFrame, project: str = "delivery") -> DataFrame:
    """One JSON payload per deploy and provider, shaped as each provider expects.

    ``deploys(service, env, version, git_sha, ts)``.  Keys and tokens are never
    columns.
    """
    c = F.col
    lit = lambda value, name: F.lit(value).alias(name)
    tag = lambda prefix, col: F.concat(F.lit(f"{prefix}:"), c(col))
    where = [c("env").alias("environment"), "version", "git_sha"]
    feeds = {
        "release": F.struct(
            "version",
            F.expr("cast(array() as array<string>)").alias("projects"),
            F.array(F.struct(lit("github", "repository"), c("git_sha").alias("commit"))).alias("refs"),
        ),
        "event": F.struct(
            F.concat(F.lit("Deploy "), "service", F.lit(" "), "version", F.lit(" → "), "env").alias("title"),
            F.concat(F.lit("git sha: "), "git_sha").alias("text"),
            lit("info", "alert_type"),
            lit("github", "source_type_name"),
            F.array(tag("env", "env"), tag("version", "version"), tag("app", "service")).alias("tags"),
        ),
        "capture": F.struct(
            lit("deploy", "event"),
            lit("ci-system", "distinct_id"),
            F.struct(*where, c("service").alias("app")).alias("properties"),
        ),
        "run_tag": F.struct(
            F.concat(F.lit("deploy:"), "version").alias("name"),
            lit(project, "session_name"),
            lit("tool", "run_type"),
            F.struct(F.struct(*where, lit("deploy-marker", "kind")).alias("metadata")).alias("extra"),
        ),
        "ndjson": F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_time"),
            lit("deploy", "kind"),
            *where,
            c("service").alias("app"),
        ),
    }
    rows = F.array(*[F.struct(lit(p, "provider"), F.to_json(s).alias("payload")) for p, s in feeds.items()])
    return deploys.select("deploy_id", F.inline(rows))
