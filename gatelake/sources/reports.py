"""Readers that turn report files and text into silver tables.

Reports are parsed once into typed rows.  Whatever is one file in the outside
world stays one row here; nothing is collected across files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.operators.text_policy import strict_json

# Fixed values -------------------------------------------------------------
COMMIT_SCHEMA = "repo string, sha string, subject string, author string, ts timestamp"
STATS_SCHEMA = (
    "service string, window_start string, "
    "groups array<struct<by:struct<outcome:string>,totals:map<string,double>>>"
)
CVE_SCHEMA = (
    "repo string, run_id string, Results array<struct<Target:string,"
    "Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,Severity:string>>>>"
)
SECRET_SCHEMA = "array<struct<RuleID:string,File:string,StartLine:bigint>>"
METRIC_SCHEMA = "service string, window_end string, name string, value double"
DEFAULT_SUBJECT = "external issue event"
LINE_COUNTER = '<counter type="LINE"'
# ---------------------------------------------------------------------------


def parse_env_matrix(lines: DataFrame) -> DataFrame:
    """Markdown table rows to ``(var, env, source)``; columns after the third are ignored."""
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    return (
        lines.select(cells.alias("c"))
        .filter((F.size("c") >= 5) & (F.get("c", 1) != "") & ~F.get("c", 1).rlike("^(:?-+:?|Var Name)$"))
        .select(
            F.get("c", 1).alias("var"),
            F.explode(F.split(F.get("c", 2), ",")).alias("env"),
            F.get("c", 3).alias("source"),
        )
        .withColumn("env", F.trim("env"))
        .filter("env <> ''")
    )


def read_env_matrix(spark: SparkSession, path: str) -> DataFrame:
    return parse_env_matrix(spark.read.text(path).withColumnRenamed("value", "line"))


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated commit log with one line per commit; quotes are part of a subject."""
    return spark.read.schema(COMMIT_SCHEMA).csv(path, sep="\t", quote="", escape="")


# -- event envelope --------------------------------------------------------------


def normalize_events(raw: DataFrame) -> DataFrame:
    """Typed envelope of a tracker event.

    ``raw`` carries ``event_name, event_action, mode, repo`` and the JSON texts
    ``issue, comment, client_payload, form, area_labels, severity_labels,
    duplicates``.  Labels are the two lists one after the other, repeats kept.
    """
    field = F.get_json_object
    labels = lambda name: F.coalesce(F.from_json(name, "array<string>"), F.expr("cast(array() as array<string>)"))
    candidate = "array<struct<number:bigint,title:string,state:string,url:string>>"
    return raw.select(
        F.struct(F.col("event_name").alias("name"), F.col("event_action").alias("action"), "mode").alias("event"),
        F.struct(F.col("repo").alias("name")).alias("repo"),
        F.col("issue"),
        F.try_parse_json("comment").alias("comment"),
        F.try_parse_json("client_payload").alias("client_payload"),
        F.try_parse_json(F.coalesce("form", F.lit("{}"))).alias("form"),
        F.struct(
            F.concat(labels("area_labels"), labels("severity_labels")).alias("labels_applied"),
            F.from_json("duplicates", candidate).alias("duplicate_candidates"),
            F.lit(None).cast("string").alias("stale_action"),
        ).alias("management"),
        F.coalesce(field("issue", "$.number"), field("client_payload", "$.issue.number")).cast("bigint").alias("issue_number"),
        F.coalesce(
            field("issue", "$.title"),
            field("client_payload", "$.title"),
            field("client_payload", "$.issue.title"),
            F.lit(DEFAULT_SUBJECT),
        ).alias("subject"),
    )


# -- telemetry ----------------------------------------------------------------------


def accepted_total(groups: Column | str = "groups") -> Column:
    """Accepted quantity of one stats document, 0 when there is none."""
    col = F.col(groups) if isinstance(groups, str) else groups
    accepted = F.filter(F.coalesce(col, F.expr(f"cast(array() as {STATS_SCHEMA.split('groups ')[1]})")), lambda g: g["by"]["outcome"] == "accepted")
    return F.aggregate(
        accepted, F.lit(0.0), lambda acc, g: acc + F.coalesce(F.try_element_at(g["totals"], F.lit("sum(quantity)")), F.lit(0.0))
    ).cast("bigint")


def read_outcome_stats(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """``(service, window_start, quantity)`` of each stats document."""
    docs = spark.read.schema(STATS_SCHEMA).json(path, multiLine=multiline)
    return docs.select("service", "window_start", accepted_total().alias("quantity"))


def collect_metrics(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Union of provider feeds (``value``: one JSON text per row).

    A malformed row is kept with ``ok = false`` and never stops another feed.
    """
    parts = []
    for provider, feed in feeds.items():
        parsed = F.from_json(
            "value", METRIC_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        )
        parts.append(
            feed.select(F.lit(provider).alias("provider"), parsed.alias("m")).select(
                "provider",
                "m.service",
                "m.window_end",
                "m.name",
                "m.value",
                (F.col("m._bad").isNull() & F.col("m.name").isNotNull() & F.col("m.value").isNotNull()).alias("ok"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# -- scan reports ---------------------------------------------------------------------


def read_cve_report(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """One row per vulnerability of each report document; a clean report gives none."""
    docs = spark.read.schema(CVE_SCHEMA).json(path, multiLine=multiline)
    return (
        docs.select("repo", "run_id", F.explode("Results").alias("r"))
        .select("repo", "run_id", F.explode("r.Vulnerabilities").alias("v"))
        .select(
            "repo",
            "run_id",
            F.col("v.VulnerabilityID").alias("cve"),
            F.col("v.PkgName").alias("package"),
            F.col("v.Severity").alias("severity"),
        )
    )


def report_counts(runs: DataFrame, findings: DataFrame, keys: Sequence[str] = ("repo", "run_id")) -> DataFrame:
    """Findings per run of the inventory, 0 for a run without any."""
    counted = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"))
    return runs.join(counted, list(keys), "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def secret_counts(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Secrets per run; a run without a report counts as clean and is flagged.

    ``reports(run_id, content)`` holds one JSON array per run.
    """
    sized = reports.select("run_id", F.size(F.from_json("content", SECRET_SCHEMA)).alias("n"))
    return (
        runs.join(sized, "run_id", "left")
        .withColumn("report_missing", F.col("n").isNull() | (F.col("n") < 0))
        .withColumn("secrets_count", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("bigint"))
        .withColumn("found", F.col("secrets_count") > 0)
        .drop("n")
    )


def secret_findings(reports: DataFrame) -> DataFrame:
    """One row per reported secret: rule, file and line, never the value."""
    return reports.select("run_id", F.explode(F.from_json("content", SECRET_SCHEMA)).alias("s")).select(
        "run_id", F.col("s.RuleID").alias("rule"), F.col("s.File").alias("file"), F.col("s.StartLine").alias("line")
    )


def read_secret_report(spark: SparkSession, path: str) -> DataFrame:
    """Report files as ``(run_id, content)``; the file name is the run."""
    return _whole_files(spark, path).select(
        F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("run_id"), "content"
    )


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


# -- coverage ------------------------------------------------------------------------------


def coverage_format(path: str = "path", content: str = "content") -> Column:
    """Format by extension, then by content."""
    p, c = F.col(path), F.col(content)
    return (
        F.when(p.rlike(r"\.(info|lcov)$"), "lcov")
        .when(p.rlike(r"\.out$"), "go")
        .when(p.rlike(r"\.json$"), "istanbul")
        .when(p.rlike(r"\.xml$"), F.when(F.contains(c, F.lit(LINE_COUNTER)), "jacoco").otherwise("cobertura"))
        .when(c.rlike("(?m)^LF:"), "lcov")
        .when(c.rlike("^mode:"), "go")
        .when(F.contains(c, F.lit("line-rate=")), "cobertura")
        .when(F.contains(c, F.lit(LINE_COUNTER)), "jacoco")
        .otherwise("unknown")
    )


def _numbers(texts: Column) -> Column:
    return F.transform(texts, lambda x: x.cast("bigint"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _all(pattern: str, group: int = 1, column: Column | None = None) -> Column:
    return F.regexp_extract_all(F.col("content") if column is None else column, F.lit(pattern), F.lit(group))


def coverage_rows(files: DataFrame) -> DataFrame:
    """Hit and total units of each report; ratio formats carry ``percent`` instead.

    ``files`` has ``path`` and ``content`` besides its keys.  Each report is one
    row and is reduced in place, without a shuffle.
    """
    body = F.expr("substring(content, instr(content, '\n') + 1)")
    go = r"(?m)^\S.*?\s(\d+)\s+(\d+)[ \t\r]*$"
    stmts, hits = _numbers(_all(go, 1, body)), _numbers(_all(go, 2, body))
    covered_stmts = F.zip_with(stmts, hits, lambda s, h: F.when(h > 0, s).otherwise(0))
    counters = _all(LINE_COUNTER + "[^>]*>", 0)
    side = lambda name: _numbers(F.transform(counters, lambda c: F.regexp_extract(c, name + '="([0-9]+)"', 1)))
    covered, missed = _total(side("covered")), _total(side("missed"))
    fmt = F.col("format")
    hit = (
        F.when(fmt == "lcov", _total(_numbers(_all(r"(?m)^LH:\s*([0-9]+)"))))
        .when(fmt == "go", _total(covered_stmts))
        .when(fmt == "jacoco", covered)
    )
    total = (
        F.when(fmt == "lcov", _total(_numbers(_all(r"(?m)^LF:\s*([0-9]+)"))))
        .when(fmt == "go", _total(stmts))
        .when(fmt == "jacoco", covered + missed)
    )
    rate = F.regexp_extract("content", r'line-rate="([0-9.]+)"', 1)
    percent = F.when(fmt == "cobertura", F.coalesce(rate.try_cast("double") * 100, F.lit(0.0))).when(
        fmt == "istanbul", F.coalesce(F.get_json_object("content", "$.total.lines.pct").try_cast("double"), F.lit(0.0))
    )
    return (
        files.withColumn("format", coverage_format())
        .withColumns({"hit": hit, "total": total, "percent": percent})
        .drop("content")
    )


def coverage_percent(rows: DataFrame) -> DataFrame:
    """Coverage in percent with two decimals; nothing to cover is 0, an unknown format NULL."""
    ratio = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("hit") / F.col("total") * 100)
    return rows.withColumn("coverage_percent", F.round(F.coalesce("percent", ratio), 2))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage rows of a folder laid out as ``repo/run_id/file``."""
    where = F.split("path", "/")
    files = _whole_files(spark, path).withColumns(
        {"repo": F.element_at(where, -3), "run_id": F.element_at(where, -2), "path": F.element_at(where, -1)}
    )
    return coverage_rows(files)


# -- transcripts ---------------------------------------------------------------------------------


def shape_transcripts(files: DataFrame) -> DataFrame:
    """``(run_id, line_no, raw, shape, bad)`` from whole transcripts ``(run_id, content)``.

    One JSON document is one row, as is plain text. Otherwise a text with a
    line that is a JSON object or array gives one row per line; a line that is
    cut off or no JSON at all is marked ``bad`` and does not spoil the others.
    """
    lines = F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")
    record = lambda x: F.ltrim(x).rlike(r"^[\[{]") & strict_json(x).isNotNull()
    shape = (
        F.when(F.trim("content") == "", "text")
        .when(strict_json("content").isNotNull(), "json")
        .when(F.exists(lines, record), "jsonl")
        .otherwise("text")
    )
    shaped = files.withColumn("shape", shape)
    parts = F.when(F.col("shape") == "jsonl", lines).otherwise(F.array("content"))
    rows = shaped.select("run_id", "shape", F.posexplode(parts).alias("line_no", "raw"))
    return rows.withColumn("bad", (F.col("shape") == "jsonl") & strict_json("raw").isNull())


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript files of a folder; the file name is the run."""
    return shape_transcripts(read_secret_report(spark, path))
