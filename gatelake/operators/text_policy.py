"""Audits of titles, messages, comments, paths and source lines.

Everything here is a narrow projection of one table; aggregates are the
rollups that reports need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.functions import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- labels and trust --------------------------------------------------------


def parse_labels(text: Column | str) -> Column:
    """Labels of a comma- or newline-separated list, trimmed and lower-case."""
    items = F.transform(F.split(_col(text), "[,\n]"), lambda x: F.lower(F.trim(x)))
    return F.filter(items, lambda x: x != "")


def spelled_labels(text: Column | str) -> Column:
    """Labels of a list as they are written, trimmed; of spellings that differ in case the first."""
    items = F.filter(F.transform(F.split(_col(text), "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    lower = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def strict_json(text: Column | str) -> Column:
    """The text as VARIANT, NULL unless all of it is one JSON value.

    The parser stops after the first value and ignores the rest.  Inside an
    array and inside an object a rest is an error; what closes one of the two
    early does not close the other.
    """
    plain = _col(text)
    in_list = F.try_parse_json(F.concat(F.lit("["), plain, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), plain, F.lit("}")))
    return F.when(in_list.isNotNull() & in_object.isNotNull(), F.try_parse_json(plain))


def is_trusted(association: Column | str) -> Column:
    return F.coalesce(_col(association).isin(*P.TRUSTED_ASSOCIATIONS), F.lit(False))


def with_trust(df: DataFrame, association: str = "author_assoc") -> DataFrame:
    return df.withColumn("trusted", is_trusted(association))


# -- pull requests and commits -----------------------------------------------


def audit_titles(prs: DataFrame) -> DataFrame:
    """Conventional-commit check of each title with its parts."""
    part = lambda i: F.regexp_extract("title", P.TITLE_PATTERN, i)
    return prs.withColumns(
        {
            "valid": F.col("title").rlike(P.TITLE_PATTERN),
            "type": part(1),
            "scope": F.regexp_replace(part(2), r"[()]", ""),
            "breaking": part(3) == "!",
        }
    )


def title_totals(audited: DataFrame) -> DataFrame:
    """Valid and invalid titles per repository with an estate total."""
    return (
        audited.rollup("repo")
        .agg(F.count(F.lit(1)).alias("titles"), F.count_if("valid").alias("valid"), F.count_if("breaking").alias("breaking"))
        .withColumn("repo", F.coalesce("repo", F.lit("ALL")))
    )


def audit_commit_messages(commits: DataFrame) -> DataFrame:
    """Subject form and length, and the number of over-long body lines."""
    first = F.element_at(F.split("subject", "\n"), 1)
    exempt = reduce(lambda a, b: a | b, [F.startswith(first, F.lit(p)) for p in P.EXEMPT_SUBJECTS])
    long_lines = F.filter(F.split("body", "\n"), lambda x: F.char_length(x) > P.BODY_LINE_MAX)
    return commits.withColumns(
        {
            "exempt": exempt,
            "valid_form": exempt | first.rlike(P.SUBJECT_PATTERN),
            "too_long": ~exempt & (F.char_length(first) > P.SUBJECT_MAX),
            "long_body_lines": F.size(long_lines).cast("bigint"),
        }
    )


def audit_descriptions(prs: DataFrame) -> DataFrame:
    """A description must name an issue unless the request carries ``no-issue``."""
    local = "(?i)" + P.CLOSING_WORDS + P.BLANKS + r"(?:\[?#|GH-)[0-9]+"
    remote = "(?i)" + P.CLOSING_WORDS + P.BLANKS + r"[A-Za-z0-9._-]+/[A-Za-z0-9._-]+#[0-9]+"
    exempt = F.array_contains(parse_labels(F.coalesce("labels", F.lit(""))), "no-issue")
    reason = (
        F.when(exempt, "no-issue")
        .when(F.col("body").rlike(local), "issue")
        .when(F.col("body").rlike(remote), "cross-repo")
        .otherwise("missing")
    )
    return prs.withColumn("link", reason).withColumn("passed", F.col("link") != "missing")


def fix_refs(body: Column | str) -> Column:
    """Distinct issue numbers a description closes, as text in string order."""
    pattern = "(?i)" + P.CLOSING_WORDS + P.BLANKS + "#([0-9]+)"
    return F.sort_array(F.array_distinct(F.regexp_extract_all(_col(body), F.lit(pattern), F.lit(1))))


def extract_fix_refs(prs: DataFrame, body: str = "body") -> DataFrame:
    """One row per request and reference."""
    return prs.withColumn("ref", F.explode(fix_refs(body)))


def fix_ref_lists(prs: DataFrame, body: str = "body") -> DataFrame:
    """The comma form, empty when nothing is closed."""
    return prs.withColumn("refs", F.array_join(fix_refs(body), ","))


def auto_merge_candidates(prs: DataFrame, author: str = "renovate[bot]", label: str = "patch") -> DataFrame:
    return prs.filter((F.col("author") == author) & F.array_contains(parse_labels("labels"), label))


def parse_commands(comments: DataFrame) -> DataFrame:
    """Slash command of each comment: the first line that looks like one decides."""
    line = F.regexp_extract("body", r"(?md)^[ \t\r\f\x0B]*(/[a-z-][^\n]*)", 1)
    word = F.substring(F.substring_index(line, " ", 1), 2, 1 << 30)
    known = F.coalesce(word.isin(*P.COMMANDS), F.lit(False))
    args = F.regexp_replace(F.expr("substring(__line, length(substring_index(__line, ' ', 1)) + 2)"), r"\s+$", "")
    return (
        comments.withColumn("__line", line)
        .withColumn("__word", word)
        .withColumns(
            {
                "command": F.when(known, F.col("__word")).otherwise("none"),
                "args": F.when(known, args).otherwise(""),
                "authorized": known & ((F.col("__word") == "help") | is_trusted("author_assoc")),
            }
        )
        .drop("__line", "__word")
    )


# -- files ---------------------------------------------------------------------


def audit_file_policy(files: DataFrame) -> DataFrame:
    """Violations per file: dotenv, large, no-newline, bad-json; clean files are dropped."""
    name = F.substring_index("path", "/", -1)
    dotenv = ((name == ".env") | F.startswith(name, F.lit(".env."))) & ~name.isin(*P.DOTENV_ALLOWED)
    text_file = F.col("path").rlike(P.extension_pattern(P.TEXT_EXTENSIONS))
    bad_json = (
        F.col("path").rlike(r"\.json$") & (F.trim("content") != "") & strict_json("content").isNull()
    )
    found = {
        "dotenv": dotenv,
        "large": F.col("size_bytes") > P.LARGE_FILE_BYTES,
        "no-newline": text_file & ~F.col("ends_with_newline"),
        "bad-json": bad_json,
    }
    listed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull())
    return (
        files.withColumn("violations", F.array_join(listed, ","))
        .filter(F.col("violations") != "")
        .drop("content")
    )


def path_kind(path: Column | str = "path") -> Column:
    return (
        F.when(_col(path).rlike(P.extension_pattern(P.CODE_EXTENSIONS)), "code")
        .when(_col(path).rlike(P.extension_pattern(P.DOC_EXTENSIONS)), "doc")
        .otherwise("other")
    )


def classify_paths(files: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Number of code, doc and other files per key."""
    kinds = ["code", "doc", "other"]
    wide = files.withColumn("kind", path_kind()).groupBy(*keys).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in kinds]
    )
    return wide


def detect_stack(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Language, package manager and version file of each repository.

    One pass over the file inventory: marker files become flags and the first
    matching marker decides.  ``overrides(repo, language)`` wins.
    """
    vendored = F.col("path").rlike(r"(^|/)(node_modules|build|target|\.git|\.gradle)/")
    has = lambda name: F.bool_or(F.col("path") == name)
    source = lambda ext: F.bool_or(F.endswith("path", F.lit(ext)) & ~vendored)
    markers = {
        "node": has("package.json"), "pnpm": has("pnpm-lock.yaml"), "yarn": has("yarn.lock"),
        "nvmrc": has(".nvmrc"), "node_version": has(".node-version"),
        "python": F.bool_or(F.col("path").isin("pyproject.toml", "requirements.txt")),
        "uv": has("uv.lock"), "python_version": has(".python-version"),
        "go": has("go.mod"), "maven": has("pom.xml"), "kts": has("build.gradle.kts"),
        "gradle": has("build.gradle"), "java_src": source(".java"), "kt_src": source(".kt"),
    }
    seen = files.groupBy("repo").agg(*[m.alias(n) for n, m in markers.items()])
    c = F.col
    language = (
        F.when(c("node"), "node").when(c("python"), "python").when(c("go"), "go").when(c("maven"), "java")
        .when(c("kts"), F.when(c("java_src") & ~c("kt_src"), "java").otherwise("kotlin"))
        .when(c("gradle"), F.when(c("kt_src"), "kotlin").otherwise("java"))
        .otherwise("unknown")
    )
    manager = (
        F.when(c("node"), F.when(c("pnpm"), "pnpm").when(c("yarn"), "yarn").otherwise("npm"))
        .when(c("python"), F.when(c("uv"), "uv").otherwise("pip"))
        .when(c("go"), "go-mod").when(c("maven"), "maven").when(c("kts"), "gradle-kts").when(c("gradle"), "gradle")
        .otherwise("unknown")
    )
    version = (
        F.when(c("node"), F.when(c("nvmrc"), ".nvmrc").when(c("node_version"), ".node-version").otherwise(""))
        .when(c("python"), F.when(c("python_version"), ".python-version").otherwise(""))
        .when(c("go"), "go.mod").when(c("maven"), "pom.xml").when(c("kts"), "build.gradle.kts")
        .when(c("gradle"), "build.gradle")
        .otherwise("")
    )
    out = seen.select(
        "repo", language.alias("language"), manager.alias("package_manager"), version.alias("version_file")
    )
    if overrides is None:
        return out
    forced = overrides.select("repo", F.col("language").alias("__forced"))
    return (
        out.join(forced, "repo", "left")
        .withColumns(
            {
                "language": F.coalesce("__forced", "language"),
                "package_manager": F.when(F.col("__forced").isNull(), F.col("package_manager")).otherwise("unknown"),
                "version_file": F.when(F.col("__forced").isNull(), F.col("version_file")).otherwise(""),
            }
        )
        .drop("__forced")
    )


def label_prs(files: DataFrame, rules: Mapping[str, Sequence[str]], keys: Sequence[str], sync: bool = True) -> DataFrame:
    """Labels from path globs; with ``sync`` rule labels without a match are removed.

    ``files`` repeats the current ``labels`` of the request on each path row.
    The rules become one flag per label, so no join is made.  Labels are
    compared without their case; current ones keep their spelling.
    """
    regex = {label: "|".join(P.glob_to_regex(g) for g in globs) for label, globs in rules.items()}
    hits = [F.bool_or(F.col("path").rlike(rx)).alias(f"__hit{i}") for i, rx in enumerate(regex.values())]
    grouped = files.groupBy(*keys).agg(F.max("labels").alias("labels"), *hits)
    wanted = F.filter(
        F.array(*[F.when(F.col(f"__hit{i}"), F.lit(label)) for i, label in enumerate(regex)]), lambda x: x.isNotNull()
    )
    listed = grouped.select(*keys, spelled_labels(F.coalesce("labels", F.lit(""))).alias("__current"), wanted.alias("__wanted"))
    same = lambda xs: F.transform(xs, lambda x: F.lower(x))
    within = lambda x, xs: F.array_contains(same(xs), F.lower(x))
    ruled = F.array(*[F.lit(x.lower()) for x in regex])
    current, wished = F.col("__current"), F.col("__wanted")
    stays = lambda x: ~F.array_contains(ruled, F.lower(x)) | within(x, wished)
    kept = F.filter(current, stays) if sync else current
    added = F.filter(wished, lambda x: ~within(x, current))
    return listed.select(
        *keys,
        F.array_join(F.sort_array(F.concat(kept, added)), ",").alias("labels"),
        F.array_join(F.sort_array(added), ",").alias("added"),
        F.array_join(F.sort_array(F.array_except(current, kept)), ",").alias("removed"),
    )


# -- secrets ---------------------------------------------------------------------


def scan_secrets(texts: DataFrame, text: str, keys: Sequence[str], rules=P.SECRET_RULES) -> DataFrame:
    """One row per key, rule and distinct secret; the value itself never leaves.

    A rule's literal is tested before its pattern, so clean texts cost one
    substring search per rule.
    """
    def hits_of(rule: str, literal: str, rx: str) -> Column:
        matches = F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0))
        tagged = F.transform(matches, lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("hit")))
        return F.when(F.contains(F.col(text), F.lit(literal)), tagged).otherwise(
            F.expr("cast(array() as array<struct<rule:string,hit:string>>)")
        )

    found = F.concat(*[hits_of(*rule) for rule in rules])
    return (
        texts.select(*keys, F.explode(found).alias("f"))
        .groupBy(*keys, F.col("f.rule").alias("rule"), F.sha2(F.col("f.hit"), 256).alias("secret_sha256"))
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.min(F.concat(F.substring("f.hit", 1, 4), F.lit("***"))).alias("redacted"),
        )
    )


def redact_secrets(texts: DataFrame, text: str, rules=P.SECRET_RULES) -> DataFrame:
    """The same rows with every secret replaced by its rule name."""
    out = F.col(text)
    for rule, _, rx in rules:
        out = F.regexp_replace(out, rx, f"[{rule}]")
    return texts.withColumn(text, out)


# -- issues ----------------------------------------------------------------------


def severity_gate(findings: DataFrame, floor: str = "high", keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Fail where a finding is at or above ``floor`` (low < moderate < high < critical)."""
    level = F.lower("severity")
    level = F.when(level == "medium", "moderate").otherwise(level)
    order = F.array(*[F.lit(s) for s in P.SEVERITY_ORDER])
    rank = F.array_position(order, level)
    limit = P.SEVERITY_ORDER.index(floor) + 1
    return (
        findings.withColumn("__rank", rank)
        .groupBy(*keys)
        .agg(F.max("__rank").alias("__max"), F.count_if(F.col("__rank") >= limit).alias("at_or_above"))
        .select(
            *keys,
            "at_or_above",
            F.when(F.col("__max") > 0, F.element_at(order, F.col("__max").cast("int"))).alias("max_severity"),
            (F.col("__max") >= limit).alias("failed"),
        )
    )


def triage_rules(issues: DataFrame, rules: Sequence[tuple[str, str, str]], defaults: Mapping[str, str]) -> DataFrame:
    """Fields of an issue from keyword rules ``(field, value, keyword)``; the first rule that hits wins."""
    whole = F.lower(F.concat_ws(" ", "title", "body"))
    out = issues.withColumn("__text", whole)
    for field, default in defaults.items():
        value: Column = F.lit(default)
        for name, result, word in reversed(rules):
            if name == field:
                value = F.when(F.contains("__text", F.lit(word.lower())), result).otherwise(value)
        out = out.withColumn(field, value)
    return out.drop("__text")


def propose_branches(issues: DataFrame, branches: DataFrame, cap: int = 50) -> DataFrame:
    """Branch name of each issue; an existing one is reported as skipped."""
    labels = parse_labels("labels")
    prefix = (
        F.when(F.array_contains(labels, "bug"), "fix/")
        .when(F.arrays_overlap(labels, F.array(F.lit("feature"), F.lit("enhancement"))), "feat/")
        .otherwise("chore/")
    )
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+", "")
    slug = F.regexp_replace(F.substring(slug, 1, cap), "-+$", "")
    known = branches.select("repo", "branch").distinct().withColumn("__known", F.lit(True))
    return (
        issues.withColumn("branch", F.concat(prefix, slug))
        .join(known, ["repo", "branch"], "left")
        .withColumn("status", F.when(F.col("__known"), "skipped").otherwise("create"))
        .drop("__known")
    )


# -- source lines ------------------------------------------------------------------


def extract_action_refs(lines: DataFrame) -> DataFrame:
    """Action and ref of every ``uses:`` line that is neither local nor an image.

    The match is generated once per line; lines without one produce no row.
    """
    pattern = r"^[ \t]*(?:-[ \t]+)?uses:[ \t]*([^\s#]+@[^\s#]*)"
    spec = F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))
    keep = [c for c in lines.columns if c != "line"]
    return (
        lines.filter(F.contains("line", F.lit("uses:")))
        .select(*keep, spec.alias("__raw"))
        .withColumn("__spec", F.translate("__raw", "\"'", ""))
        .filter(~F.col("__spec").startswith("./") & ~F.col("__spec").startswith("docker:"))
        .withColumn("ref", F.substring_index("__spec", "@", -1))
        .withColumn("action", F.expr("left(__spec, length(__spec) - length(ref) - 1)"))
        .filter("ref <> ''")
        .drop("__raw", "__spec")
    )


def unpinned_refs(refs: DataFrame) -> DataFrame:
    """References that are not a 40-hex commit."""
    return refs.filter(~F.col("ref").rlike("^[0-9a-f]{40}$"))


def extract_flags(lines: DataFrame, pattern: str = P.FLAG_PATTERN) -> DataFrame:
    """Flag names in code with the number of files that use them.

    ``(name, path)`` pairs are made distinct first, so the per-flag count is a
    plain partial aggregate.
    """
    in_code = lines.filter(F.col("path").rlike(P.extension_pattern(P.FLAG_EXTENSIONS)))
    calls = F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)))
    name = F.regexp_extract("call", "['\"]([^'\"]+)['\"]", 1)
    pairs = in_code.select("repo", "path", calls.alias("call")).select(name.alias("name"), "repo", "path").distinct()
    return pairs.filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_file"))
