"""Text audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.registry import query
from gatelake.catalog.views import project, view
from gatelake.functions import patterns as P
from gatelake.operators import text_policy as tp

BLANKS = r"[ \t\r\f]+"
CLOSING = r"(?:close[sd]?|fix(?:es|ed)?|resolve[sd]?)"
LABELS = "list_filter(list_transform(string_split_regex({0}, '[,\\n]'), lambda x: lower(trim(x))), lambda x: x <> '')"

TITLES = f"""
    t AS (SELECT pr, repo, title, regexp_matches(title, '{P.TITLE_PATTERN}') AS valid,
      regexp_extract(title, '{P.TITLE_PATTERN}', 1) AS type,
      regexp_replace(regexp_extract(title, '{P.TITLE_PATTERN}', 2), '[()]', '', 'g') AS scope,
      regexp_extract(title, '{P.TITLE_PATTERN}', 3) = '!' AS breaking FROM v_prs)"""


@query("audit_titles", f"WITH {TITLES} SELECT * FROM t")
def audit_titles(spark, sf):
    return tp.audit_titles(view(spark, sf, "v_prs").select("pr", "repo", "title"))


@query(
    "title_totals",
    f"""WITH {TITLES} SELECT coalesce(repo, 'ALL') AS repo, count(*) AS titles, count(*) FILTER (WHERE valid) AS valid,
      count(*) FILTER (WHERE breaking) AS breaking FROM t GROUP BY ROLLUP (repo)""",
)
def title_totals(spark, sf):
    return tp.title_totals(audit_titles(spark, sf))


@query(
    "audit_commit_messages",
    f"""
    WITH m AS (SELECT number, string_split(title, chr(10))[1] AS s, body FROM v_issues),
    e AS (SELECT *, s[1:6] = 'Merge ' OR s[1:7] = 'Revert ' OR s[1:7] = 'fixup! ' OR s[1:8] = 'squash! ' AS exempt FROM m)
    SELECT number, exempt, exempt OR regexp_matches(s, '{P.SUBJECT_PATTERN}') AS valid_form,
      NOT exempt AND length(s) > 72 AS too_long,
      len(list_filter(string_split(body, chr(10)), lambda x: length(x) > 100)) AS long_body_lines FROM e""",
)
def audit_commit_messages(spark, sf):
    commits = view(spark, sf, "v_issues").select("number", F.col("title").alias("subject"), "body")
    return tp.audit_commit_messages(commits).drop("subject", "body")


@query(
    "audit_descriptions",
    f"""
    WITH l AS (SELECT pr, CASE WHEN list_contains({LABELS.format("labels")}, 'no-issue') THEN 'no-issue'
        WHEN regexp_matches(body, '(?i){CLOSING}{BLANKS}(?:\\[?#|GH-)[0-9]+') THEN 'issue'
        WHEN regexp_matches(body, '(?i){CLOSING}{BLANKS}[A-Za-z0-9._-]+/[A-Za-z0-9._-]+#[0-9]+') THEN 'cross-repo'
        ELSE 'missing' END AS link FROM v_prs)
    SELECT pr, link, link <> 'missing' AS passed FROM l""",
)
def audit_descriptions(spark, sf):
    return tp.audit_descriptions(view(spark, sf, "v_prs")).select("pr", "link", "passed")


@query(
    "with_trust",
    """SELECT author_assoc, author_assoc IN ('OWNER', 'MEMBER', 'COLLABORATOR') AS trusted, count(*) AS prs
       FROM v_prs GROUP BY 1, 2""",
)
def with_trust(spark, sf):
    return tp.with_trust(view(spark, sf, "v_prs")).groupBy("author_assoc", "trusted").agg(F.count(F.lit(1)).alias("prs"))


@query(
    "parse_labels",
    f"SELECT pr, array_to_string({LABELS.format('labels')}, '|') AS labels FROM v_prs",
)
def parse_labels(spark, sf):
    return view(spark, sf, "v_prs").select("pr", F.array_join(tp.parse_labels("labels"), "|").alias("labels"))


REFS = f"list_sort(list_distinct(regexp_extract_all(body, '(?i){CLOSING}{BLANKS}#([0-9]+)', 1)))"


@query("extract_fix_refs", f"SELECT pr, unnest({REFS}) AS ref FROM v_prs")
def extract_fix_refs(spark, sf):
    return tp.extract_fix_refs(view(spark, sf, "v_prs").select("pr", "body")).drop("body")


@query("fix_ref_lists", f"SELECT pr, array_to_string({REFS}, ',') AS refs FROM v_prs")
def fix_ref_lists(spark, sf):
    return tp.fix_ref_lists(view(spark, sf, "v_prs").select("pr", "body")).drop("body")


@query(
    "auto_merge_candidates",
    f"""SELECT pr, repo FROM v_prs WHERE author = 'renovate[bot]' AND list_contains({LABELS.format("labels")}, 'patch')""",
)
def auto_merge_candidates(spark, sf):
    return tp.auto_merge_candidates(view(spark, sf, "v_prs")).select("pr", "repo")


COMMANDS = ", ".join(f"'{c}'" for c in P.COMMANDS)


@query(
    "parse_commands",
    f"""
    WITH l AS (SELECT comment_id, author_assoc, regexp_extract(body, '(?m)^[ \\t\\r\\f\\v]*(/[a-z-][^\\n]*)', 1) AS line FROM v_comments),
    w AS (SELECT *, string_split(line, ' ')[1][2:] AS word FROM l),
    k AS (SELECT *, word IN ({COMMANDS}) AS known FROM w)
    SELECT comment_id, CASE WHEN known THEN word ELSE 'none' END AS command,
      CASE WHEN known THEN regexp_replace(line[length(word) + 3:], '\\s+$', '') ELSE '' END AS args,
      known AND (word = 'help' OR author_assoc IN ('OWNER', 'MEMBER', 'COLLABORATOR')) AS authorized FROM k""",
)
def parse_commands(spark, sf):
    return tp.parse_commands(view(spark, sf, "v_comments")).select("comment_id", "command", "args", "authorized")


FILES = """
    SELECT doc_id, concat('dir/', CASE doc_id % 7 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN '.env.local'
        WHEN 3 THEN 'data.json' WHEN 4 THEN 'notes.md' WHEN 5 THEN 'run.sh' ELSE 'blob.bin' END) AS path,
      CASE WHEN doc_id % 7 = 3 AND doc_id % 2 = 0 THEN concat('{"n": ', n_chars, ', "ok": [true, null]}') ELSE text END AS content,
      n_chars * 40 AS size_bytes, n_chars % 3 <> 0 AS ends_with_newline
    FROM {documents}"""
FILES_SQL = FILES.replace("{documents}", "documents")


@query(
    "audit_file_policy",
    f"""
    WITH f AS ({FILES_SQL}),
    v AS (SELECT doc_id, path, size_bytes, ends_with_newline, array_to_string(list_filter([
        CASE WHEN doc_id % 7 IN (0, 2) THEN 'dotenv' END, CASE WHEN size_bytes > 524288 THEN 'large' END,
        CASE WHEN doc_id % 7 IN (3, 4, 5) AND NOT ends_with_newline THEN 'no-newline' END,
        CASE WHEN doc_id % 7 = 3 AND trim(content) <> '' AND NOT json_valid(content) THEN 'bad-json' END],
        lambda x: x IS NOT NULL), ',') AS violations FROM f)
    SELECT * FROM v WHERE violations <> ''""",
)
def audit_file_policy(spark, sf):
    return tp.audit_file_policy(project(spark, sf, FILES))


@query(
    "classify_paths",
    """
    SELECT repo, count(*) FILTER (WHERE regexp_matches(path, '\\.(ts|tsx|js|py|go|java|rs)$')) AS code_files,
      count(*) FILTER (WHERE regexp_matches(path, '\\.(md|mdx)$')) AS doc_files,
      count(*) FILTER (WHERE NOT regexp_matches(path, '\\.(ts|tsx|js|py|go|java|rs|md|mdx)$')) AS other_files
    FROM v_paths GROUP BY 1""",
)
def classify_paths(spark, sf):
    return tp.classify_paths(view(spark, sf, "v_paths"))


MARKERS = """
    SELECT concat('site-', page_id) AS repo, CASE page_id % 8 WHEN 0 THEN 'package.json' WHEN 1 THEN 'pyproject.toml'
      WHEN 2 THEN 'go.mod' WHEN 3 THEN 'pom.xml' WHEN 4 THEN 'build.gradle.kts' WHEN 5 THEN 'build.gradle'
      WHEN 6 THEN 'requirements.txt' ELSE 'README.md' END AS path FROM {pages}
    UNION ALL
    SELECT concat('site-', page_id), CASE page_id % 5 WHEN 0 THEN 'yarn.lock' WHEN 1 THEN 'pnpm-lock.yaml'
      WHEN 2 THEN '.nvmrc' WHEN 3 THEN 'uv.lock' ELSE '.python-version' END FROM {pages}
    UNION ALL
    SELECT concat('site-', page_id), CASE page_id % 3 WHEN 0 THEN 'src/Main.java' WHEN 1 THEN 'build/Main.java'
      ELSE 'app/Main.kt' END FROM {pages}"""


@query(
    "detect_stack",
    """
    SELECT concat('site-', page_id) AS repo,
      CASE page_id % 8 WHEN 0 THEN 'node' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'java'
        WHEN 4 THEN CASE WHEN page_id % 3 = 0 THEN 'java' ELSE 'kotlin' END
        WHEN 5 THEN CASE WHEN page_id % 3 = 2 THEN 'kotlin' ELSE 'java' END
        WHEN 6 THEN 'python' ELSE 'unknown' END AS language,
      CASE page_id % 8 WHEN 0 THEN CASE page_id % 5 WHEN 0 THEN 'yarn' WHEN 1 THEN 'pnpm' ELSE 'npm' END
        WHEN 1 THEN CASE WHEN page_id % 5 = 3 THEN 'uv' ELSE 'pip' END WHEN 2 THEN 'go-mod' WHEN 3 THEN 'maven'
        WHEN 4 THEN 'gradle-kts' WHEN 5 THEN 'gradle' WHEN 6 THEN CASE WHEN page_id % 5 = 3 THEN 'uv' ELSE 'pip' END
        ELSE 'unknown' END AS package_manager,
      CASE page_id % 8 WHEN 0 THEN CASE WHEN page_id % 5 = 2 THEN '.nvmrc' ELSE '' END
        WHEN 1 THEN CASE WHEN page_id % 5 = 4 THEN '.python-version' ELSE '' END WHEN 2 THEN 'go.mod' WHEN 3 THEN 'pom.xml'
        WHEN 4 THEN 'build.gradle.kts' WHEN 5 THEN 'build.gradle'
        WHEN 6 THEN CASE WHEN page_id % 5 = 4 THEN '.python-version' ELSE '' END ELSE '' END AS version_file
    FROM pages""",
)
def detect_stack(spark, sf):
    return tp.detect_stack(project(spark, sf, MARKERS))


LABEL_RULES = {"Docs": ["**/*.md", "**/*.mdx"], "backend": ["en/**/*.py", "**/*.go"], "frontend": ["*/*/app.t?"]}


@query(
    "label_prs",
    r"""
    WITH p AS (SELECT page_id, list_filter(string_split(labels, ','), lambda x: x <> '') AS cur,
        list_filter([CASE WHEN regexp_matches(path, '\.mdx?$') THEN 'Docs' END,
          CASE WHEN regexp_matches(path, '^en/(.*/)?[^/]*\.py$|\.go$') THEN 'backend' END,
          CASE WHEN regexp_matches(path, '^[^/]*/[^/]*/app\.t[^/]$') THEN 'frontend' END], lambda x: x IS NOT NULL) AS want
      FROM v_paths),
    lw AS (SELECT *, list_transform(want, lambda x: lower(x)) AS lwant FROM p),
    k AS (SELECT *, list_filter(cur, lambda x: x NOT IN ('docs', 'backend', 'frontend') OR list_contains(lwant, x)) AS kept,
      list_filter(want, lambda x: NOT list_contains(cur, lower(x))) AS fresh FROM lw),
    f AS (SELECT *, list_sort(list_concat(kept, fresh)) AS fin FROM k)
    SELECT page_id, array_to_string(fin, ',') AS labels,
      array_to_string(list_sort(fresh), ',') AS added,
      array_to_string(list_sort(list_filter(cur, lambda x: NOT list_contains(fin, x))), ',') AS removed FROM f""",
)
def label_prs(spark, sf):
    return tp.label_prs(view(spark, sf, "v_paths"), LABEL_RULES, ["page_id"])


SECRETS = " UNION ALL ".join(
    f"SELECT number, '{rule}' AS rule, unnest(regexp_extract_all(body, '{rx}', 0)) AS hit FROM v_issues"
    for rule, _, rx in P.SECRET_RULES
)


@query(
    "scan_secrets",
    f"""WITH s AS ({SECRETS}) SELECT number, rule, sha256(hit) AS secret_sha256, count(*) AS hits,
      min(concat(substr(hit, 1, 4), '***')) AS redacted FROM s GROUP BY 1, 2, 3""",
)
def scan_secrets(spark, sf):
    return tp.scan_secrets(view(spark, sf, "v_issues"), "body", ["number"])


@query(
    "redact_secrets",
    "SELECT number, md5(" + "regexp_replace(" * len(P.SECRET_RULES) + "body"
    + "".join(f", '{rx}', '[{rule}]', 'g')" for rule, _, rx in P.SECRET_RULES) + ") AS body_md5 FROM v_issues",
)
def redact_secrets(spark, sf):
    clean = tp.redact_secrets(view(spark, sf, "v_issues").select("number", "body"), "body")
    return clean.select("number", F.md5("body").alias("body_md5"))


@query(
    "severity_gate",
    """
    WITH r AS (SELECT repo, package, list_position(['low', 'medium', 'high', 'critical'], lower(severity)) AS k FROM v_findings)
    SELECT repo, package, count(*) FILTER (WHERE k >= 3) AS at_or_above,
      ['low', 'moderate', 'high', 'critical'][max(k)] AS max_severity, max(k) >= 3 AS failed FROM r GROUP BY 1, 2""",
)
def severity_gate(spark, sf):
    return tp.severity_gate(view(spark, sf, "v_findings"), "high", ["repo", "package"])


TRIAGE = [
    ("type", "security", "secret"), ("type", "docs", "licen"), ("type", "feature", "feature"), ("type", "bug", "bug"),
    ("type", "bug", "fix"), ("priority", "p0", "worthless"), ("priority", "p1", "token"), ("priority", "p2", "fix"),
    ("complexity", "L", "the"), ("complexity", "M", "und"),
]
TRIAGE_DEFAULTS = {"type": "question", "priority": "p3", "complexity": "S"}


@query(
    "triage_rules",
    "SELECT number, "
    + ", ".join(
        "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{v}'" for n, v, w in TRIAGE if n == field) + f" ELSE '{d}' END AS {field}"
        for field, d in TRIAGE_DEFAULTS.items()
    )
    + " FROM (SELECT number, lower(concat(title, ' ', body)) AS t FROM v_issues)",
)
def triage_rules(spark, sf):
    issues = view(spark, sf, "v_issues").select("number", "title", "body")
    return tp.triage_rules(issues, TRIAGE, TRIAGE_DEFAULTS).drop("title", "body")


BRANCH_LABELS = "CASE pr % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'Enhancement, ci' WHEN 2 THEN 'feature' ELSE 'ci' END"


@query(
    "propose_branches",
    f"""
    WITH i AS (SELECT pr, repo, author, concat(title, ' no. ', pr % 30, ': a rather long explanation of it') AS title, {BRANCH_LABELS} AS labels FROM v_prs),
    b AS (SELECT pr, repo, author, concat(CASE pr % 4 WHEN 0 THEN 'fix/' WHEN 3 THEN 'chore/' ELSE 'feat/' END,
      regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+', '')[1:50], '-+$', '')) AS branch FROM i),
    k AS (SELECT DISTINCT repo, branch FROM b WHERE author = 'dependabot[bot]')
    SELECT pr, repo, branch, CASE WHEN k.branch IS NULL THEN 'create' ELSE 'skipped' END AS status
    FROM b LEFT JOIN k USING (repo, branch)""",
)
def propose_branches(spark, sf):
    """The update bot has its branches already."""
    title = F.concat("title", F.lit(" no. "), F.col("pr") % 30, F.lit(": a rather long explanation of it"))
    issues = view(spark, sf, "v_prs").select(
        "pr", "repo", "author", title.alias("title"), F.expr(BRANCH_LABELS).alias("labels")
    )
    none = issues.select("repo", F.lit("").alias("branch")).filter("false")
    existing = tp.propose_branches(issues.filter("author = 'dependabot[bot]'"), none).select("repo", "branch")
    return tp.propose_branches(issues, existing).select("pr", "repo", "branch", "status")


ACTION_REFS = r"""
    u AS (SELECT repo, path, line_no, regexp_replace(regexp_extract(line, '^[ \t]*(?:-[ \t]+)?uses:[ \t]*([^\s#]+@[^\s#]*)', 1), '["'']', '', 'g') AS spec
      FROM v_source_lines),
    refs AS (SELECT repo, path, line_no, regexp_extract(spec, '^(.*)@', 1) AS action, regexp_extract(spec, '@([^@]*)$', 1) AS ref
      FROM u WHERE spec <> '' AND NOT regexp_matches(spec, '^(\./|docker:)'))"""


@query("extract_action_refs", f"WITH {ACTION_REFS} SELECT * FROM refs WHERE ref <> ''")
def extract_action_refs(spark, sf):
    return tp.extract_action_refs(view(spark, sf, "v_source_lines"))


@query(
    "unpinned_refs",
    f"""WITH {ACTION_REFS} SELECT repo, count(*) AS unpinned FROM refs WHERE ref <> '' AND NOT regexp_matches(ref, '^[0-9a-f]{{40}}$') GROUP BY 1""",
)
def unpinned_refs(spark, sf):
    return tp.unpinned_refs(extract_action_refs(spark, sf)).groupBy("repo").agg(F.count(F.lit(1)).alias("unpinned"))


FLAGS = r"""
    calls AS (SELECT repo, path, unnest(regexp_extract_all(line, 'flag\([''"]([^''"]+)[''"]', 1)) AS name FROM v_code_lines
      WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|py|go)$')),
    flags AS (SELECT name, count(DISTINCT (repo, path)) AS n_files, min(path) AS first_file FROM calls GROUP BY 1)"""


@query("extract_flags", f"WITH {FLAGS} SELECT * FROM flags")
def extract_flags(spark, sf):
    return tp.extract_flags(view(spark, sf, "v_code_lines"))
