"""Projections of the driver tables onto the silver tables of this library.

Each text runs unchanged in Spark SQL and in DuckDB. ``{table}`` is a
placeholder for a base table; a view may also refer to no other view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gatelake.session import configure

VIEWS: dict[str, str] = {
    "v_prs": """
        SELECT o_orderkey AS pr, concat('repo-', o_custkey % 20) AS repo,
          CASE o_orderkey % 7 WHEN 0 THEN 'renovate[bot]' WHEN 1 THEN 'dependabot[bot]'
            ELSE concat('user', o_custkey % 50) END AS author,
          CASE o_custkey % 5 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'MEMBER' WHEN 2 THEN 'COLLABORATOR'
            WHEN 3 THEN 'CONTRIBUTOR' ELSE 'NONE' END AS author_assoc,
          concat(CASE o_orderkey % 10 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'fix(api): '
            WHEN 2 THEN 'Feat: ' WHEN 3 THEN 'docs: ' WHEN 4 THEN 'refactor!: ' WHEN 5 THEN 'update '
            WHEN 6 THEN concat('chore(deps): bump pkg', o_custkey % 200, ' ')
            WHEN 7 THEN 'fix (x): ' WHEN 8 THEN 'perf(core/io): ' ELSE 'revert: ' END,
            lower(o_orderpriority)) AS title,
          CASE o_orderkey % 6 WHEN 0 THEN concat('Closes #', o_custkey, ' and Fixes #', o_orderkey % 1000)
            WHEN 1 THEN concat('resolves GH-', o_custkey) WHEN 2 THEN concat('fixed acme/app#', o_custkey)
            WHEN 3 THEN concat('see #', o_custkey)
            WHEN 4 THEN concat('FIXES #', o_custkey, ', fixes #', o_custkey) ELSE '' END AS body,
          CASE o_orderkey % 9 WHEN 0 THEN 'major' WHEN 1 THEN 'minor, ci' WHEN 2 THEN 'patch'
            WHEN 3 THEN ' No-Issue ' WHEN 4 THEN 'breaking-change,patch' ELSE '' END AS labels,
          o_orderdate AS merged_at
        FROM {orders}""",
    "v_jobs": """
        SELECT concat('repo-', l_suppkey % 20) AS repo, l_orderkey AS run_id,
          CASE l_linenumber WHEN 1 THEN 'lint' WHEN 2 THEN 'test' WHEN 3 THEN 'coverage'
            WHEN 4 THEN 'scan_secrets' WHEN 5 THEN 'validate_pr_title' WHEN 6 THEN 'scan_deps'
            ELSE 'build' END AS job,
          CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failure' ELSE 'skipped' END AS conclusion,
          concat('pr-', l_orderkey % 500) AS concurrency_group,
          l_shipdate AS started_at, l_shipdate + INTERVAL 3 DAY AS ended_at,
          l_partkey AS step_id
        FROM {lineitem}""",
    "v_findings": """
        SELECT concat('repo-', l_suppkey % 20) AS repo, concat('CVE-2024-', l_partkey) AS cve,
          concat('pkg', l_partkey % 200) AS package,
          CASE WHEN l_quantity >= 48 THEN 'CRITICAL' WHEN l_quantity >= 40 THEN 'HIGH'
            WHEN l_quantity >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity
        FROM {lineitem}""",
    "v_counts": """
        SELECT event_id, concat('svc-', user_id % 5) AS service, ts, event_type AS category,
          CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
          value / 1000.0 AS latency_s,
          CASE event_type WHEN 'error' THEN 503 ELSE 200 END AS http_code,
          event_id % 10 + 1 AS attempt, user_id
        FROM {events}""",
    "v_deploys": """
        SELECT event_id AS deploy_id, concat('svc-', user_id % 5) AS service,
          CASE event_id % 2 WHEN 0 THEN 'staging' ELSE 'production' END AS env,
          concat('sha256:', event_id % 300) AS digest, concat('v1.', user_id % 40, '.', event_id % 10) AS version,
          md5(concat('c', event_id)) AS git_sha, ts
        FROM {events} WHERE event_type = 'signup'""",
    "v_errors": """
        SELECT event_id, concat('svc-', user_id % 5) AS service, concat('fp-', user_id % 40) AS fingerprint,
          user_id AS ref, ts
        FROM {events} WHERE event_type = 'error'""",
    "v_fix_deploys": """
        SELECT event_id AS pr, concat('svc-', user_id % 5) AS service,
          CASE user_id % 3 WHEN 0 THEN concat('Fixes #', user_id) WHEN 1
            THEN concat('closes #', user_id, ' and resolved #', user_id + 1) ELSE 'no reference' END AS body,
          ts AS deployed_at
        FROM {events} WHERE event_type = 'signup'""",
    "v_queue": """
        SELECT o_orderkey AS entry_id, concat('sha256:', o_custkey) AS digest,
          concat('app-', o_custkey % 20) AS app,
          CASE WHEN o_orderkey % 97 = 0 THEN 'NOT-A-DATE'
            ELSE concat(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10), 'T00:00:00Z') END AS stg_deploy_time,
          30 + 1440 * (o_orderkey % 3) AS observation_minutes, o_orderdate AS queued_at
        FROM {orders}""",
    "v_comments": """
        SELECT conv_id * 1000 + turn AS comment_id, conv_id, turn,
          CASE conv_id % 5 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'MEMBER' WHEN 2 THEN 'COLLABORATOR'
            WHEN 3 THEN 'CONTRIBUTOR' ELSE 'NONE' END AS author_assoc,
          CASE (conv_id + turn) % 8 WHEN 0 THEN concat('/assign @u', turn)
            WHEN 1 THEN concat('text', chr(10), '  /label bug  ') WHEN 2 THEN '/Close'
            WHEN 3 THEN concat('/foo', chr(10), '/close') WHEN 4 THEN concat('/help', chr(10), text)
            WHEN 5 THEN concat(text, chr(10), '/close') ELSE text END AS body
        FROM {conversations}""",
    "v_issues": """
        SELECT doc_id AS number, source AS repo,
          concat(CASE doc_id % 4 WHEN 0 THEN 'fix: ' WHEN 1 THEN 'Feature ' WHEN 2 THEN 'BUG: '
            ELSE '' END, text) AS title,
          text AS body, lang
        FROM {documents}""",
    "v_commits": """
        SELECT concat('repo-', l_suppkey % 20) AS repo,
          md5(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_extendedprice, '-', l_shipdate)) AS sha,
          concat(CASE l_linenumber WHEN 1 THEN 'feat: ' WHEN 2 THEN 'fix: ' WHEN 3 THEN 'feat!: '
            WHEN 4 THEN 'docs: ' WHEN 5 THEN 'perf(x): ' WHEN 6 THEN 'Merge ' ELSE 'security patch ' END,
            l_partkey) AS subject,
          concat('user', l_suppkey % 50) AS author,
          concat(CASE l_linenumber WHEN 1 THEN 'docs/p' WHEN 2 THEN 'src/test/p' ELSE 'src/p' END,
            l_partkey % 50, CASE l_linenumber WHEN 1 THEN '.md' ELSE '.py' END) AS path,
          l_orderkey % 1000 AS release_no, l_orderkey AS pr,
          CASE WHEN l_quantity >= 49 THEN 'BREAKING CHANGE: drops an option' ELSE '' END AS body,
          l_shipdate AS ts
        FROM {lineitem}""",
    "v_manifest": """
        SELECT concat('org/act-', p_partkey) AS action,
          CASE WHEN p_partkey % 25 = 0 THEN '1234567890abcdef'
            ELSE concat(md5(concat('a', p_partkey)), substr(md5(concat('b', p_partkey)), 1, 8)) END AS sha,
          CASE WHEN p_partkey % 10 = 3 THEN 'pending' WHEN p_partkey % 10 = 4 THEN 'deprecated'
            ELSE 'verified' END AS status
        FROM {part}""",
    "v_source_lines": """
        SELECT concat('repo-', l_suppkey % 20) AS repo, concat('.ci/w', l_orderkey % 300, '.yml') AS path,
          l_orderkey * 10 + l_linenumber AS line_no,
          CASE l_linenumber
            WHEN 1 THEN concat('      - uses: org/act-', l_partkey, '@v4')
            WHEN 2 THEN concat('        uses: "org/act-', l_partkey, '@main"  # branch')
            WHEN 3 THEN concat('      - uses: org/act-', l_partkey, '@', md5('x'), '00000000')
            WHEN 4 THEN '      - uses: ./local/step'
            WHEN 5 THEN concat('    uses: org/act-', l_partkey * 11, '@', md5(concat('a', l_partkey)), '11111111')
            WHEN 6 THEN '        run: echo uses nothing'
            ELSE concat('      - uses: org/act-', l_partkey, '@', md5(concat('a', l_partkey)),
              substr(md5(concat('b', l_partkey)), 1, 8), '  # pinned') END AS line
        FROM {lineitem}""",
    "v_code_lines": """
        SELECT concat('repo-', l_suppkey % 20) AS repo,
          concat('src/f', l_orderkey % 300, CASE l_linenumber % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py'
            WHEN 2 THEN '.go' ELSE '.md' END) AS path,
          l_orderkey AS line_no,
          CASE WHEN l_linenumber < 4 THEN concat('if (flag(''flag-', l_partkey + l_linenumber * 500, ''')) go(flag("flag-', l_suppkey, '"))')
            ELSE concat('call(', l_partkey, ')') END AS line
        FROM {lineitem}""",
    "v_registry": """
        SELECT concat('flag-', p_partkey) AS name,
          CASE WHEN p_size % 7 = 0 THEN 'archived' ELSE 'live' END AS status,
          CASE WHEN p_size > 25 THEN 100 ELSE p_size * 3 END AS rolled_out_pct,
          p_size * 2 AS days_full, p_partkey % 60 AS days_since_eval
        FROM {part}""",
    "v_paths": """
        SELECT page_id, concat('site-', page_id % 20) AS repo,
          concat(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://[^/]+/', ''),
            CASE page_id % 6 WHEN 0 THEN '/index.md' WHEN 1 THEN '/app.ts' WHEN 2 THEN '/main.py'
              WHEN 3 THEN '/lib.go' WHEN 4 THEN '/notes.mdx' ELSE '/data.csv' END) AS path,
          CASE page_id % 3 WHEN 0 THEN 'docs,stale' WHEN 1 THEN 'backend' ELSE '' END AS labels
        FROM {pages}""",
}

#: Requests with their state: finished orders are merged, those in progress closed without it.
VIEWS["v_update_prs"] = VIEWS["v_prs"].replace(
    "o_orderdate AS merged_at",
    "o_orderdate AS merged_at, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'merged' ELSE 'Closed' END AS state",
)

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_TABLE = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named projection over the parquet tables in ``sf_dir``."""
    return project(spark, sf_dir, VIEWS[name])


def project(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in set(_TABLE.findall(text))}
    # Only table placeholders are formatted; other braces belong to the text.
    quoted = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\{(" + _TABLE.pattern + r")\}", r"\1", quoted), **frames)


def with_views(sql: str) -> str:
    """Prefix an oracle query with the views it mentions, as DuckDB CTEs."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({_TABLE.sub(r'\1', VIEWS[v]).strip()})" for v in used)
    if not ctes:
        return sql.strip()
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
