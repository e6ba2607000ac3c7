"""Release queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.matching import as_sql
from gatelake.catalog.registry import query
from gatelake.catalog.views import project, view
from gatelake.operators import history
from gatelake.operators import release as r

RANKED = """
    n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha DESC) AS rn FROM v_commits WHERE subject NOT LIKE 'Merge %')"""


@query(
    "newest_commits",
    f"WITH {RANKED} SELECT repo, sha, subject, author FROM n WHERE rn <= 200",
)
def newest_commits(spark, sf):
    return r.newest_commits(view(spark, sf, "v_commits"), ["repo"]).select("repo", "sha", "subject", "author")


@query(
    "read_commits",
    f"WITH {RANKED} SELECT repo, sha, subject, author FROM n WHERE rn <= 200",
)
def read_commits(spark, sf):
    from gatelake.session import shared_dir
    from gatelake.sources.reports import read_commits as reader

    path = shared_dir(spark, "commit-log")
    log = view(spark, sf, "v_commits").select("repo", "sha", "subject", "author", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    log.write.csv(path, sep="\t", quote="", escape="")
    return r.newest_commits(reader(spark, path), ["repo"]).select("repo", "sha", "subject", "author")


BREAK = "(regexp_extract(subject, '^([a-z]+)(?:\\([^)]*\\))?(!?): ', 2) = '!' OR contains(coalesce(body, ''), 'BREAKING CHANGE:'))"


@query(
    "changelog",
    f"""
    WITH p AS (SELECT pr, labels FROM v_prs), c AS (SELECT v.*, p.labels AS l FROM (SELECT * REPLACE (CASE body WHEN '' THEN '' ELSE body END AS body) FROM v_commits) v
        LEFT JOIN p ON v.pr = p.pr WHERE subject NOT LIKE 'Merge %'),
    s AS (SELECT repo, release_no, ts, sha, concat('- ', regexp_replace(subject, '^([a-z]+)(?:\\([^)]*\\))?(!?): ', ''), '. (#', pr, ')') AS bullet,
        CASE WHEN {BREAK} OR list_has_any(list_transform(string_split(coalesce(l, ''), ','), lambda x: trim(x)), ['breaking-change', 'major']) THEN 'Breaking Changes'
          WHEN contains(lower(concat(subject, ' ', body)), 'security') THEN 'Security'
          ELSE CASE regexp_extract(subject, '^([a-z]+)(?:\\([^)]*\\))?(!?): ', 1) WHEN 'feat' THEN 'Added' WHEN 'fix' THEN 'Fixed' WHEN 'revert' THEN 'Fixed'
            WHEN 'refactor' THEN 'Changed' WHEN 'perf' THEN 'Changed' WHEN 'build' THEN 'Changed' END END AS section FROM c),
    o AS (SELECT *, list_position(['Breaking Changes', 'Added', 'Changed', 'Fixed', 'Security'], section) AS section_no FROM s WHERE section IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY section_no, ts DESC, sha) AS rn FROM o)
    SELECT repo, section, section_no, count(*) AS bullets, string_agg(bullet, chr(10) ORDER BY rn) AS text
    FROM k WHERE rn <= 30 GROUP BY 1, 2, 3""",
)
def changelog(spark, sf):
    prs = view(spark, sf, "v_prs").select("pr", "labels")
    return r.changelog(view(spark, sf, "v_commits"), prs, ["repo"])


@query(
    "changelog_by_release",
    f"""
    WITH s AS (SELECT repo, release_no, ts, sha, concat('- ', regexp_replace(subject, '^([a-z]+)(?:\\([^)]*\\))?(!?): ', ''), '. (#', pr, ')') AS bullet,
        CASE WHEN {BREAK} THEN 'Breaking Changes' WHEN contains(lower(subject), 'security') THEN 'Security'
          ELSE CASE regexp_extract(subject, '^([a-z]+)(?:\\([^)]*\\))?(!?): ', 1) WHEN 'feat' THEN 'Added' WHEN 'fix' THEN 'Fixed'
            WHEN 'perf' THEN 'Changed' END END AS section FROM v_commits WHERE subject NOT LIKE 'Merge %'),
    o AS (SELECT *, list_position(['Breaking Changes', 'Added', 'Changed', 'Fixed', 'Security'], section) AS section_no FROM s WHERE section IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY repo, release_no ORDER BY section_no, ts DESC, sha) AS rn FROM o)
    SELECT repo, release_no, section, section_no, count(*) AS bullets, string_agg(bullet, chr(10) ORDER BY rn) AS text
    FROM k WHERE rn <= 30 GROUP BY 1, 2, 3, 4""",
)
def changelog_by_release(spark, sf):
    return r.changelog(view(spark, sf, "v_commits"))


TAGS = """
    SELECT concat('repo-', p_partkey % 1500) AS repo, CASE WHEN p_partkey % 11 = 0 THEN 'nightly'
      ELSE concat('v', p_size % 5, '.', p_partkey % 30, '.', p_partkey % 7) END AS tag FROM {part}"""


@query(
    "version_bump",
    f"""
    WITH k AS (SELECT * REPLACE (concat('repo-', pr) AS repo) FROM v_commits),
    c AS (SELECT repo, max(CASE WHEN {BREAK} THEN 3
        WHEN regexp_extract(subject, '^([a-z]+)(?:\\([^)]*\\))?(!?): ', 1) = 'feat' THEN 2 ELSE 1 END) AS level FROM k GROUP BY 1),
    t AS (SELECT repo, max([CAST(x AS BIGINT) FOR x IN string_split(tag[2:], '.')]) AS v FROM ({as_sql(TAGS)}) WHERE tag <> 'nightly' GROUP BY 1),
    z AS (SELECT repo, level, v AS found, coalesce(v, [0, 0, 0]) AS v FROM c LEFT JOIN t USING (repo))
    SELECT repo, CASE level WHEN 3 THEN 'major' WHEN 2 THEN 'minor' ELSE 'patch' END AS bump,
      CASE WHEN found IS NULL THEN '' ELSE concat('v', v[1], '.', v[2], '.', v[3]) END AS previous,
      CASE level WHEN 3 THEN concat('v', v[1] + 1, '.0.0') WHEN 2 THEN concat('v', v[1], '.', v[2] + 1, '.0')
        ELSE concat('v', v[1], '.', v[2], '.', v[3] + 1) END AS next
    FROM z""",
)
def version_bump(spark, sf):
    commits = view(spark, sf, "v_commits").withColumn("repo", F.concat(F.lit("repo-"), "pr"))
    return r.version_bump(commits, project(spark, sf, TAGS))


CHANGES = """
    SELECT concat('repo-', l_suppkey) AS repo, concat(CASE l_partkey % 40 WHEN 0 THEN 'docs/p' WHEN 1 THEN 'src/test/p' WHEN 2 THEN 'api/v'
        WHEN 3 THEN 'openapi/' ELSE 'src/p' END, l_partkey, CASE l_partkey % 40 WHEN 0 THEN '.md' WHEN 3 THEN '.yml' WHEN 4 THEN '.mdx' ELSE '.py' END) AS path,
      l_quantity > 40 AS is_merge, l_shipdate AS ts FROM {lineitem}
    UNION ALL SELECT concat('repo-', l_suppkey), 'CHANGELOG.md', false, l_shipdate - INTERVAL 200 DAY FROM {lineitem} WHERE l_discount > 0.09"""
DRIFT = f"""
    ch AS ({as_sql(CHANGES)}), fl AS (SELECT repo, path, max(ts) AS ts FROM ch GROUP BY 1, 2),
    la AS (SELECT repo, max(ts) FILTER (WHERE regexp_matches(path, '\\.md$') OR path LIKE 'docs/%') AS ld, max(ts) FILTER (WHERE regexp_matches(path, '\\.mdx$')) AS lm FROM fl GROUP BY 1),
    cf AS (SELECT repo, path, ld, lm FROM fl JOIN la USING (repo) WHERE CASE WHEN ld IS NULL THEN regexp_matches(path, '\\.(ts|js|py|go)$')
      ELSE ts > ld AND regexp_matches(path, '\\.(ts|tsx|js|py|go|java|rs|rb|php)$') AND NOT regexp_matches(path, '(test|spec|mock|fixture|__tests__)') END),
    rk AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM cf),
    drift AS (SELECT repo, count(*) AS code_files, max(ld) IS NULL OR coalesce(max(lm) <= max(ld), true) AS drift,
      string_agg(path, ',' ORDER BY path) FILTER (WHERE rn <= 50 AND (rn <= 20 OR ld IS NOT NULL)) AS files FROM rk GROUP BY 1)"""


@query(
    "doc_drift",
    f"""WITH {DRIFT} SELECT repo, coalesce(code_files, 0) AS code_files, coalesce(drift, false) AS drift, coalesce(files, '') AS files
      FROM (SELECT DISTINCT repo FROM ch) LEFT JOIN drift USING (repo)""",
)
def doc_drift(spark, sf):
    return r.doc_drift(project(spark, sf, CHANGES))


@query(
    "spec_staleness",
    f"""
    WITH {DRIFT}, st AS (SELECT repo, coalesce(max(ts) FILTER (WHERE path LIKE 'api/%') > max(ts) FILTER (WHERE path LIKE 'openapi/%'), false) AS api_stale,
        coalesce(max(ts) FILTER (WHERE is_merge) > max(ts) FILTER (WHERE path = 'CHANGELOG.md'), false) AS changelog_stale FROM ch GROUP BY 1)
    SELECT repo, api_stale, changelog_stale, coalesce(drift, false) AS drift, coalesce(drift, false) OR api_stale OR changelog_stale AS needs_update
    FROM st LEFT JOIN drift USING (repo)""",
)
def spec_staleness(spark, sf):
    changes = project(spark, sf, CHANGES)
    return r.needs_update(r.doc_drift(changes), r.spec_staleness(changes, "api/", "openapi/"))


BUDGET_FILES = """
    SELECT source AS repo, concat('src/', lang, '/', doc_id, '.py') AS path, n_chars AS size_bytes FROM {documents}"""


@query(
    "context_budget",
    f"""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM ({as_sql(BUDGET_FILES)})),
    c AS (SELECT repo, path, size_bytes, strlen(path) + 9 + least(size_bytes, 2048) + 1 AS cost FROM f WHERE rn <= 50),
    w AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM c)
    SELECT repo, path, size_bytes, cost, greatest(0, least(cost, 30720 - (upto - cost))) AS used FROM w""",
)
def context_budget(spark, sf):
    return r.context_budget(project(spark, sf, BUDGET_FILES))


@query(
    "cap_bytes",
    "SELECT number, least(octet_length(encode(body)), 2048) AS capped_bytes, md5(encode(body)[1:2048]) AS capped_md5 FROM v_issues",
)
def cap_bytes(spark, sf):
    capped = r.cap_bytes("body", r.FILE_BYTES)
    return view(spark, sf, "v_issues").select(
        "number", F.octet_length(capped).cast("bigint").alias("capped_bytes"), F.md5(capped).alias("capped_md5")
    )


@query(
    "deploy_event_feeds",
    """
    WITH d AS (SELECT deploy_id, service, env, version, git_sha, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM v_deploys)
    SELECT deploy_id, 'release' AS provider, concat('{"version":"', version, '","projects":[],"refs":[{"repository":"github","commit":"', git_sha, '"}]}') AS payload FROM d
    UNION ALL SELECT deploy_id, 'event', concat('{"title":"Deploy ', service, ' ', version, ' → ', env, '","text":"git sha: ', git_sha,
      '","alert_type":"info","source_type_name":"github","tags":["env:', env, '","version:', version, '","app:', service, '"]}') FROM d
    UNION ALL SELECT deploy_id, 'capture', concat('{"event":"deploy","distinct_id":"ci-system","properties":{"environment":"', env, '","version":"', version,
      '","git_sha":"', git_sha, '","app":"', service, '"}}') FROM d
    UNION ALL SELECT deploy_id, 'run_tag', concat('{"name":"deploy:', version, '","session_name":"delivery","run_type":"tool","extra":{"metadata":{"environment":"', env,
      '","version":"', version, '","git_sha":"', git_sha, '","kind":"deploy-marker"}}}') FROM d
    UNION ALL SELECT deploy_id, 'ndjson', concat('{"_time":"', stamp, '","kind":"deploy","environment":"', env, '","version":"', version, '","git_sha":"', git_sha,
      '","app":"', service, '"}') FROM d""",
)
def deploy_event_feeds(spark, sf):
    return r.deploy_event_feeds(view(spark, sf, "v_deploys"))


# A history for each of twenty repositories: commits 4, 5 and 6 of every ten are a side branch
# that leaves at commit 2 and is merged by commit 7; every hundredth commit has a tag.
HISTORY = """
    SELECT concat('repo-', o_custkey % 20) AS repo, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS n,
      concat('c', o_orderkey) AS sha,
      concat(CASE o_orderkey % 11 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'fix(api): ' WHEN 2 THEN 'docs: ' ELSE 'chore: ' END, lower(o_orderpriority)) AS subject,
      CASE WHEN o_orderkey % 101 = 7 THEN 'BREAKING CHANGE: x' ELSE '' END AS body
    FROM {orders}"""
GRAPH = f"""
    WITH RECURSIVE h AS ({as_sql(HISTORY)}),
    e AS (SELECT repo, n AS child, unnest(CASE WHEN n = 0 THEN [] WHEN n % 10 = 4 THEN [n - 2] WHEN n % 10 = 7 THEN [n - 4, n - 1] ELSE [n - 1] END) AS parent FROM h),
    t AS (SELECT repo, n, n // 100 AS no FROM h WHERE n % 100 = 99),
    a AS (SELECT repo, no, n FROM t UNION SELECT a.repo, a.no, e.parent FROM a JOIN e ON e.repo = a.repo AND e.child = a.n),
    f AS (SELECT repo, n, min(no) AS no FROM a GROUP BY repo, n),
    hi AS (SELECT repo, max(no) AS hi FROM t GROUP BY repo),
    ranges AS (SELECT h.*, f.no, hi, CASE WHEN f.no IS NULL THEN hi ELSE f.no - 1 END AS before FROM h LEFT JOIN f USING (repo, n) LEFT JOIN hi USING (repo))"""


def history_tables(spark, sf):
    rows = project(spark, sf, HISTORY)
    parent = "CASE WHEN n = 0 THEN array() WHEN n % 10 = 4 THEN array(n - 2) WHEN n % 10 = 7 THEN array(n - 4, n - 1) ELSE array(n - 1) END"
    edges = rows.select("repo", "sha", F.posexplode_outer(F.expr(parent)).alias("nth", "n"))
    named = edges.join(rows.select("repo", "n", F.col("sha").alias("parent")), ["repo", "n"], "left")
    listed = named.groupBy("repo", "sha").agg(F.sort_array(F.collect_list(F.struct("nth", "parent"))).alias("p"))
    parents = listed.select("repo", "sha", F.expr("filter(transform(p, x -> x.parent), x -> x IS NOT NULL)").alias("parents"))
    tags = rows.filter("n % 100 = 99").select("repo", F.expr("concat('v1.', n div 100, '.0')").alias("tag"), "sha")
    return rows.select("repo", "sha", "subject", "body").join(parents, ["repo", "sha"]), tags


@query(
    "commit_ranges",
    GRAPH + """ SELECT repo, sha, CASE WHEN no IS NOT NULL THEN concat('v1.', no, '.0') END AS tag,
      CASE WHEN before >= 0 THEN concat('v1.', before, '.0') END AS previous FROM ranges""",
)
def commit_ranges(spark, sf):
    return history.commit_ranges(*history_tables(spark, sf))


@query(
    "next_release",
    GRAPH + f""", c AS (SELECT repo, any_value(hi) AS hi, max(CASE WHEN {BREAK} THEN 3 WHEN subject LIKE 'feat: %' THEN 2 ELSE 1 END) AS level FROM ranges WHERE no IS NULL GROUP BY repo)
    SELECT repo, CASE level WHEN 3 THEN 'major' WHEN 2 THEN 'minor' ELSE 'patch' END AS bump, CASE WHEN hi IS NULL THEN '' ELSE concat('v1.', hi, '.0') END AS previous,
      CASE WHEN hi IS NULL THEN CASE level WHEN 3 THEN 'v1.0.0' WHEN 2 THEN 'v0.1.0' ELSE 'v0.0.1' END
        ELSE CASE level WHEN 3 THEN 'v2.0.0' WHEN 2 THEN concat('v1.', hi + 1, '.0') ELSE concat('v1.', hi, '.1') END END AS next FROM c""",
)
def next_release(spark, sf):
    return history.next_release(*history_tables(spark, sf))
