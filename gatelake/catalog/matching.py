"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.registry import query
from gatelake.catalog.text import ACTION_REFS, CLOSING, FLAGS, LABELS, extract_action_refs, extract_flags
from gatelake.catalog.views import _TABLE, project, view
from gatelake.functions import patterns as P
from gatelake.operators import error_titles
from gatelake.operators import matching as m


def as_sql(text: str) -> str:
    return _TABLE.sub(r"\1", text).strip()


PINS = f"""{ACTION_REFS},
    pins AS (SELECT r.*, CASE WHEN NOT regexp_matches(ref, '^[0-9a-f]{{40}}$') THEN 'non-sha'
        WHEN status IN ('pending', 'deprecated') THEN status WHEN status IS NULL THEN 'unknown'
        WHEN NOT regexp_matches(sha, '^[0-9a-f]{{40}}$') THEN 'invalid-manifest'
        WHEN sha <> ref THEN 'mismatch' ELSE 'ok' END AS pin_status
      FROM refs r LEFT JOIN v_manifest USING (action) WHERE ref <> '')"""


@query("pin_consistency", f"WITH {PINS} SELECT * FROM pins")
def pin_consistency(spark, sf):
    return m.pin_consistency(extract_action_refs(spark, sf), view(spark, sf, "v_manifest"))


@query(
    "pin_totals",
    f"""WITH {PINS} SELECT coalesce(repo, 'ALL') AS repo, count(*) AS checked, count(*) FILTER (WHERE pin_status <> 'ok') AS errors
      FROM pins GROUP BY ROLLUP (repo)""",
)
def pin_totals(spark, sf):
    return m.pin_totals(pin_consistency(spark, sf))


STOP = ", ".join(f"'{w}'" for w in P.TITLE_STOP_WORDS)
WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
BARE = "regexp_replace(title, '(?i)^(bug|feature|feat|question|docs|chore|refactor|perf|ci|build|style):?\\s*', '')"


@query(
    "find_duplicates",
    f"""
    WITH b AS (SELECT repo, number, {WORDS.format("title")} AS words,
        list_filter({WORDS.format(BARE)}, lambda w: length(w) > 2 AND w NOT IN ({STOP}))[1:6] AS kws FROM v_issues),
    c AS (SELECT a.repo, a.number, b2.number AS candidate,
        row_number() OVER (PARTITION BY a.repo, a.number ORDER BY b2.number DESC) AS slot
      FROM b a JOIN b b2 ON a.repo = b2.repo AND len(a.kws) > 0 AND list_has_all(b2.words, a.kws))
    SELECT * FROM c WHERE slot <= 5 AND candidate <> number""",
)
def find_duplicates(spark, sf):
    return m.find_duplicates(view(spark, sf, "v_issues"))


@query(
    "similar_issues",
    f"""
    WITH b AS (SELECT repo, number, list_distinct({WORDS.format("title")}) AS w FROM v_issues),
    s AS (SELECT x.repo, x.number, y.number AS d, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) AS n
      FROM b x JOIN b y ON x.repo = y.repo AND y.number < x.number AND len(x.w) > 0 AND len(y.w) > 0),
    j AS (SELECT *, i / (n - i) AS sim FROM s WHERE i / (n - i) > 0.8)
    SELECT repo, number, arg_max(d, (sim, -d)) AS duplicate_of, round(max(sim), 9) AS similarity FROM j GROUP BY 1, 2""",
)
def similar_issues(spark, sf):
    return m.similar_issues(view(spark, sf, "v_issues")).withColumn("similarity", F.round("similarity", 9))


ERROR_SHAPE = """
    CASE user_id % 4 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'AbortError' WHEN 2 THEN 'KeyError' ELSE 'NetworkError' END AS exc_class,
    concat_ws('|', concat('f', user_id % 3), concat('g', event_id % 31), concat('h', user_id % 50), concat('i', event_id % 41),
      concat('j', event_id % 23), 'main') AS frames"""
ERROR_GROUPS = f"""
    SELECT event_id AS error_id, CASE WHEN event_id % 11 <> 0 THEN concat('fp-', user_id, '-', event_id % 3) END AS fingerprint,
      concat('Failed ', chr(CAST(97 + user_id % 26 AS INT)), chr(CAST(97 + event_id % 26 AS INT)), ' after ', event_id) AS title,
      {ERROR_SHAPE}, event_id % 9 AS count, event_id % 10 <> 0 AS app_frames, event_id % 13 = 0 AS bot_4xx, ts
    FROM {{events}} WHERE event_type = 'error'"""
KNOWN_ISSUES = f"""
    SELECT event_id AS number, CASE WHEN event_id % 5 <> 0 THEN concat('fp-', user_id, '-', event_id % 50) END AS fingerprint,
      concat('Failed ', chr(CAST(97 + user_id % 26 AS INT)), chr(CAST(97 + event_id % 26 AS INT)), ' after ', event_id) AS title,
      {ERROR_SHAPE}
    FROM {{events}} WHERE event_type = 'signup'"""


@query(
    "dedupe_errors",
    f"""
    WITH e AS ({as_sql(ERROR_GROUPS)}), k AS ({as_sql(KNOWN_ISSUES)}),
    e2 AS (SELECT *, string_split(frames, '|')[1:5] AS top, regexp_replace(lower(title), '[0-9]+', '#', 'g') AS plain,
      (exc_class IN ('AbortError', 'NetworkError') AND count < 5) OR NOT app_frames OR bot_4xx AS ignored FROM e),
    k2 AS (SELECT *, string_split(frames, '|')[1:5] AS top, regexp_replace(lower(title), '[0-9]+', '#', 'g') AS plain FROM k),
    p AS (SELECT error_id, number, CASE WHEN e2.fingerprint = k2.fingerprint THEN 9
        WHEN e2.exc_class <> k2.exc_class THEN 0
        WHEN len(list_intersect(e2.top, k2.top)) >= 3 THEN 3 + len(list_intersect(e2.top, k2.top))
        WHEN e2.plain = k2.plain THEN 4 ELSE 0 END AS strength FROM e2 JOIN k2 ON NOT ignored),
    b AS (SELECT error_id, max(strength) AS strength, arg_max(number, (strength, -number)) AS number FROM p WHERE strength > 0 GROUP BY 1)
    SELECT error_id, CASE WHEN ignored THEN 'ignore' WHEN b.number IS NULL THEN 'create' ELSE 'duplicate' END AS decision,
      b.number AS duplicate_of, b.strength FROM e2 LEFT JOIN b USING (error_id)""",
)
def dedupe_errors(spark, sf):
    frames = F.split("frames", r"\|")
    errors = project(spark, sf, ERROR_GROUPS).withColumn("frames", frames)
    return m.dedupe_errors(errors, project(spark, sf, KNOWN_ISSUES).withColumn("frames", frames))


TITLE = """concat('K', chr(CAST(97 + user_id % 11 AS INT)), ' m', chr(CAST(97 + event_id % 7 AS INT)), ': timeout of n', chr(CAST(97 + event_id % 5 AS INT)),
      ' and o', chr(CAST(97 + event_id % 3 AS INT)), ' after ', event_id)"""
TITLED_ERRORS = f"""
    SELECT event_id AS error_id, concat('e-', event_id) AS fingerprint, {TITLE} AS title, {ERROR_SHAPE}, event_id % 9 AS count, event_id % 10 <> 0 AS app_frames,
      event_id % 13 = 0 AS bot_4xx FROM {{events}} WHERE event_type = 'error'"""
TITLED_ISSUES = f"""
    SELECT event_id AS number, concat('i-', event_id) AS fingerprint, {TITLE} AS title, {ERROR_SHAPE} FROM {{events}} WHERE event_type = 'signup' AND event_id % 5 = 0"""
NOISE = "SELECT * FROM VALUES ('NetworkError', NULL, 5), ('*', 'k[b] *', 3), (NULL, '*nc*OA after*', 7), ('Type*', 'ka m*', NULL) AS n(exc_class, title, below)"


@query(
    "match_errors",
    f"""
    WITH e AS ({as_sql(TITLED_ERRORS)}), k AS ({as_sql(TITLED_ISSUES)}),
    e2 AS (SELECT *, string_split(frames, '|')[1:5] AS top, regexp_replace(lower(title), '[0-9]+', '#', 'g') AS plain,
      (exc_class IN ('AbortError', 'NetworkError') AND count < 5) OR NOT app_frames OR bot_4xx AS ignored,
      coalesce((exc_class = 'NetworkError' AND count < 5) OR (lower(title) LIKE 'k[b] %' AND count < 3) OR (lower(title) LIKE '%nc%oa after%' AND count < 7)
        OR (exc_class LIKE 'Type%' AND lower(title) LIKE 'ka m%'), false) AS noise FROM e),
    k2 AS (SELECT *, string_split(frames, '|')[1:5] AS top, regexp_replace(lower(title), '[0-9]+', '#', 'g') AS plain FROM k),
    p AS (SELECT error_id, number, CASE WHEN e2.exc_class <> k2.exc_class THEN 0 WHEN len(list_intersect(e2.top, k2.top)) >= 3 THEN 3 + len(list_intersect(e2.top, k2.top))
        WHEN e2.plain = k2.plain THEN 4 ELSE 0 END AS strength FROM e2 JOIN k2 ON NOT ignored),
    b AS (SELECT error_id, max(strength) AS strength, arg_max(number, (strength, -number)) AS number FROM p WHERE strength > 0 GROUP BY 1),
    ew AS (SELECT e2.*, b.strength, b.number, list_sort(list_distinct(regexp_extract_all(plain, '[a-z#]+'))) AS words FROM e2 LEFT JOIN b USING (error_id)),
    kw AS (SELECT exc_class, list_sort(list_distinct(regexp_extract_all(plain, '[a-z#]+'))) AS other, min(number) AS number FROM k2 GROUP BY ALL),
    look AS (SELECT DISTINCT exc_class, words FROM ew WHERE NOT ignored AND NOT noise AND number IS NULL),
    sets AS (SELECT words FROM look UNION SELECT other FROM kw),
    wt AS (SELECT word, greatest(1, round(1000 * log2(1 + (SELECT count(*) FROM sets)::DOUBLE / count(*))))::BIGINT AS weight
      FROM (SELECT unnest(words) AS word FROM sets) GROUP BY word),
    total AS (SELECT words, sum(weight)::BIGINT AS sum FROM (SELECT words, unnest(words) AS word FROM sets) JOIN wt USING (word) GROUP BY words),
    shared AS (SELECT l.exc_class, l.words, kw.other, kw.number, unnest(list_intersect(l.words, kw.other)) AS word FROM look l JOIN kw ON kw.exc_class = l.exc_class),
    common AS (SELECT exc_class, words, other, number, sum(weight)::BIGINT AS c FROM shared JOIN wt USING (word) GROUP BY ALL),
    near AS (SELECT x.*, c / (a.sum + o.sum - c) AS similarity FROM common x JOIN total a ON a.words = x.words JOIN total o ON o.words = x.other
      WHERE c / (a.sum + o.sum - c) >= 0.7),
    best AS (SELECT exc_class, words, arg_max(number, (similarity, -number)) AS near_number, max(similarity) AS similarity FROM near GROUP BY 1, 2)
    SELECT error_id, CASE WHEN ignored OR noise THEN 'ignore' WHEN ew.number IS NOT NULL OR near_number IS NOT NULL THEN 'duplicate' ELSE 'create' END AS decision,
      CASE WHEN NOT ignored AND NOT noise THEN coalesce(ew.number, near_number) END AS duplicate_of,
      CASE WHEN NOT ignored AND NOT noise THEN coalesce(strength, CASE WHEN near_number IS NOT NULL THEN 2 END) END AS strength,
      CASE WHEN NOT ignored AND NOT noise AND ew.number IS NULL THEN round(similarity, 9) END AS similarity
    FROM ew LEFT JOIN best ON best.exc_class = ew.exc_class AND best.words = ew.words""",
)
def match_errors(spark, sf):
    frames = F.split("frames", r"\|")
    errors = project(spark, sf, TITLED_ERRORS).withColumn("frames", frames)
    issues = project(spark, sf, TITLED_ISSUES).withColumn("frames", frames)
    matched = error_titles.match_errors(errors, issues, spark.sql(NOISE))
    return matched.withColumn("similarity", F.round("similarity", 9))


PRIORITY = "CASE event_id % 4 WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' WHEN 2 THEN 'p2' ELSE 'p3' END"


@query(
    "correlate_deploys",
    f"""
    WITH e AS (SELECT event_id, service, ts, {PRIORITY} AS priority FROM v_errors),
    d AS (SELECT DISTINCT service, ts FROM v_deploys),
    a AS (SELECT e.event_id, max(d.ts) AS dts FROM e JOIN d ON d.service = e.service AND d.ts <= e.ts
      AND d.ts >= e.ts - INTERVAL 30 MINUTE GROUP BY 1)
    SELECT event_id, service, priority, dts IS NOT NULL AS deploy_related, strftime(dts, '%Y-%m-%d %H:%M:%S') AS deploy_ts,
      dts IS NOT NULL AND priority IN ('p0', 'p1') AS suggest_rollback FROM e LEFT JOIN a USING (event_id)""",
)
def correlate_deploys(spark, sf):
    errors = view(spark, sf, "v_errors").select("event_id", "service", "ts", F.expr(PRIORITY).alias("priority"))
    out = m.correlate_deploys(errors, view(spark, sf, "v_deploys"))
    return out.drop("ts").withColumn("deploy_ts", F.date_format("deploy_ts", "yyyy-MM-dd HH:mm:ss"))


FIXES = f"""
    f AS (SELECT pr, deployed_at, unnest(list_distinct(regexp_extract_all(body, '(?i){CLOSING}[ \\t\\r\\f]+#([0-9]+)', 1))) AS ref FROM v_fix_deploys),
    v AS (SELECT pr, f.ref, count(e.ts) AS events FROM f LEFT JOIN v_errors e
      ON e.ref = CAST(f.ref AS BIGINT) AND e.ts > deployed_at AND e.ts <= deployed_at + INTERVAL 1 DAY GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN events = 0 THEN 'confirmed' ELSE 'regressed' END AS status FROM v)"""


@query("verify_fixes", f"WITH {FIXES} SELECT * FROM s")
def verify_fixes(spark, sf):
    errors = view(spark, sf, "v_errors").withColumn("ref", F.col("ref").cast("string"))
    return m.verify_fixes(view(spark, sf, "v_fix_deploys"), errors, minutes=1440)


@query(
    "fix_verdicts",
    f"""WITH {FIXES} SELECT pr, coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (WHERE status = 'confirmed'), 'none') AS confirmed,
      coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (WHERE status = 'regressed'), 'none') AS regressed FROM s GROUP BY 1""",
)
def fix_verdicts(spark, sf):
    return m.fix_verdicts(verify_fixes(spark, sf))


@query(
    "correlate_cves",
    """
    WITH u AS (SELECT repo, pr, unnest(list_distinct(string_split_regex(lower(title), '[^a-z0-9@/._-]+'))) AS package FROM v_update_prs
      WHERE state = 'open' AND author IN ('renovate[bot]', 'dependabot[bot]')),
    i AS (SELECT repo, package, min(pr) AS upgrade_pr FROM u GROUP BY 1, 2),
    f AS (SELECT repo, cve, package, count(*) AS findings FROM v_findings GROUP BY 1, 2, 3)
    SELECT repo, cve, package, findings, upgrade_pr,
      CASE WHEN upgrade_pr IS NULL THEN 'manual' ELSE concat('upgrade PR #', upgrade_pr) END AS advice
    FROM f LEFT JOIN i USING (repo, package)""",
)
def correlate_cves(spark, sf):
    updates = view(spark, sf, "v_update_prs").filter(F.col("author").isin("renovate[bot]", "dependabot[bot]"))
    return m.correlate_cves(view(spark, sf, "v_findings"), updates)


@query(
    "flag_lifecycle",
    f"""
    WITH {FLAGS}, j AS (SELECT coalesce(c.name, r.name) AS name, n_files AS n, coalesce(n_files, 0) AS n_files,
        CASE WHEN c.name IS NULL OR r.name IS NULL THEN 'orphaned' WHEN status = 'archived' AND days_since_eval >= 30 THEN 'dead'
          WHEN rolled_out_pct = 100 AND days_full > 30 AND days_since_eval >= 7 THEN 'stale' ELSE 'active' END AS state
      FROM flags c FULL JOIN v_registry r ON c.name = r.name)
    SELECT name, n_files, state, CASE WHEN state = 'dead' AND n_files > 5 THEN 'high' WHEN state = 'stale' THEN 'medium'
      WHEN state = 'orphaned' AND n_files < 3 THEN 'low' ELSE 'none' END AS priority FROM j""",
)
def flag_lifecycle(spark, sf):
    return m.flag_lifecycle(extract_flags(spark, sf), view(spark, sf, "v_registry"))


DISPATCHES = """
    SELECT o_orderkey AS run_id, concat('task-', o_custkey % 400) AS task,
      CASE o_orderkey % 5 WHEN 0 THEN 'custom-event' WHEN 1 THEN '' END AS event_type FROM {orders}"""
TASKS = """
    SELECT concat('task-', p_partkey % 300) AS name, CASE p_partkey % 300 % 3 WHEN 0 THEN 'nightly' END AS event_type FROM {part}"""


@query(
    "undeclared_tasks",
    f"""
    WITH d AS ({as_sql(DISPATCHES)}), t AS (SELECT name, min(event_type) AS ev FROM ({as_sql(TASKS)}) GROUP BY 1)
    SELECT run_id, task, name IS NOT NULL AS declared, CASE WHEN name IS NOT NULL
      THEN coalesce(nullif(event_type, ''), ev, 'agent-task') END AS event_type FROM d LEFT JOIN t ON d.task = t.name""",
)
def undeclared_tasks(spark, sf):
    return m.undeclared_tasks(project(spark, sf, DISPATCHES), project(spark, sf, TASKS))


ENTRIES = """
    SELECT concat('task-', p_partkey % 700) AS name, p_partkey % 4 AS source_order, concat(p_name, '/', p_partkey) AS payload FROM {part}"""


@query(
    "merge_registries",
    f"""
    WITH e AS ({as_sql(ENTRIES)})
    SELECT 'earliest' AS keep, name, arg_min(source_order, (source_order, payload)) AS source_order, arg_min(payload, (source_order, payload)) AS payload FROM e GROUP BY 2
    UNION ALL
    SELECT 'latest', name, arg_max(source_order, (source_order, payload)), arg_max(payload, (source_order, payload)) FROM e GROUP BY 2""",
)
def merge_registries(spark, sf):
    entries = project(spark, sf, ENTRIES)
    sides = [m.merge_registries(entries, k).select(F.lit(k).alias("keep"), "*") for k in ("earliest", "latest")]
    return sides[0].unionByName(sides[1])


@query(
    "concurrent_deploys",
    """
    WITH r AS (SELECT concurrency_group, run_id, min(started_at) AS s, max(ended_at) AS e FROM v_jobs GROUP BY 1, 2),
    c AS (SELECT a.concurrency_group, a.run_id, count(b.run_id) AS others FROM r a LEFT JOIN r b
      ON a.concurrency_group = b.concurrency_group AND a.run_id <> b.run_id AND b.s <= a.s AND b.e > a.s GROUP BY 1, 2)
    SELECT *, others > 0 AS blocked FROM c""",
)
def concurrent_deploys(spark, sf):
    runs = view(spark, sf, "v_jobs").groupBy("concurrency_group", "run_id").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at")
    )
    return m.concurrent_deploys(runs).drop("started_at", "ended_at")


@query(
    "unrecorded_prs",
    """
    WITH l AS (SELECT repo, max(ts) AS last FROM v_commits WHERE path LIKE 'docs/p4%' GROUP BY 1),
    p AS (SELECT repo, pr, merged_at + INTERVAL 1000 DAY AS merged_at FROM v_prs),
    r AS (SELECT repo, pr, merged_at, row_number() OVER (PARTITION BY repo ORDER BY merged_at DESC, pr DESC) AS rank
      FROM p JOIN l USING (repo) WHERE merged_at > last)
    SELECT repo, pr, strftime(merged_at, '%Y-%m-%d') AS merged_at, rank FROM r WHERE rank <= 20""",
)
def unrecorded_prs(spark, sf):
    prs = view(spark, sf, "v_prs").withColumn("merged_at", F.expr("merged_at + INTERVAL 1000 DAY"))
    changelog = view(spark, sf, "v_commits").filter(F.col("path").startswith("docs/p4"))
    return m.unrecorded_prs(prs, changelog).withColumn("merged_at", F.date_format("merged_at", "yyyy-MM-dd"))


GRAPH = """
    SELECT concat('repo-', o_orderkey // 500) AS repo, concat('c', o_orderkey) AS sha,
      CASE WHEN o_orderkey % 500 > 3 THEN concat('c', o_orderkey - 1 - o_orderkey % 3) END AS parent,
      o_custkey % 29 = 0 AS has_path
    FROM {orders}"""


@query(
    "nearest_ancestor_with",
    f"""
    WITH RECURSIVE g AS ({as_sql(GRAPH)}),
    w AS (SELECT repo, sha, sha AS cur, has_path, parent, 0 AS distance FROM g
      UNION ALL SELECT w.repo, w.sha, g.sha, g.has_path, g.parent, w.distance + 1 FROM w JOIN g
        ON g.repo = w.repo AND g.sha = w.parent WHERE NOT w.has_path AND w.distance < 19)
    SELECT repo, sha, max(cur) FILTER (WHERE has_path) AS ancestor, max(distance) FILTER (WHERE has_path) AS distance FROM w GROUP BY 1, 2""",
)
def nearest_ancestor_with(spark, sf):
    return m.nearest_ancestor_with(project(spark, sf, GRAPH.replace("//", "div")))


REPEAT_ACTIONS = """
    SELECT event_id AS action_id, CASE event_id % 4 WHEN 0 THEN 'incident' WHEN 1 THEN 'audit' WHEN 2 THEN 'ci_failure'
      ELSE 'sticky' END AS kind, concat('issue-', user_id) AS target, concat('run:', event_id % 5) AS marker, ts AS at
    FROM {events} WHERE event_type <> 'signup'"""
REPEAT_EXISTING = """
    SELECT concat('issue-', user_id + event_id % 2 * 20) AS target, concat('run:', event_id % 7) AS marker, event_id % 3 = 0 AS is_open, ts AS at
    FROM {events} WHERE event_type = 'signup'"""


@query(
    "suppress_repeats",
    f"""
    WITH a AS ({as_sql(REPEAT_ACTIONS)}), x AS ({as_sql(REPEAT_EXISTING)}),
    mk AS (SELECT target, marker, bool_or(is_open) AS o FROM x GROUP BY 1, 2), tg AS (SELECT DISTINCT target, true AS any_mark FROM x),
    r AS (SELECT action_id, count(*) AS n FROM a JOIN x ON a.target = x.target AND a.marker = x.marker AND x.is_open AND x.at <= a.at
      AND x.at >= a.at - INTERVAL 48 HOUR GROUP BY 1)
    SELECT action_id, kind, CASE kind WHEN 'incident' THEN CASE WHEN o THEN 'skip' ELSE 'create' END
      WHEN 'audit' THEN CASE WHEN any_mark THEN 'skip' ELSE 'create' END
      WHEN 'ci_failure' THEN CASE WHEN n > 0 THEN 'comment' ELSE 'create' END
      ELSE CASE WHEN o IS NOT NULL THEN 'update' ELSE 'create' END END AS decision
    FROM a LEFT JOIN mk USING (target, marker) LEFT JOIN tg USING (target) LEFT JOIN r USING (action_id)""",
)
def suppress_repeats(spark, sf):
    out = m.suppress_repeats(project(spark, sf, REPEAT_ACTIONS), project(spark, sf, REPEAT_EXISTING), hours=48)
    return out.select("action_id", "kind", "decision")


ENV_MATRIX = """
    SELECT p_partkey, concat('| VAR_', p_partkey, ' | ', CASE p_size % 3 WHEN 0 THEN 'staging' WHEN 1 THEN 'staging, production'
      ELSE ' dev ,production' END, ' | ', p_brand, ' | note |') AS line FROM {part}"""
ENV_PRESENT = """
    SELECT concat('VAR_', p_partkey) AS var, CASE p_size % 2 WHEN 0 THEN 'staging' ELSE 'production' END AS env FROM {part}"""
MATRIX = """
    mx AS (SELECT concat('VAR_', p_partkey) AS var, unnest(CASE p_size % 3 WHEN 0 THEN ['staging'] WHEN 1 THEN ['staging', 'production']
      ELSE ['dev', 'production'] END) AS env, p_brand AS source FROM part)"""


def env_matrix(spark, sf):
    from gatelake.sources.reports import parse_env_matrix

    return parse_env_matrix(project(spark, sf, ENV_MATRIX).select("line"))


query("read_env_matrix", f"WITH {MATRIX} SELECT * FROM mx")(env_matrix)


@query(
    "missing_env",
    f"""WITH {MATRIX}, p AS ({as_sql(ENV_PRESENT)}) SELECT var, env, source FROM mx WHERE NOT EXISTS
      (SELECT 1 FROM p WHERE p.var = mx.var AND p.env = mx.env)""",
)
def missing_env(spark, sf):
    return m.missing_env(env_matrix(spark, sf), project(spark, sf, ENV_PRESENT))
