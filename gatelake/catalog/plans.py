"""Plan queries; plans and transcripts are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.matching import as_sql
from gatelake.catalog.registry import query
from gatelake.catalog.views import project, view
from gatelake.plans import documents, evaluate, extract, prompts
from gatelake.plans import schemas as S

#: action JSON, its audit line (NULL for none), error, blocked without trust, needs an issue
ISSUE_ACTIONS = [
    ('{"id":"1","skill":"add_label","params":{"labels":["bug","area/x"]}}', "add_label: bug, area/x", None, False, True),
    ('{"id":"2","skill":"add_label","params":{"labels":[]}}', None, None, False, True),
    ('{"id":"3","skill":"set_priority","params":{"labels":["priority:p1"]}}', "set_priority: p1", None, False, True),
    ('{"id":"4","skill":"set_priority","params":{"priority":"p9"}}', None, None, False, True),
    ('{"id":"5","skill":"close_issue","params":{"reason":"not_planned"}}', "close_issue", None, True, True),
    ('{"id":"6","skill":"create_branch","params":{"branch":"fix/a"}}', "create_branch: fix/a", None, True, False),
    ('{"id":"7","skill":"create_branch","params":{"branch":"fix/known"}}', "create_branch skipped: fix/known exists", None, True, False),
    ('{"id":"8","skill":"dispatch_mcp_task","params":{"name":"sync"}}', "dispatch_mcp_task: sync", None, True, False),
    ('{"id":"9","skill":"dispatch_mcp_task","params":{"task":"ghost"}}', None, "dispatch_mcp_task task is not declared: ghost", True, False),
    ('{"id":"10","skill":"schedule_followup","params":{"delay_days":2}}', "schedule_followup: 2024-01-03T00:00:00.000Z", None, False, False),
    ('{"id":"11","skill":"schedule_followup","params":{"days":91}}', None, "schedule_followup requires due_at or days between 1 and 90", False, False),
    ('{"id":"12","skill":"launch_rocket","params":{}}', None, "Unknown issue agent skill: launch_rocket", False, True),
    ('{"id":"13","skill":"mark_duplicate","params":{"duplicateOf":77}}', "mark_duplicate: #77", None, False, True),
    ('{"id":"14","skill":"assign_issue","params":{"assignee":"kim"}}', "assign_issue: kim", None, False, True),
    ('{"id":"15","skill":"notify","params":{"channel":"ops"}}', "notify skipped: slack-webhook-url is not configured", None, False, False),
    ('{"id":"16","skill":"link_linear","params":{"identifier":"AB-1"}}', "link_linear: AB-1", None, False, False),
]
N = len(ISSUE_ACTIONS)
STEPS = (0, 3, 7)


def action_at(offset: int, actions=ISSUE_ACTIONS, key: str = "o_orderkey") -> str:
    arms = " ".join(f"WHEN {i} THEN '{a[0]}'" for i, a in enumerate(actions))
    return f"CASE ({key} + {offset}) % {len(actions)} {arms} END"


ASSOC = "CASE o_custkey % 4 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'NONE' WHEN 2 THEN '' ELSE 'CONTRIBUTOR' END"
ISSUE_PLANS = f"""
    SELECT o_orderkey AS run_id, concat('repo-', o_custkey % 20) AS repo, {ASSOC} AS author_assoc,
      CASE WHEN o_custkey % 9 <> 0 THEN o_orderkey + 1 END AS issue_number, true AS has_tracker_token, false AS has_webhook,
      concat('{{"version":"', CASE WHEN o_orderkey % 101 = 0 THEN 'v0' ELSE '{S.VERSIONS["issue"]}' END, '","reasoning":"r","actions":[',
        {", ',', ".join(action_at(s) for s in STEPS)}, '],"skip_reason":null}}') AS plan_json
    FROM {{orders}}"""


def _quote(value) -> str:
    return "NULL" if value is None else "'" + value + "'"


ACTION_ROWS = ", ".join(
    f"({i}, {_quote(line)}, {_quote(error)}, {str(risk).lower()}, {str(mutates).lower()}, '{json.split(chr(34))[7]}')"
    for i, (json, line, error, risk, mutates) in enumerate(ISSUE_ACTIONS)
)


@query(
    "evaluate_issue_plans",
    f"""
    WITH t(k, line, error, risk, mutates, skill) AS (VALUES {ACTION_ROWS}),
    p AS (SELECT o_orderkey AS run_id, {ASSOC} AS assoc, o_custkey % 9 = 0 AS no_number, o_orderkey % 101 = 0 AS old FROM orders),
    s(pos, step) AS (VALUES {", ".join(f"({i}, {s})" for i, s in enumerate(STEPS))}),
    a AS (SELECT p.*, pos, skill, mutates, CASE WHEN risk AND assoc IN ('NONE', 'CONTRIBUTOR') THEN 'blocked' ELSE 'run' END AS how, line, error
      FROM p CROSS JOIN s JOIN t ON t.k = (run_id + step) % {N}),
    m AS (SELECT run_id, bool_or(mutates) AS mut FROM a GROUP BY 1),
    pe AS (SELECT run_id, assoc, CASE WHEN old THEN 'Unsupported plan version: v0'
        WHEN no_number AND mut THEN 'Plan contains issue mutations but no issue number is available' END AS plan_error FROM p JOIN m USING (run_id)),
    l AS (SELECT run_id, pos, CASE WHEN how = 'blocked' THEN 'blocked' WHEN error IS NOT NULL THEN 'error' WHEN line LIKE '% skipped:%' THEN 'skipped' ELSE 'done' END AS status,
        CASE WHEN how = 'blocked' THEN concat('blocked ', skill, ': actor association ', a.assoc, ' is not trusted') WHEN error IS NOT NULL THEN error ELSE line END AS line
      FROM a JOIN pe USING (run_id) WHERE plan_error IS NULL),
    e AS (SELECT run_id, min(pos) AS stop FROM l WHERE status = 'error' GROUP BY 1),
    k AS (SELECT run_id, pos, status, line FROM l LEFT JOIN e USING (run_id) WHERE line IS NOT NULL AND (stop IS NULL OR pos <= stop)
      UNION ALL SELECT run_id, 0, 'error', plan_error FROM pe WHERE plan_error IS NOT NULL)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS seq, status, line FROM k""",
)
def evaluate_issue_plans(spark, sf):
    plans = project(spark, sf, ISSUE_PLANS)
    repos = view(spark, sf, "v_prs").select("repo").distinct()
    tasks = repos.select("repo", F.lit("sync").alias("name"))
    branches = repos.select("repo", F.lit("fix/known").alias("branch"))
    return evaluate.evaluate_issue_plans(plans, tasks, branches, "2024-01-01 00:00:00")


#: action JSON, executed line, high risk
PR_ACTIONS = [
    ('{"skill":"add_label","params":{"labels":["a","b"]},"confidence":"high"}', "add_label: a, b", False),
    ('{"skill":"add_label","params":{"labels":["c"]},"confidence":"medium"}', None, False),
    ('{"skill":"block_merge","params":{"reason":"x"},"confidence":"high"}', "block_merge", True),
    ('{"skill":"escalate","params":{},"confidence":"high"}', "escalate: needs-human", True),
    ('{"skill":"unknown_skill","params":{},"confidence":"high"}', None, False),
    ('{"skill":"request_changes","params":{"body":""},"confidence":"high"}', None, True),
    ('{"skill":"add_reviewer","params":{"reviewers":["kim"]},"confidence":"high"}', "add_reviewer", False),
]
PR_PLANS = f"""
    SELECT o_orderkey AS run_id, {ASSOC} AS author_assoc, o_custkey % 2 = 0 AS has_summary,
      concat('{{"version":"', CASE WHEN o_orderkey % 101 = 0 THEN 'v0' ELSE '{S.VERSIONS["pr"]}' END, '","summary":"s","actions":[',
        {action_at(0, PR_ACTIONS)}, ',', {action_at(2, PR_ACTIONS)}, '],"skip_reason":', CASE WHEN o_custkey % 10 = 0 THEN '"no-key"' ELSE 'null' END, '}}') AS plan_json
    FROM {{orders}}"""
PR_LINE = lambda offset: (
    f"CASE (o_orderkey + {offset}) % {len(PR_ACTIONS)} "
    + " ".join(
        f"WHEN {i} THEN " + (f"CASE WHEN {ASSOC} = 'OWNER' THEN '{line}' END" if risk else f"'{line}'")
        for i, (_, line, risk) in enumerate(PR_ACTIONS)
        if line
    )
    + " END"
)


@query(
    "evaluate_pr_plans",
    f"""
    SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 101 = 0 THEN 'error' WHEN o_custkey % 2 = 0 THEN 'update' ELSE 'create' END AS summary_comment,
      CASE WHEN o_custkey % 10 = 0 AND o_orderkey % 101 <> 0 THEN 'no-key' END AS skip_reason,
      CASE WHEN o_orderkey % 101 = 0 OR o_custkey % 10 = 0 THEN '' ELSE concat_ws('; ', {PR_LINE(0)}, {PR_LINE(2)}) END AS executed
    FROM orders""",
)
def evaluate_pr_plans(spark, sf):
    out = evaluate.evaluate_pr_plans(project(spark, sf, PR_PLANS))
    return out.withColumn("executed", F.array_join("executed", "; "))


DOC_PLANS = f"""
    SELECT conv_id * 100 + turn AS run_id, concat('{{"version":"{S.VERSIONS["docs"]}","summary":"s","updates":[',
      '{{"id":"1","type":"modify","file":"', CASE turn % 3 WHEN 0 THEN 'docs/a.md' WHEN 1 THEN 'README.md' ELSE 'src/a.py' END,
      '","section":"## Two","reason":"r","content":"## Two\\n\\nnew ', conv_id, '\\n","confidence":"high"}},',
      '{{"id":"2","type":"create","file":"docs/b.md","reason":"r","content":"b","confidence":"', CASE conv_id % 2 WHEN 0 THEN 'high' ELSE 'low' END, '"}}',
      '],"skipped":[],"skip_reason":', CASE conv_id % 5 WHEN 0 THEN '"quiet"' ELSE 'null' END, '}}') AS plan_json,
      conv_id, turn
    FROM {{conversations}}"""


@query(
    "evaluate_docs_plans",
    """
    WITH u AS (SELECT conv_id * 100 + turn AS run_id, 0 AS seq, CASE turn % 3 WHEN 0 THEN 'docs/a.md' WHEN 1 THEN 'README.md' ELSE 'src/a.py' END AS file,
        'modify' AS type, CASE turn % 3 WHEN 2 THEN 'refused' ELSE 'apply' END AS status FROM conversations WHERE conv_id % 5 <> 0
      UNION ALL SELECT conv_id * 100 + turn, 1, 'docs/b.md', 'create', CASE turn % 3 WHEN 2 THEN 'not-reached' ELSE 'apply' END
        FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 2 = 0
      UNION ALL SELECT conv_id * 100 + turn, NULL, NULL, NULL, 'skipped' FROM conversations WHERE conv_id % 5 = 0)
    SELECT * FROM u""",
)
def evaluate_docs_plans(spark, sf):
    plans = project(spark, sf, DOC_PLANS.replace("\\n", "\\\\n"))
    return evaluate.evaluate_docs_plans(plans).select("run_id", "seq", "file", "type", "status")


SHELVES = """
    SELECT source AS repo, concat('docs/', doc_id, '.md') AS path,
      concat('# T', chr(10), chr(10), '## One', chr(10), text, CASE doc_id % 3 WHEN 0 THEN concat(chr(10), chr(10), '## Two', chr(10), 'old', chr(10))
        WHEN 1 THEN concat(chr(10), '## Two', chr(10), 'old', chr(10), chr(10), '## Three', chr(10), 'tail') ELSE '' END) AS content
    FROM {documents}"""
SHELF_UPDATES = """
    SELECT source AS repo, concat('docs/', doc_id, '.md') AS path, 1 AS seq, 'modify' AS type, '## Two' AS section,
      concat('## Two', chr(10), 'new ', doc_id, chr(10)) AS content FROM {documents}
    UNION ALL SELECT source, concat('docs/', doc_id, CASE doc_id % 2 WHEN 0 THEN '.md' ELSE '.new.md' END), 2, 'modify', '## None', 'appended' FROM {documents}"""


@query(
    "apply_doc_updates",
    f"""
    WITH d AS ({as_sql(SHELVES)}), i AS (SELECT doc_id, source AS repo, regexp_replace(concat('# T', chr(10), chr(10), '## One', chr(10), text), '\\s+$', '') AS head,
        concat('# T', chr(10), chr(10), '## One', chr(10), text) AS raw FROM documents),
    f AS (SELECT repo, doc_id, CASE doc_id % 3 WHEN 0 THEN concat(head, chr(10), chr(10), '## Two', chr(10), 'new ', doc_id, chr(10), chr(10))
        WHEN 1 THEN concat(head, chr(10), chr(10), '## Two', chr(10), 'new ', doc_id, chr(10), chr(10), '## Three', chr(10), 'tail')
        ELSE concat(raw, chr(10), chr(10), '## Two', chr(10), 'new ', doc_id, chr(10)) END AS one FROM i)
    SELECT repo, concat('docs/', doc_id, '.md') AS path, true AS existed,
      md5(CASE doc_id % 2 WHEN 0 THEN concat(one, chr(10), chr(10), 'appended') ELSE one END) AS content_md5 FROM f
    UNION ALL SELECT repo, concat('docs/', doc_id, '.new.md'), false, md5('appended') FROM f WHERE doc_id % 2 = 1""",
)
def apply_doc_updates(spark, sf):
    out = documents.apply_doc_updates(project(spark, sf, SHELVES), project(spark, sf, SHELF_UPDATES))
    return out.select("repo", "path", "existed", F.md5("content").alias("content_md5"))


@query(
    "evaluate_observe_plans",
    """
    SELECT event_id AS run_id, 0 AS seq, CASE event_id % 4 WHEN 0 THEN 'promote_canary' WHEN 1 THEN 'reboot' WHEN 2 THEN 'trigger_rollback' ELSE 'notify' END AS skill,
      event_id % 4 <> 1 AS allowed FROM events
    UNION ALL SELECT event_id, 1, 'escalate', true FROM events""",
)
def evaluate_observe_plans(spark, sf):
    plans = project(
        spark,
        sf,
        """SELECT event_id AS run_id, concat('{"actions":[{"skill":"', CASE event_id % 4 WHEN 0 THEN 'promote_canary' WHEN 1 THEN 'reboot'
             WHEN 2 THEN 'trigger_rollback' ELSE 'notify' END, '"},{"skill":"escalate"}]}') AS plan_json FROM {events}""",
    )
    return evaluate.evaluate_observe_plans(plans)


VALIDATION = f"""
    SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'pr' ELSE 'docs' END AS domain,
      CASE o_orderkey % 9
        WHEN 0 THEN '{{"version":"{S.VERSIONS["issue"]}","reasoning":"r","actions":[{{"skill":"notify","params":{{}}}}],"skip_reason":null}}'
        WHEN 3 THEN '{{"version":"{S.VERSIONS["issue"]}","reasoning":"","actions":[{{"skill":"nope","params":[1]}}]}}'
        WHEN 6 THEN concat('not json ', o_custkey)
        WHEN 1 THEN '{{"version":"{S.VERSIONS["pr"]}","actions":[{{"skill":"add_label"}}]}}'
        WHEN 4 THEN '{{"version":"{S.VERSIONS["pr"]}","actions":[{{"skill":"add_label","confidence":"sure"}}]}}'
        WHEN 7 THEN '{{"version":"other","actions":"none"}}'
        WHEN 2 THEN '{{"version":"{S.VERSIONS["docs"]}","summary":"s","updates":[{{"id":"1","type":"create","file":"f","reason":"r","content":"c","confidence":"high"}}],"skipped":[{{"file":"g","reason":"r"}}],"skip_reason":null}}'
        WHEN 5 THEN '{{"version":"{S.VERSIONS["docs"]}","summary":"s","updates":[{{"id":1,"type":"create","file":"f","reason":"r","content":"c","confidence":"high"}}],"skipped":[],"skip_reason":null}}'
        ELSE '{{"version":"{S.VERSIONS["docs"]}","summary":3,"updates":[],"skipped":[{{"file":"g"}}],"skip_reason":4}}' END AS plan_json
    FROM {{orders}}"""


@query(
    "validate_plans",
    """
    WITH v AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'pr' ELSE 'docs' END AS domain,
        CASE o_orderkey % 9 WHEN 3 THEN 'reasoning,skill,params,skip_reason' WHEN 6 THEN 'not-json' WHEN 4 THEN 'confidence'
          WHEN 7 THEN 'version,actions' WHEN 5 THEN 'updates' WHEN 8 THEN 'summary,skipped,skip_reason' ELSE '' END AS violations FROM orders)
    SELECT *, violations = '' AS valid FROM v""",
)
def validate_plans(spark, sf):
    return evaluate.validate_plans(project(spark, sf, VALIDATION))


@query(
    "label_state",
    """
    WITH o AS (SELECT DISTINCT l_orderkey AS pr FROM lineitem),
    b AS (SELECT pr, repo, list_filter(list_transform(string_split(labels, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM v_prs),
    k AS (SELECT b.*, list_distinct(list_concat(l, ['bug', 'priority:p2'])) AS l1 FROM b),
    s AS (SELECT repo, pr, CASE pr % 4 WHEN 0 THEN list_filter(l1, lambda x: x NOT IN ('bug', 'patch'))
        WHEN 1 THEN list_concat(list_filter(l1, lambda x: x NOT LIKE 'priority:p_'), ['priority:p0'])
        WHEN 2 THEN list_concat(l1, ['duplicate']) ELSE list_concat(l1, ['needs-human']) END AS l2 FROM k)
    SELECT repo, pr AS number, array_to_string(list_sort(list_distinct(l2)), ',') AS labels FROM s""",
)
def label_state(spark, sf):
    prs = view(spark, sf, "v_prs").select("repo", F.col("pr").alias("number"), "labels")
    first = F.struct(F.lit(1).alias("seq"), F.lit("add").alias("op"), F.array(F.lit("bug"), F.lit("priority:p2")).alias("labels"))
    k = F.col("number") % 4
    second = F.struct(
        F.lit(2).alias("seq"),
        F.when(k == 0, "remove").when(k == 1, "set_priority").when(k == 2, "mark_duplicate").otherwise("escalate").alias("op"),
        F.when(k == 0, F.array(F.lit("BUG"), F.lit("Patch"))).when(k == 1, F.array(F.lit("priority:p0"))).alias("labels"),
    )
    ops = prs.select("repo", "number", F.inline(F.array(second, first)))
    return evaluate.label_state(ops, prs)


RUN_RECORDS = f"""
    SELECT conv_id AS run_id, turn AS line_no, CASE
        WHEN conv_id % 6 = 0 THEN concat('{{"type":"', CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END, '","message":{{"role":"x","content":[{{"type":"text","text":"t', turn,
          '"}},{{"type":"tool"}},{{"type":"text","text":"/', conv_id, '"}}]}}}}')
        WHEN conv_id % 6 = 1 THEN concat('{{"type":"result","result":"r', turn, '"}}')
        WHEN conv_id % 6 = 2 THEN concat('{{"type":"wrapper","inner":[{{"type":"assistant","content":[{{"type":"text","text":"deep', turn, '"}}]}},{{"type":"result","result":"in', turn, '"}}]}}')
        WHEN conv_id % 6 = 3 THEN concat('{{"type":"system","result":"only', turn, '"}}')
        WHEN conv_id % 6 = 4 THEN concat('{{"type":"system","n":', turn, '}}')
        ELSE text END AS raw,
      CASE conv_id % 6 WHEN 5 THEN 'text' ELSE 'jsonl' END AS shape
    FROM {{conversations}}"""


@query(
    "final_text",
    """
    WITH m AS (SELECT conv_id AS run_id, max(turn) AS t, min(turn) AS f, max(turn) FILTER (WHERE role <> 'user') AS a,
        arg_max(text, turn) AS last_text FROM conversations GROUP BY 1)
    SELECT run_id, md5(CASE run_id % 6 WHEN 0 THEN coalesce(concat('t', a, '/', run_id), '') WHEN 1 THEN concat('r', t) WHEN 2 THEN concat('in', t)
      WHEN 3 THEN concat('only', f) WHEN 4 THEN '' ELSE last_text END) AS text_md5 FROM m WHERE a IS NOT NULL OR run_id % 6 <> 0
    UNION ALL SELECT run_id, md5('') FROM m WHERE a IS NULL AND run_id % 6 = 0""",
)
def final_text(spark, sf):
    return extract.final_text(project(spark, sf, RUN_RECORDS)).select("run_id", F.md5("text").alias("text_md5"))


PLAN_RECORDS = f"""
    SELECT conv_id AS run_id, turn AS line_no, CASE conv_id % 6
        WHEN 0 THEN concat('{{"version": "{S.VERSIONS["issue"]}", "reasoning": "n', turn, '", "actions": []}}')
        WHEN 1 THEN concat('{{"type":"result","plan":{{"version":"{S.VERSIONS["issue"]}","reasoning":"n', turn, '","actions":[]}}}}')
        WHEN 2 THEN concat('{{"type":"assistant","text":"see {{x}} then {{\\"version\\": \\"{S.VERSIONS["issue"]}\\", \\"reasoning\\": \\"n', turn, '\\", \\"actions\\": []}} end"}}')
        WHEN 3 THEN concat('{{"type":"assistant","draft":{{"reasoning":"n', turn, '","actions":[]}}}}')
        WHEN 4 THEN concat('{{"type":"assistant","text":"nothing ', turn, '"}}') ELSE text END AS raw,
      CASE conv_id % 6 WHEN 5 THEN 'text' ELSE 'jsonl' END AS shape
    FROM {{conversations}}"""


@query(
    "extract_plans",
    f"""
    WITH m AS (SELECT conv_id AS run_id, max(turn) AS t, min(turn) AS f FROM conversations GROUP BY 1),
    s AS (SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 'skipped' ELSE (['record', 'nested', 'text', 'shaped', 'fallback', 'fallback'])[run_id % 6 + 1] END AS source, t, f FROM m),
    p AS (SELECT run_id, source, CASE source WHEN 'skipped' THEN '{S.fallback_plan("issue", "skip")}' WHEN 'fallback' THEN '{S.fallback_plan("issue", "fail")}'
        WHEN 'shaped' THEN concat('{{"reasoning":"n', t, '","actions":[],"version":"{S.VERSIONS["issue"]}"}}')
        ELSE concat('{{"version":"{S.VERSIONS["issue"]}","reasoning":"n', CASE source WHEN 'record' THEN f ELSE t END, '","actions":[]}}') END AS plan_json FROM s)
    SELECT run_id, source, plan_json, sha256(plan_json) AS plan_hash FROM p""",
)
def extract_plans(spark, sf):
    records = project(spark, sf, PLAN_RECORDS.replace('\\"', '\\\\"'))
    runs = records.select("run_id", (F.col("run_id") % 11 == 0).alias("skipped")).distinct()
    return extract.extract_plans(records, runs, "issue")


REQUESTS = """
    SELECT o_orderkey AS request_id, concat('ops/task-', o_custkey % 60) AS task,
      CASE o_orderkey % 5 WHEN 0 THEN concat('/cmd-', o_custkey % 90) WHEN 1 THEN concat('Do {{ job }} for {{repo}} at {{other}} ', o_custkey) ELSE '' END AS direct_prompt,
      CASE o_orderkey % 5 WHEN 2 THEN concat('own/', o_custkey % 80, '.md') END AS caller_path
    FROM {orders}"""
PROMPTS = """
    SELECT concat('commands/cmd-', p_partkey, '.md') AS path, concat('Command {{job}} of ', p_name) AS text FROM {part} WHERE p_size > 20
    UNION ALL SELECT concat('own/', p_partkey, '.md'), concat('Own {{repo}} ', p_name) FROM {part} WHERE p_size > 20
    UNION ALL SELECT concat('skills/ops-task-', p_partkey, '/SKILL.md'), concat('Skill {{ unknown }} {{job}} ', p_name) FROM {part} WHERE p_size > 20"""
RESOLVED = f"""
    q AS ({as_sql(REQUESTS)}), pr AS ({as_sql(PROMPTS)}),
    k AS (SELECT *, CASE request_id % 5 WHEN 0 THEN 'slash-command' WHEN 1 THEN 'direct' WHEN 2 THEN 'caller' ELSE 'builtin' END AS source,
        CASE request_id % 5 WHEN 0 THEN concat('commands', direct_prompt, '.md') WHEN 2 THEN caller_path WHEN 1 THEN NULL
          ELSE concat('skills/', replace(task, '/', '-'), '/SKILL.md') END AS path FROM q),
    res AS (SELECT request_id, source, k.path, CASE source WHEN 'direct' THEN direct_prompt ELSE pr.text END AS text FROM k LEFT JOIN pr ON k.path = pr.path)"""


@query(
    "resolve_prompts",
    f"WITH {RESOLVED} SELECT *, CASE WHEN text IS NULL THEN concat('prompt not found: ', path) END AS error FROM res",
)
def resolve_prompts(spark, sf):
    out = prompts.resolve_prompts(project(spark, sf, REQUESTS), project(spark, sf, PROMPTS))
    return out.drop("task", "direct_prompt", "caller_path")


@query(
    "render_prompts",
    f"""WITH {RESOLVED} SELECT request_id, replace(replace(regexp_replace(text, '\\{{\\{{ ?job ?\\}}\\}}', 'a$1\\\\b', 'g'), '{{{{repo}}}}', concat('org/r', request_id)), '{{{{ repo }}}}', '') AS rendered
      FROM res WHERE text IS NOT NULL""",
)
def render_prompts(spark, sf):
    found = resolve_prompts(spark, sf).filter("text IS NOT NULL")
    context = F.create_map(F.lit("job"), F.lit("a$1\\b"))
    automatic = F.create_map(F.lit("job"), F.lit("never"), F.lit("repo"), F.concat(F.lit("org/r"), "request_id"))
    out = prompts.render_prompts(found.withColumns({"context": context, "automatic": automatic}))
    return out.select("request_id", "rendered")
