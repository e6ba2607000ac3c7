import json

import pytest
from pyspark.sql import functions as F

from gatelake.plans import documents, evaluate, extract, prompts
from gatelake.plans.schemas import VERSIONS, fallback_plan

V = VERSIONS["issue"]


def issue_audit(spark, actions, number=5, assoc="OWNER", version=V, token=True, hook=True):
    plan = json.dumps({"version": version, "reasoning": "r", "actions": actions, "skip_reason": None})
    df = spark.createDataFrame(
        [(1, "r", plan, assoc, number, token, hook)],
        "run_id int, repo string, plan_json string, author_assoc string, issue_number bigint, has_tracker_token boolean, has_webhook boolean",
    )
    tasks = spark.createDataFrame([("r", "sync")], "repo string, name string")
    branches = spark.createDataFrame([("r", "old")], "repo string, branch string")
    rows = evaluate.evaluate_issue_plans(df, tasks, branches).orderBy("seq").collect()
    return [x.line if x.status != "error" else "ERROR " + x.line for x in rows]


def act(skill, **params):
    return {"id": skill, "skill": skill, "params": params, "risk": "low"}


ISSUE_CASES = [
    ([act("add_label", labels=["a", "b"])], {}, ["add_label: a, b"]),
    ([act("add_label", labels=[])], {}, []),
    ([act("add_label")], {}, []),
    ([act("remove_label", labels=["a", "b"])], {}, ["remove_label: a", "remove_label: b"]),
    ([act("set_priority", priority="p0")], {}, ["set_priority: p0"]),
    ([act("set_priority", labels=["priority:p2"])], {}, ["set_priority: p2"]),
    ([act("set_priority", priority="p7")], {}, []),
    ([act("assign_issue", assignees=["a", "b"])], {}, ["assign_issue: a, b"]),
    ([act("assign_issue", assignee="c")], {}, ["assign_issue: c"]),
    ([act("assign_issue")], {}, []),
    ([act("add_comment", body="x")], {}, ["add_comment"]),
    ([act("add_comment", body="")], {}, []),
    ([act("close_issue")], {}, ["close_issue"]),
    ([act("close_issue")], {"assoc": "NONE"}, ["blocked close_issue: actor association NONE is not trusted"]),
    ([act("close_issue")], {"assoc": ""}, ["close_issue"]),
    ([act("reopen_issue")], {"assoc": "MEMBER"}, ["reopen_issue"]),
    ([act("mark_duplicate", duplicate_of=3)], {}, ["mark_duplicate: #3"]),
    ([act("mark_duplicate", duplicateOf=4)], {}, ["mark_duplicate: #4"]),
    ([act("mark_duplicate")], {}, []),
    ([act("create_branch", branch="new")], {}, ["create_branch: new"]),
    ([act("create_branch", branch="old")], {}, ["create_branch skipped: old exists"]),
    ([act("create_branch")], {}, []),
    ([act("escalate")], {}, ["escalate: needs-human"]),
    ([act("escalate", labels=["x"])], {}, ["escalate: x"]),
    ([act("escalate")], {"number": None}, []),
    ([act("link_linear", issue_id="A-1")], {}, ["link_linear: A-1"]),
    ([act("link_linear", identifier="A-2")], {"token": False}, ["link_linear skipped: linear-token is not configured"]),
    ([act("link_linear")], {}, ["ERROR link_linear requires linear_issue_id"]),
    ([act("dispatch_mcp_task", task="sync")], {}, ["dispatch_mcp_task: sync"]),
    ([act("dispatch_mcp_task", name="ghost")], {}, ["ERROR dispatch_mcp_task task is not declared: ghost"]),
    ([act("dispatch_mcp_task")], {}, ["ERROR dispatch_mcp_task requires task"]),
    ([act("dispatch_mcp_task", task="sync")], {"assoc": "CONTRIBUTOR"}, ["blocked dispatch_mcp_task: actor association CONTRIBUTOR is not trusted"]),
    ([act("schedule_followup", due_at="2024-03-01T10:00:00Z")], {}, ["schedule_followup: 2024-03-01T10:00:00.000Z"]),
    ([act("schedule_followup", days=1)], {}, ["schedule_followup: 2024-01-02T00:00:00.000Z"]),
    ([act("schedule_followup", delay_days="90")], {}, ["schedule_followup: 2024-03-31T00:00:00.000Z"]),
    ([act("schedule_followup", days=0)], {}, ["ERROR schedule_followup requires due_at or days between 1 and 90"]),
    ([act("schedule_followup", due_at="soon")], {}, ["ERROR Invalid schedule_followup due_at: soon"]),
    ([act("notify", channel="#ops")], {}, ["notify: #ops"]),
    ([act("notify")], {}, ["notify: webhook"]),
    ([act("notify")], {"hook": False}, ["notify skipped: slack-webhook-url is not configured"]),
    ([act("add_label", labels=["a"]), act("fly"), act("close_issue")], {}, ["add_label: a", "ERROR Unknown issue agent skill: fly"]),
    ([act("add_label", labels=["a"])], {"number": None}, ["ERROR Plan contains issue mutations but no issue number is available"]),
    ([act("notify")], {"number": 0}, ["notify: webhook"]),
    ([act("notify")], {"version": "v9"}, ["ERROR Unsupported plan version: v9"]),
    ([], {}, []),
]


@pytest.mark.parametrize("case", range(len(ISSUE_CASES)))
def test_issue_plan(spark, case):
    actions, options, lines = ISSUE_CASES[case]
    assert issue_audit(spark, actions, **options) == lines


def pr_plan(spark, actions, assoc="OWNER", skip=None, version=VERSIONS["pr"]):
    plan = json.dumps({"version": version, "summary": "s", "actions": actions, "skip_reason": skip})
    df = spark.createDataFrame([(1, plan, assoc, True)], "run_id int, plan_json string, author_assoc string, has_summary boolean")
    row = evaluate.evaluate_pr_plans(df).first()
    return row.summary_comment, row.executed


def high(skill, confidence="high", **params):
    return {"skill": skill, "params": params, "confidence": confidence}


PR_CASES = [
    ([high("add_label", labels=["a", "b"])], {}, ["add_label: a, b"]),
    ([high("add_label", "medium", labels=["a"])], {}, []),
    ([high("fly"), high("add_reviewer")], {}, ["add_reviewer"]),
    ([high("block_merge", reason="x")], {}, ["block_merge"]),
    ([high("block_merge")], {"assoc": "NONE"}, []),
    ([high("escalate")], {"assoc": ""}, []),
    ([high("escalate"), high("escalate", labels=["z"])], {}, ["escalate: needs-human", "escalate: z"]),
    ([high("request_changes", body="")], {}, []),
    ([high("request_changes", body="b")], {}, ["request_changes"]),
    ([high("remove_label", labels=["a", "b"])], {"assoc": "NONE"}, ["remove_label: a", "remove_label: b"]),
    ([high("assign_issue")], {}, ["assign_issue"]),
    ([high("add_reviewer")], {"skip": "why"}, []),
]


@pytest.mark.parametrize("case", range(len(PR_CASES)))
def test_pr_plan(spark, case):
    actions, options, lines = PR_CASES[case]
    assert pr_plan(spark, actions, **options) == ("update", lines)


def test_pr_plan_of_another_version(spark):
    assert pr_plan(spark, [high("add_reviewer")], version="x") == ("error", [])


def test_audit_is_never_longer_than_its_actions_allow(spark):
    lines = issue_audit(spark, [act("notify"), act("escalate"), act("add_comment", body="b")])
    assert len(lines) == 3


def plan_of(spark, records, domain="issue", skipped=False, shape="jsonl"):
    rows = [(1, i, raw, shape) for i, raw in enumerate(records)]
    df = spark.createDataFrame(rows, "run_id int, line_no int, raw string, shape string")
    runs = spark.createDataFrame([(1, skipped)], "run_id int, skipped boolean")
    row = extract.extract_plans(df, runs, domain).first()
    return row.source, json.loads(row.plan_json)


def test_plan_sources(spark):
    plan = {"version": V, "reasoning": "x", "actions": [{"skill": "notify", "params": {"a": {"b": "}"}}}]}
    text = json.dumps(plan)
    assert plan_of(spark, [text], shape="json") == ("record", plan)
    assert plan_of(spark, [json.dumps({"type": "result", "deep": [{"plan": plan}]})]) == ("nested", plan)
    fenced = json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": f"Here {{it}} is:\n```json\n{text}\n```"}]}})
    assert plan_of(spark, [fenced]) == ("text", plan)
    old = json.dumps({"type": "assistant", "text": text.replace('"x"', '"old"')})
    assert plan_of(spark, [old, fenced])[1]["reasoning"] == "x"
    shaped = json.dumps({"type": "x", "inner": {"reasoning": "q", "actions": []}})
    assert plan_of(spark, [shaped]) == ("shaped", {"reasoning": "q", "actions": [], "version": V})
    assert plan_of(spark, ['{"type":"x"}'])[0] == "fallback"
    assert plan_of(spark, ["just text " + text], shape="text")[0] == "fallback"
    assert plan_of(spark, [text], skipped=True) == ("skipped", json.loads(fallback_plan("issue", "skip")))
    assert plan_of(spark, [])[0] == "missing"
    assert plan_of(spark, [])[1]["actions"][0]["id"] == "escalate-missing-output"


def test_docs_plan_needs_a_valid_shape(spark):
    update = {"id": "1", "type": "modify", "file": "docs/a.md", "reason": "r", "content": "c", "confidence": "high"}
    plan = {"version": VERSIONS["docs"], "summary": "s", "updates": [update], "skipped": [], "skip_reason": None}
    message = lambda p: json.dumps([{"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "text", "text": "ok " + json.dumps(p)}]}])
    assert plan_of(spark, [message(plan)], "docs", shape="json") == ("record", plan)
    bad = {**plan, "updates": [{**update, "type": "delete"}]}
    assert plan_of(spark, [message(bad)], "docs", shape="json")[1]["skip_reason"] == "no_output"


def final(spark, records, shape="jsonl"):
    rows = [(1, i, raw, shape) for i, raw in enumerate(records)]
    return extract.final_text(spark.createDataFrame(rows, "run_id int, line_no int, raw string, shape string")).first().text


def test_final_text(spark):
    said = lambda *t: json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": x} for x in t]}})
    result = json.dumps({"type": "result", "result": "done"})
    assert final(spark, [said("hello"), result, said("later")]) == "done"
    assert final(spark, [said("a"), said("b", "c"), json.dumps({"type": "result", "result": ""})]) == "bc"
    assert final(spark, [json.dumps([{"type": "system"}, {"type": "result", "result": "in array"}])], "json") == "in array"
    assert final(spark, [json.dumps({"result": "own\nsecond"})], "json") == "own"
    assert final(spark, ["plain\ntext"], "text") == "plain\ntext"
    assert final(spark, [json.dumps({"type": "system"})]) == ""


def test_sections(spark):
    doc = "# T\n\n## A\none\n\n## B\nold\n\n## C\nend\n"
    docs = spark.createDataFrame([("r", "docs/a.md", doc)], "repo string, path string, content string")
    updates = spark.createDataFrame(
        [("r", "docs/a.md", 2, "modify", "## Z", "tail"), ("r", "docs/a.md", 1, "modify", "## B", "\n## B\nnew\n"), ("r", "docs/n.md", 1, "modify", "## B", "fresh"),
         ("r", "docs/c.md", 1, "create", None, "made")],
        "repo string, path string, seq int, type string, section string, content string",
    )
    got = {x.path: x.content for x in documents.apply_doc_updates(docs, updates).collect()}
    assert got == {
        "docs/a.md": "# T\n\n## A\none\n\n## B\nnew\n\n## C\nend\n\n\ntail",
        "docs/n.md": "fresh",
        "docs/c.md": "made",
    }


def test_labels_fold_in_order_and_are_idempotent(spark):
    issues = spark.createDataFrame([("r", 1, "bug, priority:p3")], "repo string, number int, labels string")
    ops = [(3, "escalate", None), (1, "add", ["x"]), (2, "set_priority", ["priority:p1"]), (4, "remove", ["bug"]), (5, "mark_duplicate", None)]
    df = lambda rows: spark.createDataFrame([("r", 1, *o) for o in rows], "repo string, number int, seq int, op string, labels array<string>")
    once = evaluate.label_state(df(ops), issues).first().labels
    assert once == "duplicate,needs-human,priority:p1,x"
    again = [(s + 10, op, labels) for s, op, labels in ops]
    assert evaluate.label_state(df(ops + again), issues).first().labels == once


def test_prompts(spark):
    requests = spark.createDataFrame(
        [(1, "ops/sum", "/go", None), (2, "ops/sum", "Say {{ a }} {{b}} {{c}}", "x"), (3, "ops/sum", "", "own.md"), (4, "ops/sum", None, None), (5, "ops/sum", "/none", "own.md")],
        "request_id int, task string, direct_prompt string, caller_path string",
    )
    table = spark.createDataFrame([("commands/go.md", "G"), ("own.md", "O"), ("skills/ops-sum/SKILL.md", "S")], "path string, text string")
    rows = {x.request_id: (x.source, x.text, x.error) for x in prompts.resolve_prompts(requests, table).collect()}
    assert rows[1] == ("slash-command", "G", None) and rows[3] == ("caller", "O", None) and rows[4] == ("builtin", "S", None)
    assert rows[5] == ("slash-command", None, "prompt not found: commands/none.md")
    maps = {"context": F.create_map(F.lit("a"), F.lit("$1\\")), "automatic": F.create_map(F.lit("a"), F.lit("no"), F.lit("b"), F.lit("B"))}
    out = prompts.render_prompts(prompts.resolve_prompts(requests, table).filter("request_id = 2").withColumns(maps))
    assert out.first().rendered == "Say $1\\ B {{c}}"
