"""Names, limits and JSON shapes of action plans."""

# Fixed values -------------------------------------------------------------
VERSIONS = {"issue": "issue-action-plan/v1", "pr": "pr-action-plan/v1", "docs": "docs-action-plan/v1"}
ISSUE_SKILLS = (
    "add_label", "remove_label", "set_priority", "assign_issue", "add_comment", "close_issue", "reopen_issue",
    "mark_duplicate", "create_branch", "link_linear", "dispatch_mcp_task", "schedule_followup", "notify", "escalate",
)
ISSUE_HIGH_RISK = ("close_issue", "reopen_issue", "create_branch", "dispatch_mcp_task")
ISSUE_FREE_SKILLS = (
    "create_branch", "link_linear", "dispatch_mcp_task", "schedule_followup", "notify", "escalate",
)
PR_SKILLS = (
    "add_label", "remove_label", "add_reviewer", "request_changes", "block_merge", "escalate", "assign_issue",
)
PR_HIGH_RISK = ("request_changes", "block_merge", "escalate")
OBSERVE_ACTIONS = (
    "trigger_rollback", "create_incident", "notify", "extend_observe", "promote_canary", "escalate",
)
PRIORITIES = ("p0", "p1", "p2", "p3")
CONFIDENCES = ("high", "medium", "low")
DOC_PATH = r"^(docs/|CHANGELOG\.md$|README\.md$)"
DEFAULT_ESCALATION = "needs-human"
FOLLOWUP_DAYS = (1, 90)
# ---------------------------------------------------------------------------

PARAMS = (
    "struct<labels:array<string>,priority:string,assignees:array<string>,assignee:string,body:string,message:string,"
    "reason:string,duplicate_of:string,duplicateOf:string,branch:string,linear_issue_id:string,issue_id:string,"
    "identifier:string,task:string,name:string,event_type:string,due_at:string,days:string,delay_days:string,channel:string>"
)
ACTION = f"struct<id:string,skill:string,confidence:string,risk:string,params:{PARAMS}>"
PLAN = f"version string, reasoning string, summary string, skip_reason string, actions array<{ACTION}>"
UPDATE = "struct<id:string,type:string,file:string,section:string,reason:string,content:string,confidence:string>"
DOCS_PLAN = f"version string, summary string, skip_reason string, updates array<{UPDATE}>"
TYPED_PLAN = (
    "version variant, reasoning variant, summary variant, skip_reason variant, "
    "actions array<struct<skill:variant,params:variant,confidence:variant>>, "
    "updates array<struct<id:variant,type:variant,file:variant,reason:variant,content:variant,confidence:variant>>, "
    "skipped array<struct<file:variant,reason:variant>>"
)


def fallback_plan(domain: str, why: str) -> str:
    """Plan used when there is no usable output: ``skip``, ``fail`` or ``missing``."""
    version = VERSIONS[domain]
    if domain == "docs":
        reason, text = ("missing-api-key", "Agent skipped") if why == "skip" else ("no_output", "Could not parse agent output")
        return f'{{"version":"{version}","summary":"{text}","updates":[],"skipped":[],"skip_reason":"{reason}"}}'
    head = "reasoning" if domain == "issue" else "summary"
    extra = "" if domain == "issue" else '"risk":"low","reviewer_focus":[],'
    if why == "skip":
        return f'{{"version":"{version}","{head}":"Agent skipped.",{extra}"actions":[],"skip_reason":"missing-api-key"}}'
    name = "missing-output" if why == "missing" else "unparseable"
    level = '"risk":"low"' if domain == "issue" else '"confidence":"high"'
    text = "Agent output was missing." if why == "missing" else "Agent output was not parseable."
    return (
        f'{{"version":"{version}","{head}":"{text}",{extra}"actions":[{{"id":"escalate-{name}","skill":"escalate",'
        f'"params":{{"reason":"{text}","labels":["{DEFAULT_ESCALATION}"]}},{level}}}],"skip_reason":null}}'
    )
