"""Guarded evaluation of action plans as tables.

A plan is one row and its actions one array, so the rules run as array
expressions inside the row: no shuffle orders the actions of a run.  Joins are
needed only where a rule looks at other tables (declared tasks, branches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.operators.text_policy import is_trusted, spelled_labels, strict_json
from gatelake.plans import schemas as S

LINES = "struct<lines:array<string>,error:string>"


def _set(col: Column) -> Column:
    """NULL for an absent or empty text."""
    return F.nullif(col, F.lit(""))


def _first(*cols: Column) -> Column:
    return F.coalesce(*[_set(c) for c in cols])


def _listed(values: Column) -> Column:
    return F.coalesce(values, F.expr("cast(array() as array<string>)"))


def _result(lines: Column | None = None, error: Column | None = None) -> Column:
    """Audit lines (NULL entries dropped) and an error that aborts the rest."""
    empty = F.expr("cast(array() as array<string>)")
    kept = empty if lines is None else F.coalesce(F.filter(lines, lambda x: x.isNotNull()), empty)
    return F.struct(kept.alias("lines"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def _one(line: Column) -> Column:
    return _result(F.array(line))


# -- issue plans -----------------------------------------------------------------


def _issue_action(a: Column, now: str) -> Column:
    p, skill = a["params"], a["skill"]
    has_issue = F.col("issue_number").isNotNull() & (F.col("issue_number") != 0)
    labels, assignees = _listed(p["labels"]), _listed(p["assignees"])
    # A list wins over the single name even when it is empty.
    people = F.when(p["assignees"].isNotNull(), assignees).otherwise(F.filter(F.array(_set(p["assignee"])), lambda x: x.isNotNull()))
    csv = lambda xs: F.array_join(xs, ", ")
    line = lambda cond, *parts: F.when(cond, F.concat(*parts))
    priority = _first(p["priority"], F.regexp_replace(F.get(labels, 0), "^priority:", ""))
    duplicate = _first(p["duplicate_of"], p["duplicateOf"])
    branch = _set(p["branch"])
    linked = _first(p["linear_issue_id"], p["issue_id"], p["identifier"])
    task = _first(p["task"], p["name"])
    days = F.coalesce(_first(p["days"], p["delay_days"]).try_cast("double"), F.lit(0.0))
    at = F.expr(f"timestamp'{now}'")
    due = F.when(_set(p["due_at"]).isNotNull(), F.try_to_timestamp(p["due_at"])).when(
        days.between(*S.FOLLOWUP_DAYS), F.timestamp_micros(F.unix_micros(at) + (days * 86_400_000_000).cast("bigint"))
    )
    due_error = F.when(
        due.isNull(),
        F.when(_set(p["due_at"]).isNotNull(), F.concat(F.lit("Invalid schedule_followup due_at: "), p["due_at"])).otherwise(
            "schedule_followup requires due_at or days between 1 and 90"
        ),
    )
    escalation = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(S.DEFAULT_ESCALATION)))
    blocked = skill.isin(*S.ISSUE_HIGH_RISK) & (F.coalesce("author_assoc", F.lit("")) != "") & ~is_trusted("author_assoc")
    by_skill = {
        "add_label": _one(line(has_issue & (F.size(labels) > 0), F.lit("add_label: "), csv(labels))),
        "remove_label": _result(F.transform(labels, lambda x: F.concat(F.lit("remove_label: "), x))),
        "set_priority": _one(line(priority.isin(*S.PRIORITIES), F.lit("set_priority: "), priority)),
        "assign_issue": _one(line(has_issue & (F.size(people) > 0), F.lit("assign_issue: "), csv(people))),
        "add_comment": _one(line(has_issue & _set(p["body"]).isNotNull(), F.lit("add_comment"))),
        "close_issue": _one(line(has_issue, F.lit("close_issue"))),
        "reopen_issue": _one(line(has_issue, F.lit("reopen_issue"))),
        "mark_duplicate": _one(line(has_issue & duplicate.isNotNull(), F.lit("mark_duplicate: #"), duplicate)),
        "create_branch": _one(
            F.when(F.array_contains("known_branches", branch), F.concat(F.lit("create_branch skipped: "), branch, F.lit(" exists"))).otherwise(
                F.concat(F.lit("create_branch: "), branch)
            )
        ),
        "escalate": _one(line(has_issue, F.lit("escalate: "), csv(escalation))),
        "link_linear": _result(
            F.array(
                F.when(F.col("has_tracker_token"), F.concat(F.lit("link_linear: "), linked)).otherwise(
                    "link_linear skipped: linear-token is not configured"
                )
            ),
            F.when(linked.isNull(), "link_linear requires linear_issue_id"),
        ),
        "dispatch_mcp_task": _result(
            F.array(F.concat(F.lit("dispatch_mcp_task: "), task)),
            F.when(task.isNull(), "dispatch_mcp_task requires task").when(
                ~F.array_contains("known_tasks", task), F.concat(F.lit("dispatch_mcp_task task is not declared: "), task)
            ),
        ),
        "schedule_followup": _result(
            F.array(F.concat(F.lit("schedule_followup: "), F.date_format(due, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))), due_error
        ),
        "notify": _one(
            F.when(F.col("has_webhook"), F.concat(F.lit("notify: "), F.coalesce(_set(p["channel"]), F.lit("webhook")))).otherwise(
                "notify skipped: slack-webhook-url is not configured"
            )
        ),
    }
    out = _result(error=F.concat(F.lit("Unknown issue agent skill: "), F.coalesce(skill, F.lit("undefined"))))
    for name, outcome in by_skill.items():
        out = F.when(skill == name, outcome).otherwise(out)
    refusal = F.concat(F.lit("blocked "), skill, F.lit(": actor association "), "author_assoc", F.lit(" is not trusted"))
    return F.when(blocked, _one(refusal)).otherwise(out)


def evaluate_issue_plans(
    plans: DataFrame, tasks: DataFrame | None = None, branches: DataFrame | None = None, now: str = "2024-01-01 00:00:00"
) -> DataFrame:
    """Audit line by line of what each plan may do.

    ``plans(run_id, repo, plan_json, author_assoc, issue_number,
    has_tracker_token, has_webhook)``.  An error aborts the rest of its plan,
    earlier lines stand; a plan of another version or with issue mutations and
    no issue number gives only its error.  ``tasks(repo, name)`` and
    ``branches(repo, branch)`` are looked up for the names a plan mentions.
    """
    parsed = plans.withColumn("plan", F.from_json("plan_json", S.PLAN)).drop("plan_json")
    parsed = _known_names(parsed, tasks, "known_tasks", "name", "dispatch_mcp_task", lambda p: _first(p["task"], p["name"]))
    parsed = _known_names(parsed, branches, "known_branches", "branch", "create_branch", lambda p: _set(p["branch"]))
    actions = F.coalesce("plan.actions", F.expr(f"cast(array() as array<{S.ACTION}>)"))
    no_number = F.coalesce(F.col("issue_number"), F.lit(0)) == 0
    plan_error = F.when(
        ~F.col("plan.version").eqNullSafe(F.lit(S.VERSIONS["issue"])),
        F.concat(F.lit("Unsupported plan version: "), F.coalesce("plan.version", F.lit("undefined"))),
    ).when(
        no_number & F.exists(actions, lambda a: ~F.coalesce(a["skill"].isin(*S.ISSUE_FREE_SKILLS), F.lit(False))),
        "Plan contains issue mutations but no issue number is available",
    )
    outcomes = F.transform(actions, lambda a: _issue_action(a, now))
    ran = parsed.withColumn("plan_error", plan_error).withColumn(
        "outcomes", F.when(F.col("plan_error").isNull(), outcomes).otherwise(F.expr(f"cast(array() as array<{LINES}>)"))
    )
    return _audit(ran, F.col("plan_error"))


def _audit(ran: DataFrame, plan_error: Column) -> DataFrame:
    """Lines before the first error, then the error itself."""
    aborted = F.array_position(F.transform("outcomes", lambda o: o["error"].isNotNull()), True)
    stop = F.when(aborted > 0, aborted - 1).otherwise(F.size("outcomes")).cast("int")
    row = "array<struct<status:string,line:string>>"
    done = F.transform(
        F.flatten(F.transform(F.slice("outcomes", F.lit(1), stop), lambda o: o["lines"])),
        lambda x: F.struct(
            F.when(x.startswith("blocked "), "blocked").when(x.rlike("^[a-z_]+ skipped: "), "skipped").otherwise("done").alias("status"),
            x.alias("line"),
        ),
    )
    error = F.coalesce(plan_error, F.get("outcomes", (aborted - 1).cast("int"))["error"])
    failed = F.when(error.isNotNull(), F.array(F.struct(F.lit("error").alias("status"), error.alias("line")))).otherwise(
        F.expr(f"cast(array() as {row})")
    )
    return ran.select("run_id", F.posexplode(F.concat(done, failed)).alias("seq", "r")).select(
        "run_id", "seq", "r.status", "r.line"
    )


def _known_names(parsed: DataFrame, known: DataFrame | None, out: str, key: str, skill: str, name) -> DataFrame:
    """Add the names a plan mentions for ``skill`` that exist in ``known(repo, key)``."""
    none = F.expr("cast(array() as array<string>)")
    if known is None:
        return parsed.withColumn(out, none)
    wanted = F.transform(F.filter("plan.actions", lambda a: a["skill"] == skill), lambda a: name(a["params"]))
    hits = (
        parsed.select("run_id", "repo", F.explode(F.array_distinct(wanted)).alias(key))
        .join(known.select("repo", key).distinct(), ["repo", key], "left_semi")
        .groupBy("run_id", "repo")
        .agg(F.collect_set(key).alias(out))
    )
    return parsed.join(hits, ["run_id", "repo"], "left").withColumn(out, F.coalesce(out, none))


# -- request plans ------------------------------------------------------------------


def _pr_action(a: Column) -> Column:
    p, skill = a["params"], a["skill"]
    labels = _listed(p["labels"])
    csv = lambda xs: F.array_join(xs, ", ")
    escalation = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(S.DEFAULT_ESCALATION)))
    by_skill = {
        "add_label": F.array(F.when(F.size(labels) > 0, F.concat(F.lit("add_label: "), csv(labels)))),
        "remove_label": F.transform(labels, lambda x: F.concat(F.lit("remove_label: "), x)),
        "add_reviewer": F.array(F.lit("add_reviewer")),
        "block_merge": F.array(F.lit("block_merge")),
        "request_changes": F.array(F.when(_set(p["body"]).isNotNull(), F.lit("request_changes"))),
        "assign_issue": F.array(F.lit("assign_issue")),
        "escalate": F.array(F.concat(F.lit("escalate: "), csv(escalation))),
    }
    lines = F.expr("cast(array() as array<string>)")
    for name, outcome in by_skill.items():
        lines = F.when(skill == name, outcome).otherwise(lines)
    allowed = (
        F.coalesce(a["confidence"] == "high", F.lit(False))
        & (F.col("trusted") | ~skill.isin(*S.PR_HIGH_RISK))
    )
    return F.when(allowed, F.filter(lines, lambda x: x.isNotNull())).otherwise(F.expr("cast(array() as array<string>)"))


def evaluate_pr_plans(plans: DataFrame) -> DataFrame:
    """Per run: what happens to the summary comment and the executed lines.

    ``plans(run_id, plan_json, author_assoc, has_summary)``.  Unknown skills,
    other confidences than high and untrusted high-risk skills are dropped
    silently; a skip reason stops the actions but not the summary.
    """
    parsed = plans.withColumn("plan", F.from_json("plan_json", S.PLAN)).withColumn("trusted", is_trusted("author_assoc"))
    supported = F.col("plan.version").eqNullSafe(F.lit(S.VERSIONS["pr"]))
    skip = _set(F.col("plan.skip_reason"))
    executed = F.flatten(F.transform(F.coalesce("plan.actions", F.expr(f"cast(array() as array<{S.ACTION}>)")), _pr_action))
    return parsed.select(
        "run_id",
        F.when(~supported, "error").when(F.col("has_summary"), "update").otherwise("create").alias("summary_comment"),
        F.when(supported, skip).alias("skip_reason"),
        F.when(supported & skip.isNull(), executed).otherwise(F.expr("cast(array() as array<string>)")).alias("executed"),
    )


# -- documentation plans ---------------------------------------------------------------


def evaluate_docs_plans(plans: DataFrame) -> DataFrame:
    """High-confidence updates in order with their status.

    A path outside the documentation is refused and ends its plan: updates
    before it are applied, later ones are not reached.  A plan that asks to be
    skipped or has no such update gives one row of status ``skipped``.
    """
    parsed = plans.withColumn("plan", F.from_json("plan_json", S.DOCS_PLAN))
    updates = F.when(
        _set(F.col("plan.skip_reason")).isNull(), F.filter("plan.updates", lambda u: u["confidence"] == "high")
    )
    refused = F.array_position(
        F.transform("updates", lambda u: ~F.coalesce(u["file"], F.lit("")).rlike(S.DOC_PATH)), True
    )
    pos = F.col("seq") + 1
    status = (
        F.when(F.col("u").isNull(), "skipped")
        .when((F.col("stop") == 0) | (pos < F.col("stop")), "apply").when(pos == F.col("stop"), "refused").otherwise("not-reached")
    )
    return (
        parsed.withColumn("updates", updates)
        .withColumn("stop", refused)
        .select("run_id", "stop", F.posexplode_outer("updates").alias("seq", "u"))
        .select("run_id", "seq", "u.file", "u.type", "u.section", "u.content", status.alias("status"))
    )


# -- observation plans --------------------------------------------------------------------


def evaluate_observe_plans(plans: DataFrame) -> DataFrame:
    """Allowed and refused actions of each observation plan."""
    actions = F.from_json("plan_json", "actions array<struct<skill:string,params:string>>")["actions"]
    return plans.select("run_id", F.posexplode(actions).alias("seq", "a")).select(
        "run_id", "seq", F.col("a.skill").alias("skill"), F.coalesce(F.col("a.skill").isin(*S.OBSERVE_ACTIONS), F.lit(False)).alias("allowed")
    )


# -- validation -----------------------------------------------------------------------------


def plan_violations(plan: Column | str, domain: str) -> Column:
    """Names of the schema rules a plan breaks, empty for a valid one."""
    text = F.col(plan) if isinstance(plan, str) else plan
    value = strict_json(text)
    typed = F.from_json(text, S.TYPED_PLAN)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))
    at = lambda path: F.try_variant_get(value, path, "variant")
    string = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    is_text = lambda v: kind(v) == "STRING"
    is_list = lambda path: kind(at(path)).startswith("ARRAY")
    skip_ok = kind(at("$.skip_reason")).isin("VOID", "STRING")
    rules = {"version": string(at("$.version")) == S.VERSIONS[domain]}
    actions = typed["actions"]
    if domain in ("issue", "pr"):
        skills = S.ISSUE_SKILLS if domain == "issue" else S.PR_SKILLS
        if domain == "issue":
            rules["reasoning"] = is_text(at("$.reasoning")) & (string(at("$.reasoning")) != "")
        rules["actions"] = is_list("$.actions")
        rules["skill"] = ~F.coalesce(F.exists(actions, lambda a: ~string(a["skill"]).isin(*skills)), F.lit(False))
    if domain == "issue":
        rules["params"] = ~F.coalesce(F.exists(actions, lambda a: ~kind(a["params"]).startswith("OBJECT")), F.lit(False))
        rules["skip_reason"] = skip_ok
    if domain == "pr":
        named = lambda a: F.coalesce(F.try_variant_get(a["confidence"], "$", "string"), F.lit("medium"))
        rules["confidence"] = ~F.coalesce(F.exists(actions, lambda a: ~named(a).isin(*S.CONFIDENCES)), F.lit(False))
    if domain == "docs":
        fields = ("id", "file", "reason", "content", "confidence")
        bad_update = lambda u: ~string(u["type"]).isin("create", "modify") | ~_every([is_text(u[f]) for f in fields])
        bad_skip = lambda s: ~is_text(s["file"]) | ~is_text(s["reason"])
        rules["summary"] = is_text(at("$.summary"))
        rules["updates"] = is_list("$.updates") & ~F.coalesce(F.exists(typed["updates"], bad_update), F.lit(False))
        rules["skipped"] = is_list("$.skipped") & ~F.coalesce(F.exists(typed["skipped"], bad_skip), F.lit(False))
        rules["skip_reason"] = skip_ok | (kind(at("$.skip_reason")) == "MISSING")
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return F.when(value.isNull(), F.array(F.lit("not-json"))).otherwise(broken)


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def validate_plans(plans: DataFrame) -> DataFrame:
    """``valid`` and ``violations`` for plans of any domain (column ``domain``)."""
    found = F.array(F.lit("unknown-domain"))
    for domain in S.VERSIONS:
        found = F.when(F.col("domain") == domain, plan_violations("plan_json", domain)).otherwise(found)
    return (
        plans.withColumn("__v", found)
        .withColumn("violations", F.array_join("__v", ","))
        .withColumn("valid", F.size("__v") == 0)
        .drop("__v", "plan_json")
    )


# -- labels -----------------------------------------------------------------------------------


def label_state(ops: DataFrame, issues: DataFrame) -> DataFrame:
    """Labels of each issue after its label operations, in order.

    ``ops(repo, number, seq, op, labels)`` with op add, remove, set_priority,
    mark_duplicate or escalate; ``issues(repo, number, labels)``.  The last
    operation that touches a label decides, so the ordered fold is a maximum
    per label and an issue with many operations is reduced before the shuffle.
    Labels are one label whatever their case, in the spelling they had first.
    """
    touch = lambda name, step, present: F.struct(name.alias("label"), F.lit(step).alias("step"), F.lit(present).alias("present"))
    each = lambda names, step, present: F.transform(names, lambda x: touch(x, step, present))
    given = _listed(F.col("labels"))
    four = F.array(*[F.lit(f"priority:{p}") for p in S.PRIORITIES])
    human = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(S.DEFAULT_ESCALATION)))
    op = F.col("op")
    touched = (
        F.when(op == "add", each(given, 1, True))
        .when(op == "remove", each(given, 1, False))
        .when(op == "set_priority", F.concat(each(four, 0, False), each(given, 1, True)))
        .when(op == "mark_duplicate", F.array(touch(F.lit("duplicate"), 1, True)))
        .when(op == "escalate", each(human, 1, True))
    )
    changes = ops.select("repo", "number", F.col("seq").cast("bigint").alias("seq"), F.inline(touched))
    changed = ops.select("repo", "number").distinct()
    start = issues.join(changed, ["repo", "number"], "left_semi").select(
        "repo",
        "number",
        F.lit(-(1 << 62)).alias("seq"),
        F.inline_outer(each(spelled_labels(F.coalesce("labels", F.lit(""))), 1, True)),
    )
    spelling = F.min_by("label", F.when(F.col("present"), F.struct("seq", "step")))
    final = (
        start.unionByName(changes)
        .groupBy("repo", "number", F.lower("label").alias("key"))
        .agg(F.max(F.struct("seq", "step", "present"))["present"].alias("present"), spelling.alias("label"))
    )
    labels = F.array_join(F.sort_array(F.collect_list(F.when(F.col("present"), F.col("label")))), ",")
    known = issues.select("repo", "number").distinct()
    return final.groupBy("repo", "number").agg(labels.alias("labels")).join(known, ["repo", "number"], "left_semi")
