"""One golden row for each rule that table data rarely shows."""

import os
import subprocess
import sys

import pytest

from gatelake.operators import gates, matching, release
from gatelake.operators import text_policy as tp
from gatelake.plans import evaluate, extract, prompts
from gatelake.plans import schemas as S
from gatelake.sources import reports
from gatelake.streaming import observation
from gatelake.streaming.runtime import run_available
from pyspark.sql import functions as F


def test_a_run_without_any_gate_job_is_a_row(spark):
    jobs = spark.createDataFrame([("r", 1, "build", 1, "success")], "repo string, run_id int, job string, started_at int, conclusion string")
    row = gates.gate_matrix(jobs).first()
    assert row.lint_result == "skipped" and not row.lint_passed


def test_runs_follow_each_other_in_time_or_as_numbers(spark):
    rows = [("s", "9", 100), ("s", "10", 200), ("s", "11", 300)]
    df = spark.createDataFrame(rows, "service string, run_id string, p95 int")
    assert {r.run_id: r.baseline_p95 for r in gates.perf_regression(df).collect()} == {"9": None, "10": 100, "11": 200}
    timed = df.withColumn("run_ts", -F.col("p95"))
    assert {r.run_id: r.baseline_p95 for r in gates.perf_regression(timed).collect()} == {"9": 200, "10": 300, "11": None}


def test_unknown_coverage_format_never_passes(spark):
    row = gates.coverage_gate(spark.createDataFrame([(None, "stg")], "coverage_percent double, mode string")).first()
    assert (row.passed, row.verdict) == (False, "unknown-format")


def test_quiet_repositories_are_listed(spark):
    rows = [("quiet", "src/a.py", 1), ("quiet", "docs/a.md", 2), ("moved", "docs/a.md", 1), ("moved", "src/a.py", 2)]
    got = release.doc_drift(spark.createDataFrame(rows, "repo string, path string, ts int")).collect()
    assert {(r.repo, r.code_files, r.drift, r.files) for r in got} == {("quiet", 0, False, ""), ("moved", 1, True, "src/a.py")}


def test_context_takes_the_first_paths(spark):
    files = spark.createDataFrame([("r", f"f{i:02}", 10) for i in range(60)], "repo string, path string, size_bytes int")
    assert {r.path for r in release.context_budget(files).collect()} == {f"f{i:02}" for i in range(50)}


def test_skipped_documentation_plans_are_rows(spark):
    plans = [(1, '{"skip_reason":"quiet","updates":[]}'), (2, '{"updates":[{"file":"docs/a.md","confidence":"low"}]}')]
    got = evaluate.evaluate_docs_plans(spark.createDataFrame(plans, "run_id int, plan_json string")).collect()
    assert {(r.run_id, r.status) for r in got} == {(1, "skipped"), (2, "skipped")}


def test_labels_have_no_case(spark):
    issues = spark.createDataFrame([("r", 1, "Bug,Area/X")], "repo string, number int, labels string")
    ops = spark.createDataFrame([("r", 1, 1, "remove", ["bug"]), ("r", 1, 2, "add", ["area/x", "New"])],
                                "repo string, number int, seq int, op string, labels array<string>")
    assert evaluate.label_state(ops, issues).first().labels == "Area/X,New"
    files = spark.createDataFrame([(1, "a.py", "docs,Keep")], "pr int, path string, labels string")
    row = tp.label_prs(files, {"Docs": ["*.md"]}, ["pr"]).first()
    assert (row.labels, row.added, row.removed) == ("Keep", "", "docs")


def test_missing_fingerprints_match_by_the_rest_only(spark):
    schema = "fingerprint string, title string, exc_class string, frames array<string>"
    frames = ["a", "b", "c", "d", "e"]
    errors = spark.createDataFrame(
        [(1, None, "Failed 1", "E", frames, 9, True, False), (2, None, "Other", "F", ["x"], 9, True, False)],
        f"error_id int, {schema}, count int, app_frames boolean, bot_4xx boolean",
    )
    issues = spark.createDataFrame([(7, None, "Failed 2", "E", frames)], f"number int, {schema}")
    got = {r.error_id: (r.decision, r.duplicate_of) for r in matching.dedupe_errors(errors, issues).collect()}
    assert got == {1: ("duplicate", 7), 2: ("create", None)}


def test_only_open_items_count_as_repeats(spark):
    actions = spark.createDataFrame([(1, "ci_failure", "t", "m", "2024-01-01 05:00:00")], "action_id int, kind string, target string, marker string, at string")
    for is_open, decision in ((True, "comment"), (False, "create")):
        items = spark.createDataFrame([("t", "m", is_open, "2024-01-01 03:00:00")], "target string, marker string, is_open boolean, at string")
        assert matching.suppress_repeats(actions, items).first().decision == decision


@pytest.mark.parametrize(
    "text,ok",
    [('{"a":1}', True), (' [1, 2] ', True), ("3", True), ('{"a":1} trailing', False), ("1] , [2", False), ("1} , {", False),
     ("1,2", False), ('{"a":1}{"b":2}', False), ("", False), ('{"a":', False), (None, False)],
)
def test_strict_json(spark, text, ok):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(tp.strict_json("t").isNotNull()).first()[0] == ok


def test_junk_after_json_is_an_error(spark):
    files = spark.createDataFrame([("x.json", '{"a":1} trailing', 9, True)], "path string, content string, size_bytes int, ends_with_newline boolean")
    assert tp.audit_file_policy(files).first().violations == "bad-json"
    plan = '{"version":"%s","summary":"s","updates":[],"skipped":[],"skip_reason":null}' % S.VERSIONS["docs"]
    rows = spark.createDataFrame([("docs", plan), ("docs", plan + " junk")], "domain string, plan_json string")
    assert [r.violations for r in evaluate.validate_plans(rows).collect()] == ["", "not-json"]


def test_a_cut_off_line_spoils_no_plan(spark):
    plan = '{"version":"%s","reasoning":"r","actions":[]}' % S.VERSIONS["issue"]
    files = spark.createDataFrame([(1, plan + "\n" + '{"type":"assist'), (2, "no json here"), (3, "x\n" + plan)], "run_id int, content string")
    shaped = reports.shape_transcripts(files)
    assert {(r.run_id, r.line_no, r.shape, r.bad) for r in shaped.collect()} == {
        (1, 0, "jsonl", False), (1, 1, "jsonl", True), (2, 0, "text", False), (3, 0, "jsonl", True), (3, 1, "jsonl", False)}
    runs = spark.createDataFrame([(i, False) for i in (1, 2, 3)], "run_id int, skipped boolean")
    assert {r.run_id: r.source for r in extract.extract_plans(shaped, runs, "issue").collect()} == {1: "record", 2: "fallback", 3: "record"}


def test_quotes_belong_to_subjects(spark, tmp_path):
    lines = ['a1\t"unclosed subject\tann\t2024-01-01', 'b2\t"whole"\tbob\t2024-01-02']
    path = tmp_path / "log"
    path.mkdir()
    (path / "part.csv").write_text("\n".join(line.replace("\\t", "\t") for line in lines) + "\n")
    subjects = {tuple(r)[1] for r in reports.read_commits(spark, str(path)).collect()}
    assert subjects == {'"unclosed subject', '"whole"'}


def test_prompt_keys_are_no_patterns(spark):
    row = spark.createDataFrame([("{{axb}} {{ a.b }} {{n}}", {"a.b": "1", "n": None}, {})],
                                "text string, context map<string,string>, automatic map<string,string>")
    assert prompts.render_prompts(row).first().rendered == "{{axb}} 1 {{n}}"


def test_an_empty_list_of_people_wins(spark):
    plan = '{"version":"%s","reasoning":"r","actions":[{"id":"1","skill":"assign_issue","params":{"assignees":[],"assignee":"kim"}}]}' % S.VERSIONS["issue"]
    schema = "run_id int, repo string, issue_number int, author_assoc string, has_tracker_token boolean, has_webhook boolean, plan_json string"
    plans = spark.createDataFrame([(1, "r", 5, "OWNER", True, True, plan)], schema)
    assert "kim" not in str(evaluate.evaluate_issue_plans(plans).collect())


def test_reports_do_not_depend_on_batches(spark, tmp_path):
    hours = {0: [0, 1, 13], 1: [7, 30], 2: [20, 31, 60], 3: [600]}
    for i, own in hours.items():
        rows = [("t", "m", f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00") for h in own]
        frame = spark.createDataFrame(rows, "target string, marker string, at string").withColumn("at", F.to_timestamp("at"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for per_batch in (1, 9):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
        out = run_available(observation.stream_repeat_suppression(stream, delay="100 hours"), "repeats").collect()
        got = sorted((r.at.day - 1) * 24 + r.at.hour for r in out)
        # 1 is within 6 hours of the report of 0, 13 of that of 7, 31 of that of 30; 600 is not final yet.
        assert got == [0, 7, 20, 30, 60]


def test_workers_get_the_package(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from gatelake.session import local_session\n"
        "import gatelake.catalog as c; c.load()\n"
        "from gatelake.catalog.registry import JOBS\n"
        "spark = local_session('2', partitions=2, shared=sys.argv[2])\n"
        "sys.path.pop(0)\n"
        "print('rows', JOBS['final_text'](spark, '/root/testdata/sf0.001').count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
