import json

from pyspark.sql import functions as F

from gatelake.sinks.results import write_gate_results
from gatelake.sources import reports as r

COVERAGE = {
    "sample.info": ("TN:\nSF:a\nLF:60\nLH:45\nend_of_record\nSF:b\nLF:40\nLH:30\nend_of_record\n", "lcov", 75.0),
    "sample.out": ("mode: set\na/b.go:1.1,2.2 1 1\na/b.go:3.1,4.2 1 0\n", "go", 50.0),
    "cobertura.xml": ('<?xml version="1.0"?>\n<coverage line-rate="0.87"><package line-rate="0.5"/></coverage>\n', "cobertura", 87.0),
    "jacoco.xml": ('<report>\n<counter type="BRANCH" missed="9" covered="1"/>\n<counter type="LINE" missed="20" covered="80"/>\n</report>\n', "jacoco", 80.0),
    "summary.json": ('{"total":{"lines":{"pct":87.5}}}', "istanbul", 87.5),
    "empty.json": ("{}", "istanbul", 0.0),
    "zero.lcov": ("LF:0\nLH:0\n", "lcov", 0.0),
    "noext": ("mode: atomic\nx.go:1.1,1.2 3 2\n", "go", 100.0),
    "plain": ("nothing", "unknown", None),
}


def test_coverage_files(spark, tmp_path):
    folder = tmp_path / "repo-a" / "run-1"
    folder.mkdir(parents=True)
    for name, (content, _, _) in COVERAGE.items():
        (folder / name).write_text(content)
    rows = r.coverage_percent(r.read_coverage(spark, str(tmp_path))).collect()
    assert {x.path: (x.format, x.coverage_percent) for x in rows} == {n: c[1:] for n, c in COVERAGE.items()}
    assert {(x.repo, x.run_id) for x in rows} == {("repo-a", "run-1")}


def stats(*groups):
    return json.dumps({"groups": [{"by": {"outcome": o}, "totals": {"sum(quantity)": q}} for o, q in groups]})


def test_outcome_stats(spark, tmp_path):
    documents = [stats(("accepted", 9000), ("filtered", 5), ("accepted", 1000)), stats(("filtered", 3)), '{"groups":[]}', "{}", '{"groups":[{"by":{"outcome":"accepted"},"totals":{}}]}']
    (tmp_path / "s.json").write_text("\n".join(documents))
    assert [x.quantity for x in r.read_outcome_stats(spark, str(tmp_path)).collect()] == [10000, 0, 0, 0, 0]


def test_scan_reports(spark, tmp_path):
    vulnerability = {"VulnerabilityID": "CVE-1", "PkgName": "p", "Severity": "CRITICAL"}
    report = {"repo": "a", "run_id": "1", "Results": [{"Target": "t", "Vulnerabilities": [vulnerability, vulnerability]}, {"Target": "clean"}]}
    (tmp_path / "cve").mkdir()
    (tmp_path / "cve" / "a.json").write_text(json.dumps(report) + "\n" + json.dumps({"repo": "b", "run_id": "2"}))
    found = r.read_cve_report(spark, str(tmp_path / "cve"))
    runs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "repo string, run_id string")
    assert {x.repo: x.findings for x in r.report_counts(runs, found).collect()} == {"a": 2, "b": 0, "c": 0}
    (tmp_path / "sec").mkdir()
    (tmp_path / "sec" / "1.json").write_text('[\n {"RuleID":"r","File":"f","StartLine":3,"Secret":"hidden"}\n]')
    (tmp_path / "sec" / "2.json").write_text("[]")
    reports = r.read_secret_report(spark, str(tmp_path / "sec"))
    got = {x.run_id: (x.secrets_count, x.found, x.report_missing) for x in r.secret_counts(runs.select("run_id"), reports).collect()}
    assert got == {"1": (1, True, False), "2": (0, False, False), "3": (0, False, True)}
    assert "hidden" not in str(r.secret_findings(reports).collect())


def test_transcripts_of_three_shapes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"system"}\n\n{"type":"result","result":"x"}\n')
    (tmp_path / "b.json").write_text('{\n "type": "result"\n}')
    (tmp_path / "c.txt").write_text("plain\nwords\n")
    got = [(x.run_id, x.line_no, x.shape) for x in r.read_transcripts(spark, str(tmp_path)).orderBy("run_id", "line_no").collect()]
    assert got == [("a", 0, "jsonl"), ("a", 1, "jsonl"), ("b", 0, "json"), ("c", 0, "text")]


def test_env_matrix(spark):
    lines = ["| Var Name | Required In | Source |", "| --- | --- | --- |", "| A_KEY | staging, production | vault |", "| B | dev | x | extra |", "text"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted(map(tuple, r.parse_env_matrix(df).collect())) == [("A_KEY", "production", "vault"), ("A_KEY", "staging", "vault"), ("B", "dev", "x")]


def envelope(spark, **fields):
    row = {"event_name": "issues", "event_action": "opened", "mode": "auto", "repo": "o/r", "issue": None, "comment": None,
           "client_payload": None, "form": None, "area_labels": "[]", "severity_labels": "[]", "duplicates": "[]", **fields}
    return r.normalize_events(spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))).first()


def test_event_envelope(spark):
    issue, payload = '{"number":7,"title":"I"}', '{"title":"P","issue":{"number":9,"title":"N"}}'
    both = envelope(spark, issue=issue, client_payload=payload)
    assert (both.issue_number, both.subject) == (7, "I")
    assert envelope(spark, client_payload=payload).subject == "P"
    nested = envelope(spark, client_payload='{"issue":{"number":9,"title":"N"}}')
    assert (nested.issue_number, nested.subject) == (9, "N")
    assert (envelope(spark).issue_number, envelope(spark).subject) == (None, "external issue event")
    assert envelope(spark, area_labels='["a","b"]', severity_labels='["b"]').management.labels_applied == ["a", "b", "b"]


def test_one_bad_feed_does_not_stop_another(spark):
    feed = lambda *rows: spark.createDataFrame([(x,) for x in rows], "value string")
    good = '{"service":"s","window_end":"w","name":"n","value":1.5}'
    out = r.collect_metrics({"a": feed(good), "b": feed("broken", good), "c": feed()})
    assert sorted((x.provider, x.ok) for x in out.collect()) == [("a", True), ("b", False), ("b", True)]


def test_results_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "out")
    df = lambda *rows: spark.createDataFrame(rows, "service string, day string")
    day = F.to_date("day")
    write_gate_results(df(("a", "2024-01-01"), ("b", "2024-01-02")), path, day)
    write_gate_results(df(("c", "2024-01-02")), path, day)
    assert sorted(x.service for x in spark.read.parquet(path).collect()) == ["a", "c"]
