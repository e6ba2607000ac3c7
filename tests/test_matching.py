import datetime
import random

from pyspark.sql import functions as F

from gatelake import catalog
from gatelake.catalog.registry import JOBS
from gatelake.functions import patterns as P
from gatelake.operators import matching as m
from gatelake.operators import release as r
from gatelake.operators import upkeep as u

catalog.load()
T0 = datetime.datetime(2024, 1, 1)


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def keywords(spark, title):
    return spark.createDataFrame([(title,)], "title string").select(m.title_keywords("title")).first()[0]


def shuffled_bytes(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_keywords(spark):
    assert keywords(spark, "") == []
    assert keywords(spark, "the and for") == []
    assert keywords(spark, "bug:") == []
    assert keywords(spark, "Feature: Login is_broken on iOS") == ["login", "broken", "ios"]
    assert keywords(spark, "building x pipeline") == ["ing", "pipeline"]
    assert keywords(spark, "fix: one two three four five six seven")[:3] == ["fix", "one", "two"]
    assert len(keywords(spark, "alpha beta gamma delta epsilon zeta eta theta")) == 6


def words(title):
    clean = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in title.lower())
    return clean.split()


def test_duplicates_against_brute_force_with_copies_and_hot_words(spark):
    rnd = random.Random(11)
    vocabulary = ["login", "crash", "button", "export", "search"] + [f"w{i:03}" for i in range(40)]
    titles = {n: "login crash" if n % 3 == 0 else " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 7))) for n in range(240)}
    issues = spark.createDataFrame([("r", n, t) for n, t in titles.items()], "repo string, number bigint, title string")
    want = set()
    for n, t in titles.items():
        keys = [w for w in words(t) if len(w) > 2 and w not in P.TITLE_STOP_WORDS][:6]
        hits = sorted((c for c, other in titles.items() if keys and set(keys) <= set(words(other))), reverse=True)[:5]
        want |= {(n, c, i + 1) for i, c in enumerate(hits) if c != n}
    # Tiny posting lists force the salted path.
    got = {(x.number, x.candidate, x.slot) for x in m.find_duplicates(issues, posting_rows=7).collect()}
    assert got == want


def test_hits_of_a_single_keyword_are_not_shuffled(spark):
    rnd = random.Random(5)
    vocabulary = [f"word{i:02}" for i in range(14)]
    titles = {n: " ".join(rnd.sample(vocabulary, 6)) for n in range(2500)}
    issues = spark.createDataFrame([("r", n, t) for n, t in titles.items()], "repo string, number bigint, title string")
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        before = shuffled_bytes(spark)
        got = {(x.number, x.candidate, x.slot) for x in m.find_duplicates(issues).collect()}
    finally:
        for limit in limits:
            spark.conf.unset(limit)
    # A keyword is in a thousand titles; their pairs would be many megabytes.
    assert shuffled_bytes(spark) - before < 2_000_000
    want = set()
    for n, t in titles.items():
        hits = sorted((c for c, other in titles.items() if set(t.split()) <= set(other.split())), reverse=True)[:5]
        want |= {(n, c, i + 1) for i, c in enumerate(hits) if c != n}
    assert got == want


def test_self_takes_a_slot(spark):
    issues = spark.createDataFrame([("r", n, "same title") for n in range(7)], "repo string, number bigint, title string")
    got = m.find_duplicates(issues).filter("number = 6").collect()
    assert sorted(x.candidate for x in got) == [2, 3, 4, 5]


def test_similar_against_brute_force(spark):
    rnd = random.Random(13)
    base = [f"t{i}" for i in range(30)]
    titles = {}
    for n in range(150):
        if n % 3 == 0:
            titles[n] = " ".join(base)  # copies
        elif n % 3 == 1:
            near = list(base)
            near[rnd.randrange(30)] = f"x{rnd.randrange(5)}"
            titles[n] = " ".join(near)  # near copies
        else:
            titles[n] = " ".join(rnd.choices(base + [f"y{i}" for i in range(20)], k=8))
    issues = spark.createDataFrame([("r", n, t) for n, t in titles.items()], "repo string, number bigint, title string")
    sets = {n: set(t.split()) for n, t in titles.items()}
    want = {}
    for n in titles:
        scored = [(len(sets[n] & sets[o]) / len(sets[n] | sets[o]), -o) for o in titles if o < n]
        scored = [s for s in scored if s[0] > 0.8]
        if scored:
            want[n] = -max(scored)[1]
    got = {x.number: x.duplicate_of for x in m.similar_issues(issues).collect()}
    assert got == want


def test_errors(spark):
    frames = ["a", "b", "c", "d", "e", "f"]
    issues = spark.createDataFrame(
        [(1, "fp1", "Boom 1", "TypeError", frames), (2, "fp2", "Other", "TypeError", ["a", "b", "c", "x", "y"])],
        "number bigint, fingerprint string, title string, exc_class string, frames array<string>",
    )
    cases = [
        ("same fingerprint", "fp2", "?", "KeyError", ["q"], 9, True, False, ("duplicate", 2)),
        ("five frames", "n", "?", "TypeError", frames[:5], 9, True, False, ("duplicate", 1)),
        ("three frames", "n", "?", "TypeError", ["a", "b", "c", "q", "r"], 9, True, False, ("duplicate", 1)),
        ("two frames", "n", "?", "TypeError", ["a", "b", "q", "r", "s"], 9, True, False, ("create", None)),
        ("other class", "n", "?", "KeyError", frames, 9, True, False, ("create", None)),
        ("message without numbers", "n", "boom 77", "TypeError", ["z"], 9, True, False, ("duplicate", 1)),
        ("rare network noise", "fp1", "?", "NetworkError", frames, 4, True, False, ("ignore", None)),
        ("frequent network error", "n", "?", "NetworkError", ["z"], 5, True, False, ("create", None)),
        ("foreign frames", "fp1", "?", "TypeError", frames, 9, False, False, ("ignore", None)),
        ("crawler", "fp1", "?", "TypeError", frames, 9, True, True, ("ignore", None)),
    ]
    df = spark.createDataFrame(
        [c[:8] for c in cases],
        "error_id string, fingerprint string, title string, exc_class string, frames array<string>, count bigint, app_frames boolean, bot_4xx boolean",
    )
    got = {x.error_id: (x.decision, x.duplicate_of) for x in m.dedupe_errors(df, issues).collect()}
    assert got == {c[0]: c[8] for c in cases}


def test_deploy_correlation(spark):
    deploys = spark.createDataFrame([("s", minutes(0)), ("s", minutes(50)), ("o", minutes(60))], "service string, ts timestamp")
    errors = spark.createDataFrame(
        [(1, "s", minutes(30), "p0"), (2, "s", minutes(31), "p0"), (3, "s", minutes(55), "p2"), (4, "s", minutes(-1), "p1"), (5, "x", minutes(1), "p0")],
        "i int, service string, ts timestamp, priority string",
    )
    got = {x.i: (x.deploy_related, x.suggest_rollback) for x in m.correlate_deploys(errors, deploys).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False), 5: (False, False)}


def test_fix_verification(spark):
    fixes = spark.createDataFrame([(1, "Fixes #7, closes #8", minutes(0)), (2, "fixes #8", minutes(100))], "pr int, body string, deployed_at timestamp")
    errors = spark.createDataFrame([("7", minutes(0)), ("8", minutes(60)), ("8", minutes(61))], "ref string, ts timestamp")
    verified = m.verify_fixes(fixes, errors)
    got = {x.pr: (x.confirmed, x.regressed) for x in m.fix_verdicts(verified).collect()}
    assert got == {1: ("7", "8"), 2: ("8", "none")}


def test_flags(spark):
    code = spark.createDataFrame([("dead", 6), ("dead-few", 5), ("stale", 1), ("lost", 2), ("lost-many", 3), ("ok", 1)], "name string, n_files bigint")
    registry = spark.createDataFrame(
        [("dead", "archived", 0, 0, 30), ("dead-few", "archived", 0, 0, 40), ("stale", "live", 100, 31, 7), ("ok", "live", 100, 30, 7), ("unused", "live", 5, 0, 0)],
        "name string, status string, rolled_out_pct int, days_full int, days_since_eval int",
    )
    got = {x.name: (x.state, x.priority) for x in m.flag_lifecycle(code, registry).collect()}
    assert got == {
        "dead": ("dead", "high"), "dead-few": ("dead", "none"), "stale": ("stale", "medium"), "lost": ("orphaned", "low"),
        "lost-many": ("orphaned", "none"), "ok": ("active", "none"), "unused": ("orphaned", "low"),
    }


def test_registry_merge_keeps_the_earliest(spark):
    df = spark.createDataFrame([("t", 1, "late"), ("t", 0, "early"), ("u", 3, "only")], "name string, source_order int, payload string")
    assert {x.name: x.payload for x in m.merge_registries(df).collect()} == {"t": "early", "u": "only"}
    assert {x.name: x.payload for x in m.merge_registries(df, "latest").collect()} == {"t": "late", "u": "only"}


def test_concurrent_runs_on_a_hot_group(spark):
    rnd = random.Random(17)
    runs = [("hot" if i % 3 else "cold", i, s := rnd.randrange(0, 5000), s + rnd.randrange(1, 900)) for i in range(250)]
    df = spark.createDataFrame([(g, i, minutes(s), minutes(e)) for g, i, s, e in runs], "concurrency_group string, run_id int, started_at timestamp, ended_at timestamp")
    got = {x.run_id: x.others for x in m.concurrent_deploys(df).collect()}
    assert got == {i: sum(g2 == g and j != i and s2 <= s < e2 for g2, j, s2, e2 in runs) for g, i, s, _ in runs}


def test_ancestor_limit(spark):
    rows = [("r", f"c{i}", f"c{i - 1}" if i else None, i == 0) for i in range(26)]
    df = spark.createDataFrame(rows, "repo string, sha string, parent string, has_path boolean")
    got = {x.sha: (x.ancestor, x.distance) for x in m.nearest_ancestor_with(df).collect()}
    assert got["c0"] == ("c0", 0) and got["c19"] == ("c0", 19) and got["c20"] == (None, None)


def test_repeats(spark):
    existing = spark.createDataFrame(
        [("i1", "run:1", True, minutes(0)), ("i1", "run:2", False, minutes(0))], "target string, marker string, is_open boolean, at timestamp"
    )
    cases = [
        ("incident", "i1", "run:1", 10, "skip"), ("incident", "i1", "run:2", 10, "create"), ("audit", "i1", "run:9", 10, "skip"),
        ("audit", "i2", "run:1", 10, "create"), ("ci_failure", "i1", "run:1", 360, "comment"), ("ci_failure", "i1", "run:1", 361, "create"),
        ("sticky", "i1", "run:2", 1, "update"), ("sticky", "i1", "run:3", 1, "create"),
    ]
    df = spark.createDataFrame([(i, *c[:3], minutes(c[3])) for i, c in enumerate(cases)], "action_id int, kind string, target string, marker string, at timestamp")
    assert {x.action_id: x.decision for x in m.suppress_repeats(df, existing).collect()} == {i: c[4] for i, c in enumerate(cases)}


def test_cve_and_updates(spark):
    findings = spark.createDataFrame([("r", "CVE-1", "left-pad"), ("r", "CVE-2", "pad")], "repo string, cve string, package string")
    prs = spark.createDataFrame([("r", 42, "chore(deps): bump left-pad from 1.x to 2.x")], "repo string, pr int, title string")
    assert {x.cve: x.advice for x in m.correlate_cves(findings, prs).collect()} == {"CVE-1": "upgrade PR #42", "CVE-2": "manual"}
    updates = spark.createDataFrame(
        [("r", i, "renovate[bot]", "minor" if i % 2 else "") for i in range(45)] + [("r", 99, "kim", "major"), ("r", 98, "renovate", "patch,breaking-change")],
        "repo string, pr int, author string, labels string",
    )
    row = u.dependency_updates(updates).first()
    assert (row.major_count, row.minor_count, row.patch_count) == (1, 45, 0)
    assert row.major_prs == "98" and row.minor_prs.split(",") == [str(i) for i in range(44, 24, -1)]


def test_pairs_below_the_floor_are_not_shuffled(spark):
    # Any two titles share words of their prefixes, and about half of all words.
    rnd = random.Random(17)
    words = [f"word{i}" for i in range(60)]
    titles = [rnd.sample(words, 40) for _ in range(400)]
    titles += [[*t[:-1], "other"] for t in titles[:50]]
    issues = spark.createDataFrame([("r", n, " ".join(t)) for n, t in enumerate(titles)], "repo string, number bigint, title string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x.number: (x.duplicate_of, x.similarity) for x in m.similar_issues(issues).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {400 + n: (n, 39 / 41) for n in range(50)}
    assert shuffled_bytes(spark) - before < 4_000_000


def test_only_open_requests_count(spark):
    findings = spark.createDataFrame([("r", "CVE-1", "left-pad")], "repo string, cve string, package string")
    rows = [("r", 3, "renovate[bot]", "bump left-pad", "major", "closed"), ("r", 5, "renovate[bot]", "bump left-pad", "major", "OPEN"),
            ("r", 4, "renovate[bot]", "bump left-pad", "patch", "merged"), ("r", 2, "renovate[bot]", "bump left-pad", "minor", None)]
    prs = spark.createDataFrame(rows, "repo string, pr int, author string, title string, labels string, state string")
    assert m.correlate_cves(findings, prs).first().upgrade_pr == 5
    row = u.dependency_updates(prs).first()
    assert (row.major_count, row.minor_count, row.patch_count, row.major_prs) == (1, 0, 0, "5")


def test_update_requests_of_every_order_state_count(spark, tmp_path):
    # Keys 0 and 1 mod 7 are bots'; labels go by the key mod 9.
    rows = [(7, 20, "F"), (63, 20, "P"), (64, 20, "O"), (126, 20, "F"), (71, 20, None), (9, 20, "O")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string")
    orders.selectExpr("*", "'1-URGENT' AS o_orderpriority", "timestamp'2024-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    row = JOBS["dependency_updates"](spark, str(tmp_path)).first()
    assert (row.repo, row.major_count, row.minor_count, row.patch_count) == ("repo-0", 2, 3, 0)
    assert (row.major_prs, row.minor_prs) == ("126,63", "71,64,7")


def test_version_bump(spark):
    commits = spark.createDataFrame(
        [("a", "fix: x", ""), ("b", "feat: y", ""), ("c", "fix!: z", ""), ("d", "docs: d", "BREAKING CHANGE: q"), ("e", "chore: e", "")],
        "repo string, subject string, body string",
    )
    tags = spark.createDataFrame([(x, t) for x in "abcd" for t in ("v1.9.0", "v1.10.2", "nightly")], "repo string, tag string")
    got = {x.repo: (x.bump, x.previous, x.next) for x in r.version_bump(commits, tags).collect()}
    assert got == {
        "a": ("patch", "v1.10.2", "v1.10.3"), "b": ("minor", "v1.10.2", "v1.11.0"), "c": ("major", "v1.10.2", "v2.0.0"),
        "d": ("major", "v1.10.2", "v2.0.0"), "e": ("patch", "", "v0.0.1"),
    }


def test_byte_cap_counts_bytes(spark):
    df = spark.createDataFrame([("éé",)], "t string").select(F.octet_length(r.cap_bytes("t", 3)))
    assert df.first()[0] == 3
