"""Joins: pins, duplicates, similar issues, deploy correlation, registries, ancestry."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import patterns as P
from gatelake.functions.timeline import HOUR_US, count_in_range, micros, probe_timeline
from gatelake.operators.keyword_index import search_blocks
from gatelake.operators.similar_sets import (
    CELLS, COUNTERS, SLICE, add_counters, best_earlier, find_partners, keep_raised, raise_counters, sort_words, visit_cells,
)
from gatelake.operators.text_policy import fix_refs
from gatelake.operators.upkeep import open_only
from gatelake.session import cut_lineage

# Fixed values -------------------------------------------------------------
NOISE_CLASSES = ("AbortError", "NetworkError")
NOISE_MAX_COUNT = 5
DEPLOY_WINDOW_MINUTES = 30
FIX_WINDOW_MINUTES = 60
ANCESTOR_LIMIT = 20
DUPLICATE_SLOTS = 5
UNRECORDED_LIMIT = 20
REPEAT_HOURS = 6
# ---------------------------------------------------------------------------


def pin_consistency(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of every action reference against the manifest.

    The manifest side is aggregated to one row per action and left without a
    hint: adaptive execution broadcasts it when its measured size allows and
    otherwise splits skewed actions of the large side.
    """
    entry = manifest.groupBy("action").agg(
        F.max("sha").alias("sha"), F.min(F.struct(_status_rank("status"), "status")).getField("status").alias("status")
    )
    status = (
        F.when(~F.col("ref").rlike("^[0-9a-f]{40}$"), "non-sha")
        .when(F.col("status") == "pending", "pending")
        .when(F.col("status") == "deprecated", "deprecated")
        .when(F.col("status").isNull(), "unknown")
        .when(~F.col("sha").rlike("^[0-9a-f]{40}$"), "invalid-manifest")
        .when(F.col("sha") != F.col("ref"), "mismatch")
        .otherwise("ok")
    )
    joined = refs.filter(~F.startswith("action", F.lit("./"))).join(entry, "action", "left")
    return joined.withColumn("pin_status", status).drop("sha", "status")


def _status_rank(status: str) -> Column:
    return F.when(F.col(status) == "pending", 0).when(F.col(status) == "deprecated", 1).otherwise(2).alias("rank")


def pin_totals(checked: DataFrame) -> DataFrame:
    """References checked and in error per repository with an estate total."""
    return (
        checked.rollup("repo")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("pin_status") != "ok").alias("errors"))
        .withColumn("repo", F.coalesce("repo", F.lit("ALL")))
    )


# -- duplicate search ----------------------------------------------------------


def title_words(title: str) -> Column:
    """Words of a title: lower-case, anything but ``[a-z0-9 ]`` is a blank."""
    clean = F.regexp_replace(F.lower(F.col(title)), "[^a-z0-9]+", " ")
    return F.array_remove(F.split(clean, " "), "")


def title_keywords(title: str) -> Column:
    """The first six words worth searching for, without the leading type word."""
    bare = F.regexp_replace(F.col(title), "(?i)" + P.TITLE_PREFIX_PATTERN, "")
    words = F.filter(
        F.split(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "), " "),
        lambda w: (F.length(w) > 2) & ~w.isin(*P.TITLE_STOP_WORDS),
    )
    return F.slice(words, 1, P.DUPLICATE_KEYWORDS)


def find_duplicates(issues: DataFrame, posting_rows: int = 8_000_000) -> DataFrame:
    """Up to five issues of the same repository whose title has all keywords of an issue.

    Candidates are ranked newest first; the issue itself takes a slot and is
    then removed.  Equal keyword sets and equal word sets are searched once
    (a word set keeps its newest five issues, which is all a top five can use).
    The word sets of a repository are dealt to blocks of about ``posting_rows``
    words; each search visits every block of its repository, where a task holds
    the posting lists, and leaves it with five candidates at most.  So no hit of a
    single keyword is ever shuffled, and no keyword is dropped.
    Titles are cut into words once and kept in the shared folder.
    """
    base = cut_lineage(
        issues.select(
            "repo",
            "number",
            F.sort_array(F.array_distinct(title_keywords("title"))).alias("kws"),
            F.sort_array(F.array_distinct(title_words("title"))).alias("words"),
        ),
        "title-words",
    )
    look = F.md5(F.concat_ws(" ", "words")).alias("look")
    newest = Window.partitionBy("repo", "look").orderBy(F.desc("number"))
    slots = (
        base.select("repo", look, "number")
        .withColumn("__rn", F.row_number().over(newest))
        .filter(F.col("__rn") <= DUPLICATE_SLOTS)
        .groupBy("repo", "look")
        .agg(F.collect_list("number").alias("numbers"))
        .select("repo", "numbers", F.array_max("numbers").alias("set_id"))
    )
    # One row per distinct word set: its newest issue stands for the set.
    titles = cut_lineage(
        base.select("repo", F.col("number").alias("set_id"), "words").join(slots, ["repo", "set_id"]), "word-sets"
    )
    searches = cut_lineage(
        base.filter(F.size("kws") > 0).select("repo", "kws").distinct().withColumn("query", F.monotonically_increasing_id()), "searches"
    )
    parts = F.greatest(F.lit(1), F.ceil(F.sum(F.size("words")) / posting_rows)).cast("int")
    blocks = titles.groupBy("repo").agg(parts.alias("blocks"))
    told = titles.join(blocks, "repo").select(
        "repo", F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("block"), F.lit(None).cast("bigint").alias("query"), "set_id", "words", "numbers"
    )
    asked = searches.join(blocks, "repo").select(
        "repo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", F.col("kws").alias("words")
    )
    rows = told.unionByName(asked, allowMissingColumns=True).repartition("repo", "block").sortWithinPartitions("repo", "block", "query")
    kind = base.schema["number"].dataType.simpleString()
    found = rows.mapInArrow(lambda batches: search_blocks(batches, DUPLICATE_SLOTS), f"query bigint, candidate {kind}")
    best = Window.partitionBy("query").orderBy(F.desc("candidate"))
    top = found.withColumn("slot", F.row_number().over(best)).filter(F.col("slot") <= DUPLICATE_SLOTS).join(searches, "query").drop("query")
    return (
        base.select("repo", "number", "kws")
        .join(top, ["repo", "kws"])
        .filter("candidate <> number")
        .select("repo", "number", "candidate", "slot")
    )


def similar_issues(issues: DataFrame, floor: float = 0.8, text: str = "title") -> DataFrame:
    """Best earlier issue of the repository with word-set similarity above ``floor``.

    Exact Jaccard with prefix filtering: words are ordered from rare to
    frequent, and two sets above the floor must share a word within their
    heads, where that of the smaller set is the shorter one.  A set is sent
    once to the cell of its repository and class of sizes, and once to the cell
    below, with its head and parity bits of all its words, which differ in no
    more places than the sets in words; blocks of a cell keep a task's memory
    bounded.  Up to here words are hashes, which can only add pairs.  Near
    sets of a cell are checked on the words together, so words are sent once
    for many pairs, and only the best earlier issue leaves a check.  Equal
    sets are joined once, as one set with its first two numbers, so copies
    never meet each other.  The earlier issue with the highest similarity wins,
    then the lowest number.
    """
    base = cut_lineage(
        issues.filter("repo IS NOT NULL AND number IS NOT NULL")
        .select("repo", "number", F.concat_ws(" ", F.sort_array(F.array_distinct(title_words(text)))).alias("words"))
        .withColumn("set", F.monotonically_increasing_id()),
        "word-sets",
    ).filter("words <> ''")
    repo, number = (base.schema[c].dataType.simpleString() for c in ("repo", "number"))
    hashes = F.transform(F.split("words", " "), lambda w: F.xxhash64("repo", w)).alias("hashes")
    hashed = base.select("repo", "number", "set", F.unhex(F.md5("words")).alias("look"), hashes)
    # How often words occur only orders them, so words may share a counter.
    ranks = _counters(base.select(hashes))
    told = f"repo {repo}, number {number}, set bigint, look binary, n int, class int, near bigint, head binary, bits binary"
    by_number = Window.partitionBy("repo", "look").orderBy("number")
    # Only the first issue of equal sets keeps its head.
    listed = cut_lineage(
        hashed.mapInArrow(lambda batches: sort_words(batches, ranks, floor), told)
        .withColumns({"first": F.first("number").over(by_number), "leads": F.row_number().over(by_number) == 1})
        .select("repo", "number", "first", "set", "n", "class", "near", *[F.when(F.col("leads"), F.col(c)).alias(c) for c in ("head", "bits")]),
        "prefixes",
    )
    cells = [F.pmod(F.hash("repo", F.col("class") + i), F.lit(CELLS)).alias(c) for i, c in ((-1, "below"), (0, "cell"), (1, "above"))]
    sets = listed.filter("head IS NOT NULL").select("repo", "set", "n", "near", "head", "bits", "class", *cells)
    sizes = sets.groupBy("cell").agg(F.sum(F.length("head") + F.length("bits")).alias("bytes"))
    weights = {x.cell: x.bytes for x in sizes.collect()}
    found = cut_lineage(
        sets.mapInArrow(
            lambda batches: visit_cells(batches, weights),
            f"repo {repo}, set bigint, n int, near bigint, head binary, bits binary, of int, block int, part int, role int",
        )
        .repartition("repo", "of", "block", "part")
        .sortWithinPartitions("repo", "of", "block", "part", "role")
        .mapInArrow(lambda batches: find_partners(batches, floor), "set bigint, unit bigint, partners array<bigint>"),
        "pairs",
    )
    visits = found.groupBy("set", "unit").agg(F.first("partners", ignorenulls=True).alias("partners"), F.max(F.col("partners").isNull()).alias("told"))
    # Most sets have no partner; few of those share the counter of one that has.
    raised = _counters(found.select(F.array(F.xxhash64("set")).alias("hashes")))
    words = base.withColumn("mark", F.xxhash64("set")).mapInArrow(
        lambda batches: keep_raised(batches, raised), f"repo {repo}, number {number}, words string, set bigint"
    )
    scored = (
        visits.join(words, "set")
        .select("unit", "told", "set", "repo", "number", "words", "partners")
        .repartition("unit")
        .sortWithinPartitions("unit", F.desc("told"))
        .mapInArrow(lambda batches: best_earlier(batches, floor), f"repo {repo}, number {number}, earlier {number}, sim double")
        .groupBy("repo", "number")
        .agg(F.max(F.struct("sim", (-F.col("earlier")).alias("neg"))).alias("best"))
        .select("repo", "number", (-F.col("best.neg")).alias("duplicate_of"), F.col("best.sim").alias("similarity"))
    )
    copies = listed.filter("number > first").select("repo", "number", F.col("first").alias("duplicate_of"), F.lit(1.0).alias("similarity"))
    return scored.unionByName(copies)


def _counters(hashed: DataFrame) -> bytes:
    """A byte for each counter that ``hashes`` fall to: how often they do, on a scale of logarithms."""
    slices = hashed.mapInArrow(raise_counters, "slice int, at binary, n binary").repartition("slice")
    ranks = {x.slice: x.ranks for x in slices.mapInArrow(add_counters, "slice int, ranks binary").collect()}
    return b"".join(ranks.get(no, bytes(SLICE)) for no in range(COUNTERS // SLICE))


# -- errors -----------------------------------------------------------------------


def _match_keys(groups: DataFrame, kept: str) -> DataFrame:
    """``kept, strength, key``: join keys of errors or issues, each with its strength.

    Two errors share at least k of their top five frames exactly when they
    share a k-subset of them, so frame overlap becomes an equi-join on subsets.
    """
    # Columns of their own, so that they are worked out once a row and not once a key.
    parted = groups.select(
        kept, "fingerprint", "exc_class", F.regexp_replace(F.lower("title"), "[0-9]+", "#").alias("plain"),
        F.sort_array(F.array_distinct(F.slice("frames", 1, 5))).alias("top"),
    )

    def key(strength: int, *parts: Column) -> Column:
        whole = F.concat(F.lit(str(strength)), *[x for p in parts for x in (F.lit("\x1f"), p)])
        return F.struct(F.lit(strength).alias("strength"), whole.alias("key"))

    keys = [key(9, F.col("fingerprint")), key(4, F.col("exc_class"), F.col("plain"))]
    for k, strength in ((5, 8), (4, 7), (3, 6)):
        keys += [key(strength, F.col("exc_class"), *[F.get("top", F.lit(i)) for i in subset]) for subset in combinations(range(5), k)]
    # A part that is missing, or a frame that there is not, equals nothing, so there is no key with it.
    return parted.select(kept, F.explode(F.array(*keys)).alias("k")).select(kept, "k.*").filter("key IS NOT NULL")


def dedupe_errors(errors: DataFrame, issues: DataFrame) -> DataFrame:
    """create / duplicate / ignore for each error group.

    ``errors(error_id, fingerprint, title, exc_class, frames, count, app_frames, bot_4xx)``,
    ``issues(number, fingerprint, title, exc_class, frames)``.  Matches, from
    strong to weak: same fingerprint; same class and five, four or three common
    top frames; same class and same message without its numbers.  The lowest
    issue number of the strongest match is taken; a class match alone creates.
    """
    noise = (
        (F.col("exc_class").isin(*NOISE_CLASSES) & (F.col("count") < NOISE_MAX_COUNT))
        | ~F.col("app_frames")
        | F.col("bot_4xx")
    )
    index = _match_keys(issues, "number").groupBy("key").agg(F.min("number").alias("number"))
    judged = errors.withColumn("ignored", noise)
    # Groups that look alike are searched once; a number stands for what they look like while their keys are joined.
    look = ["fingerprint", "title", "exc_class", "frames"]
    looks = cut_lineage(judged.filter("NOT ignored").select(*look).distinct().withColumn("no", F.monotonically_increasing_id()), "looks")
    hits = (
        _match_keys(looks, "no")
        .join(index, "key")
        .groupBy("no")
        .agg(F.max(F.struct("strength", (-F.col("number")).alias("neg"))).alias("hit"))
    )
    best = looks.join(hits, "no")
    side = best.select(*[F.col(c).alias(f"__{c}") for c in look], "hit")
    alike = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in look]
    return judged.join(side, alike, "left").select(
        "error_id",
        F.when(F.col("ignored"), "ignore").when(F.col("hit").isNotNull(), "duplicate").otherwise("create").alias("decision"),
        F.when(~F.col("ignored"), -F.col("hit.neg")).alias("duplicate_of"),
        F.when(~F.col("ignored"), F.col("hit.strength")).alias("strength"),
    )


def correlate_deploys(errors: DataFrame, deploys: DataFrame, minutes: int = DEPLOY_WINDOW_MINUTES) -> DataFrame:
    """Latest deploy of the service at most ``minutes`` before an error was first seen."""
    limit = minutes * 60_000_000
    points = deploys.select("service", micros("ts").alias("t"), F.lit(1).alias("n"))
    keyed = errors.withColumn("t", micros("ts"))
    last = probe_timeline(points, keyed.select("service", "t"), ["service"]).select("service", "t", "last_t")
    related = F.coalesce(F.col("t") - F.col("last_t") <= limit, F.lit(False))
    return (
        keyed.join(last, ["service", "t"], "left")
        .withColumn("deploy_related", related)
        .withColumn("deploy_ts", F.when(F.col("deploy_related"), F.timestamp_micros("last_t")))
        .withColumn("suggest_rollback", F.col("deploy_related") & F.col("priority").isin("p0", "p1"))
        .drop("t", "last_t")
    )


def verify_fixes(fixes: DataFrame, errors: DataFrame, minutes: int = FIX_WINDOW_MINUTES) -> DataFrame:
    """Per fix and reference: errors tagged with the reference after the deploy.

    ``fixes(pr, body, deployed_at)``, ``errors(ref, ts)`` with ``ref`` as text.
    """
    probes = (
        fixes.select("pr", micros("deployed_at").alias("from_us"), F.explode(fix_refs("body")).alias("ref"))
        .withColumn("upto_us", F.col("from_us") + minutes * 60_000_000)
    )
    points = errors.select("ref", micros("ts").alias("t"), F.lit(1).alias("n"))
    return (
        count_in_range(points, probes, ["ref"], "from_us", "upto_us", "events")
        .withColumn("status", F.when(F.col("events") == 0, "confirmed").otherwise("regressed"))
        .select("pr", "ref", "events", "status")
    )


def fix_verdicts(verified: DataFrame) -> DataFrame:
    """Comma lists of confirmed and regressed references per request, ``none`` when empty."""
    def listed(status: str) -> Column:
        refs = F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == status, F.col("ref")))), ",")
        return F.coalesce(F.nullif(refs, F.lit("")), F.lit("none")).alias(status)

    return verified.groupBy("pr").agg(listed("confirmed"), listed("regressed"))


def correlate_cves(findings: DataFrame, update_prs: DataFrame) -> DataFrame:
    """Open update request that names the package of a finding, else manual work.

    ``update_prs(repo, pr, title, state)``; without ``state`` all count as open.
    Titles are cut into words, so the containment test is an equi-join; each
    word keeps only its first request before the join.
    """
    words = F.explode(F.array_distinct(F.split(F.lower("title"), r"[^a-z0-9@/._-]+")))
    index = (
        open_only(update_prs)
        .select("repo", "pr", words.alias("package"))
        .filter("package <> ''")
        .groupBy("repo", "package")
        .agg(F.min("pr").alias("upgrade_pr"))
    )
    distinct = findings.groupBy("repo", "cve", "package").agg(F.count(F.lit(1)).alias("findings"))
    return distinct.join(index, ["repo", "package"], "left").withColumn(
        "advice",
        F.when(F.col("upgrade_pr").isNotNull(), F.concat(F.lit("upgrade PR #"), F.col("upgrade_pr"))).otherwise("manual"),
    )


# -- flags, environment, registries ---------------------------------------------------


def flag_lifecycle(code_flags: DataFrame, registry: DataFrame) -> DataFrame:
    """Lifecycle state and clean-up priority over both sides of the flag estate.

    ``code_flags(name, n_files)``,
    ``registry(name, status, rolled_out_pct, days_full, days_since_eval)``.
    """
    both = code_flags.select("name", "n_files").join(registry, "name", "full_outer")
    files = F.coalesce("n_files", F.lit(0)).cast("bigint")
    idle = lambda days: F.coalesce(F.col("days_since_eval"), F.lit(1 << 30)) >= days
    state = (
        F.when(F.col("n_files").isNull() | F.col("status").isNull(), "orphaned")
        .when((F.col("status") == "archived") & idle(30), "dead")
        .when((F.col("rolled_out_pct") == 100) & (F.col("days_full") > 30) & idle(7), "stale")
        .otherwise("active")
    )
    priority = (
        F.when((F.col("state") == "dead") & (F.col("n_files") > 5), "high")
        .when(F.col("state") == "stale", "medium")
        .when((F.col("state") == "orphaned") & (F.col("n_files") < 3), "low")
        .otherwise("none")
    )
    return (
        both.withColumn("state", state)
        .withColumn("n_files", files)
        .withColumn("priority", priority)
        .select("name", "n_files", "state", "priority")
    )


def missing_env(matrix: DataFrame, present: DataFrame) -> DataFrame:
    """Required (variable, environment) pairs that are not set; values are never read."""
    return matrix.join(present.select("var", "env").distinct(), ["var", "env"], "left_anti")


def undeclared_tasks(dispatches: DataFrame, registry: DataFrame, default_event: str = "agent-task") -> DataFrame:
    """Event type of each dispatched task; a task missing from the registry is an error."""
    known = registry.groupBy("name").agg(F.min("event_type").alias("__event")).withColumn("__known", F.lit(True))
    return (
        dispatches.join(known, dispatches["task"] == known["name"], "left")
        .withColumn("declared", F.col("__known").isNotNull())
        .withColumn(
            "event_type",
            F.when(F.col("declared"), F.coalesce(F.nullif("event_type", F.lit("")), "__event", F.lit(default_event))),
        )
        .drop("name", "__event", "__known")
    )


def merge_registries(entries: DataFrame, keep: str = "earliest") -> DataFrame:
    """One entry per name: the earliest source for registries, the latest for files.

    ``entries(name, source_order, payload)``.
    """
    pick = F.min if keep == "earliest" else F.max
    return (
        entries.groupBy("name")
        .agg(pick(F.struct("source_order", "payload")).alias("e"))
        .select("name", F.col("e.source_order").alias("source_order"), F.col("e.payload").alias("payload"))
    )


def concurrent_deploys(runs: DataFrame, keys: Sequence[str] = ("concurrency_group",)) -> DataFrame:
    """Other runs of the same workflow in progress when a run starts.

    Runs in progress at an instant are the starts up to it minus the ends up to
    it, so the interval self-join becomes two look-ups on one time line.
    ``runs(keys, run_id, started_at, ended_at)``, with positive durations.
    """
    keys = list(keys)
    timed = runs.withColumns({"t": micros("started_at"), "e": micros("ended_at")})
    points = timed.select(*keys, "t", F.lit(1).alias("n")).unionByName(
        timed.select(*keys, F.col("e").alias("t"), F.lit(-1).alias("n"))
    )
    live = probe_timeline(points, timed.select(*keys, "t"), keys, bucket_us=24 * HOUR_US).select(*keys, "t", "n_upto")
    return (
        timed.join(live, [*keys, "t"])
        .withColumn("others", F.col("n_upto") - 1)
        .withColumn("blocked", F.col("others") > 0)
        .drop("t", "e", "n_upto")
    )


def unrecorded_prs(prs: DataFrame, changelog_commits: DataFrame, limit: int = UNRECORDED_LIMIT) -> DataFrame:
    """Newest requests per repository merged strictly after its last changelog commit.

    The limit and the threshold follow the same order, so the newest requests
    are taken first and only those meet the changelog date.
    """
    last = changelog_commits.groupBy("repo").agg(F.max("ts").alias("__last"))
    newest = Window.partitionBy("repo").orderBy(F.desc("merged_at"), F.desc("pr"))
    return (
        prs.select("repo", "pr", "merged_at")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
        .join(last, "repo")
        .filter(F.col("merged_at") > F.col("__last"))
        .drop("__last")
    )


def nearest_ancestor_with(commits: DataFrame, limit: int = ANCESTOR_LIMIT) -> DataFrame:
    """Nearest first-parent ancestor that has the path, for every commit at once.

    ``commits(repo, sha, parent, has_path)``.  Distance 0 is the commit itself
    and ``limit - 1`` the furthest looked at.  The look-ahead doubles each
    round, so 20 steps take five joins on ``(repo, sha)``; lineage is cut once
    per round in the shared folder.
    """
    state = commits.select(
        "repo",
        "sha",
        F.when(F.col("has_path"), F.struct(F.lit(0).alias("distance"), F.col("sha").alias("found"))).alias("hit"),
        F.col("parent").alias("jump"),
    )
    reach = 1
    while reach < limit:
        ahead = state.select(
            "repo", F.col("sha").alias("jump"), F.col("hit").alias("far"), F.col("jump").alias("next_jump")
        )
        merged = state.join(ahead, ["repo", "jump"], "left").select(
            "repo",
            "sha",
            F.coalesce(
                "hit",
                F.when(
                    F.col("far").isNotNull(),
                    F.struct((F.col("far.distance") + reach).alias("distance"), F.col("far.found").alias("found")),
                ),
            ).alias("hit"),
            F.col("next_jump").alias("jump"),
        )
        reach *= 2
        state = cut_lineage(merged, "ancestors") if reach < limit else merged
    close = F.col("hit.distance") < limit
    return state.select(
        "repo",
        "sha",
        F.when(close, F.col("hit.found")).alias("ancestor"),
        F.when(close, F.col("hit.distance")).alias("distance"),
    )


# -- repeats ---------------------------------------------------------------------------


def suppress_repeats(actions: DataFrame, existing: DataFrame, hours: int = REPEAT_HOURS) -> DataFrame:
    """What to do with an action given what is already there.

    ``actions(action_id, kind, target, marker, at)``,
    ``existing(target, marker, is_open, at)``.  incident: skip when an open item
    has the marker; audit: skip when the target has any marker; ci_failure:
    comment when an open item got the marker in the last hours; sticky: update when
    the marker exists.
    """
    by_marker = existing.groupBy("target", "marker").agg(F.bool_or("is_open").alias("m_open"))
    by_target = existing.groupBy("target").agg(F.lit(True).alias("t_any"))
    keyed = actions.withColumn("t", micros("at"))
    points = existing.filter("is_open").select("target", "marker", micros("at").alias("t"), F.lit(1).alias("n"))
    ci = keyed.filter("kind = 'ci_failure'").select("target", "marker", "t")
    recent = probe_timeline(points, ci, ["target", "marker"]).select("target", "marker", "t", "last_t")
    seen = F.coalesce(F.col("t") - F.col("last_t") <= hours * HOUR_US, F.lit(False))
    decision = (
        F.when(F.col("kind") == "incident", F.when(F.col("m_open"), "skip").otherwise("create"))
        .when(F.col("kind") == "audit", F.when(F.col("t_any"), "skip").otherwise("create"))
        .when(F.col("kind") == "ci_failure", F.when(seen, "comment").otherwise("create"))
        .otherwise(F.when(F.col("m_open").isNotNull(), "update").otherwise("create"))
    )
    return (
        keyed.join(by_marker, ["target", "marker"], "left")
        .join(by_target, "target", "left")
        .join(recent, ["target", "marker", "t"], "left")
        .withColumn("decision", decision)
        .drop("t", "m_open", "t_any", "last_t")
    )
