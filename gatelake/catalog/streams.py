"""Streaming queries (everything available, then the landed table) and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelake.catalog.gates import SLOT_RATES, slot_rates
from gatelake.catalog.matching import as_sql
from gatelake.catalog.registry import query
from gatelake.catalog.text import COMMANDS
from gatelake.catalog.views import _TABLE, VIEWS, project, view
from gatelake.operators import gates
from gatelake.session import configure
from gatelake.streaming import late, queue_table
from gatelake.streaming import observation as o
from gatelake.streaming import queues as q
from gatelake.streaming import telemetry as t
from gatelake.streaming.runtime import in_turn, run_available, run_batches, run_timers, stream_parquet

NOW = "1998-01-01 00:00:00"


def stream_project(spark, sf, text):
    """A projection over the tables read as streams."""
    configure(spark)
    (name,) = set(_TABLE.findall(text))
    quoted = text.replace("{", "{{").replace("}", "}}").replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(quoted, **{name: stream_parquet(spark, f"{sf}/{name}*.parquet")})


def stream_view(spark, sf, name):
    return stream_project(spark, sf, VIEWS[name])


def stamp(*columns):
    return {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns}


RATE = """CASE WHEN total_events < 60 THEN 0.0 ELSE (error_events * 10000 // total_events) / 10000.0 END AS error_rate, CAST(0.2 AS DOUBLE) AS threshold,
    total_events < 60 OR error_events * 10000 // total_events <= 2000 AS passed"""


@query(
    "stream_error_rate",
    f"""
    WITH h AS (SELECT service, date_trunc('hour', ts) AS hr, count(*) AS n, sum(is_error) AS e FROM v_counts GROUP BY 1, 2),
    s AS (SELECT service, hr - INTERVAL (k) HOUR AS ws, n, e FROM h CROSS JOIN range(0, 24) r(k)),
    w AS (SELECT service, ws, CAST(sum(n) AS BIGINT) AS total_events, CAST(sum(e) AS BIGINT) AS error_events FROM s GROUP BY 1, 2)
    SELECT service, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
      total_events, error_events, {RATE} FROM w
    WHERE ws + INTERVAL 24 HOUR <= (SELECT max(ts) FROM v_counts) - INTERVAL 5 MINUTE""",
)
def stream_error_rate(spark, sf):
    verdicts = t.stream_error_rate(stream_view(spark, sf, "v_counts"), 0.1, 2.0, 60, "24 hours", "1 hour")
    return run_available(verdicts, "error-rate").withColumns(stamp("window_start", "window_end"))


@query(
    "reconciled_error_rate",
    f"""
    WITH w AS (SELECT service, date_trunc('day', ts) AS ws, count(*) AS total_events, CAST(sum(is_error) AS BIGINT) AS error_events FROM v_counts GROUP BY 1, 2)
    SELECT service, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, total_events, error_events, {RATE} FROM w""",
)
def reconciled_error_rate(spark, sf):
    """Three batches in no order of time: most rows come late, and are reconciled after the second and the last."""
    counts = view(spark, sf, "v_counts").withColumn("turn", F.timestamp_seconds(F.pmod(F.xxhash64("event_id"), F.lit(1000))))
    gate = {"baseline": 0.1, "multiplier": 2.0, "min_events": 60}

    def step(batch, batch_id, base, run):
        late.gate_batch(batch, batch_id, base, run, window_minutes=1440, **gate)
        if batch_id == 1:
            late.reconcile(batch.sparkSession, base, **gate)

    base = run_batches(in_turn(counts.select("service", "ts", "is_error", "turn"), "turn", 3, "shuffled"), "late", step)
    late.close(spark, base, 1440, **gate)
    late.reconcile(spark, base, **gate)
    return late.verdicts(spark, base).drop("version").withColumns(stamp("window_start"))


@query(
    "stream_canary",
    f"""
    WITH r AS ({SLOT_RATES}), x AS (SELECT *, lead(d) OVER (PARTITION BY service, slot ORDER BY d) AS nx FROM r),
    h AS (SELECT *, round(round(avg(rate) OVER w, 6) + 3 * round(coalesce(stddev_samp(rate) OVER w, 0), 6), 6) AS threshold FROM x
      WINDOW w AS (PARTITION BY service, slot ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    b AS (SELECT service, slot, threshold FROM h WHERE nx IS NULL)
    SELECT service, slot, strftime(d + INTERVAL (slot * 6) HOUR, '%Y-%m-%d %H:%M:%S') AS window_start, round(rate, 9) AS rate, threshold,
      coalesce(rate > threshold, false) AS regression FROM r LEFT JOIN b USING (service, slot)
    WHERE d + INTERVAL (slot * 6 + 6) HOUR <= (SELECT max(ts) FROM v_counts) - INTERVAL 5 MINUTE""",
)
def stream_canary(spark, sf):
    """The static side is the latest threshold of each service and slot."""
    history = gates.canary_3sigma(slot_rates(spark, sf))
    baseline = history.groupBy("service", "slot").agg(F.max(F.struct("day", "threshold"))["threshold"].alias("threshold"))
    windows = (
        t.interval_counts(stream_view(spark, sf, "v_counts"), "6 hours")
        .select("service", (F.col("e").cast("double") / F.col("n")).alias("rate"), F.date_trunc("hour", F.col("at") - F.expr("INTERVAL 5 HOURS")).alias("window_start"))
        .withColumn("slot", F.expr("hour(window_start) div 6"))
    )
    out = run_available(t.stream_canary(windows, baseline), "canary")
    return out.withColumns({**stamp("window_start"), "rate": F.round("rate", 9)})


QUEUE = """
    due AS (SELECT *, try_strptime(stg_deploy_time, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL (observation_minutes) MINUTE AS due FROM v_queue),
    newest AS (SELECT * FROM due QUALIFY row_number() OVER (PARTITION BY digest ORDER BY queued_at DESC, entry_id DESC) = 1)"""


@query("newest_per_digest", f"WITH {QUEUE} SELECT digest, entry_id, app, observation_minutes FROM newest")
def newest_per_digest(spark, sf):
    return q.newest_per_digest(view(spark, sf, "v_queue")).select("digest", "entry_id", "app", "observation_minutes")


@query(
    "split_due",
    f"""WITH {QUEUE} SELECT digest, entry_id, strftime(due, '%Y-%m-%dT%H:%M:%SZ') AS fire_at,
      CASE WHEN due IS NULL OR due <= TIMESTAMP '{NOW}' THEN 'due' ELSE 'pending' END AS status FROM newest""",
)
def split_due(spark, sf):
    queue = q.schedule(q.newest_per_digest(view(spark, sf, "v_queue")))
    return q.split_due(queue, NOW).select("digest", "entry_id", "fire_at", "status")


@query(
    "stream_dispatch",
    f"""WITH {QUEUE} SELECT digest AS key, strftime(due, '%Y-%m-%dT%H:%M:%SZ') AS fire_at, app AS payload,
      CASE WHEN due IS NULL THEN 'unparseable' ELSE 'due' END AS reason FROM newest""",
)
def stream_dispatch(spark, sf):
    """All entries of the table are due by now; the stream must fire each digest once."""
    entries = q.schedule(stream_view(spark, sf, "v_queue")).select(
        F.col("digest").alias("key"), "due", "fire_at", (F.col("queued_at").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,0,entry_id / 1000000)")).alias("queued_at"), F.col("app").alias("payload")
    )
    return run_timers(q.stream_delayed(entries), "dispatch").drop("queued_us")


@query("upsert_queue", f"WITH {QUEUE} SELECT digest, entry_id, app, observation_minutes FROM newest")
def upsert_queue(spark, sf):
    path = run_batches(stream_view(spark, sf, "v_queue"), "queue", q.upsert_queue)
    return q.read_queue(spark, path).select("digest", "entry_id", "app", "observation_minutes")


BEGINS, POLLS = ("1994-07-01", "1996-07-01"), ("1994-06-01", "1996-06-01", "1998-01-01")
LAST = "QUALIFY row_number() OVER (PARTITION BY digest ORDER BY queued_at DESC, entry_id DESC) = 1"


@query(
    "dispatch_queue",
    f"""
    WITH d AS (SELECT *, try_strptime(stg_deploy_time, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL (observation_minutes) MINUTE AS due FROM v_queue),
    l1 AS (SELECT * FROM d WHERE queued_at < DATE '{BEGINS[0]}' {LAST}),
    w1 AS (SELECT * FROM l1 WHERE due > DATE '{POLLS[0]}'),
    l2 AS (SELECT * FROM (FROM w1 UNION ALL SELECT * FROM d WHERE queued_at >= DATE '{BEGINS[0]}' AND queued_at < DATE '{BEGINS[1]}') {LAST}),
    w2 AS (SELECT * FROM l2 WHERE due > DATE '{POLLS[1]}'),
    l3 AS (SELECT * FROM (FROM w2 UNION ALL SELECT * FROM d WHERE queued_at >= DATE '{BEGINS[1]}') {LAST}),
    o AS (SELECT *, 'poll-0' AS poll FROM l1 WHERE due IS NULL OR due <= DATE '{POLLS[0]}'
      UNION ALL SELECT *, 'poll-1' FROM l2 WHERE due IS NULL OR due <= DATE '{POLLS[1]}'
      UNION ALL SELECT *, CASE WHEN due IS NULL OR due <= DATE '{POLLS[2]}' THEN 'poll-2' ELSE 'waiting' END FROM l3)
    SELECT digest, entry_id, app, strftime(due, '%Y-%m-%dT%H:%M:%SZ') AS fire_at, poll FROM o""",
)
def dispatch_queue(spark, sf):
    """Requests in three batches, each followed by a poll, a repeated batch and a compaction."""

    def step(batch, batch_id, base, run):
        queue_table.add_requests(batch, batch_id, base, run)
        queue_table.poll(batch.sparkSession, base, POLLS[batch_id], f"poll-{batch_id}")
        queue_table.add_requests(batch, batch_id, base, run)
        queue_table.compact(batch.sparkSession, base)

    requests = in_turn(view(spark, sf, "v_queue"), "queued_at", 3, "requests", BEGINS)
    base = run_batches(requests, "dispatch-queue", step)
    columns = ["digest", "entry_id", "app", "fire_at"]
    kept = queue_table.waiting(spark, base).select(*columns, F.lit("waiting").alias("poll"))
    return queue_table.fired(spark, base).select(*columns, "poll").union(kept)


FOLLOWUPS = """
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('<!-- agent-followup:{"due_at":"2024-01-', CASE conv_id % 2 WHEN 0 THEN '10' ELSE '20' END,
        'T00:00:00Z","reason":"check ', conv_id, '","task":"t', turn, '"} -->', chr(10), text)
      WHEN 1 THEN '<!-- agent-followup:{"due_at":"soon","reason":"x"} -->' ELSE text END AS body
    FROM {conversations}"""
FOLLOWUP_ROWS = """
    f AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'soon' ELSE concat('2024-01-', CASE conv_id % 2 WHEN 0 THEN '10' ELSE '20' END, 'T00:00:00Z') END AS due_at,
      CASE turn % 4 WHEN 0 THEN concat('check ', conv_id) ELSE 'x' END AS reason, CASE turn % 4 WHEN 0 THEN concat('t', turn) ELSE 'issue-followup' END AS task
      FROM conversations WHERE turn % 4 < 2)"""


@query(
    "due_followups",
    f"WITH {FOLLOWUP_ROWS} SELECT *, CASE WHEN turn % 4 = 1 OR conv_id % 2 = 0 THEN 'due' ELSE 'pending' END AS status FROM f",
)
def due_followups(spark, sf):
    markers = q.parse_followups(project(spark, sf, FOLLOWUPS))
    return q.due_followups(markers, "2024-01-15 00:00:00").drop("due")


@query(
    "stream_followups",
    f"""WITH {FOLLOWUP_ROWS}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
      SELECT CAST(conv_id AS VARCHAR) AS key, due_at AS fire_at, concat(task, ': ', reason) AS payload,
        CASE due_at WHEN 'soon' THEN 'unparseable' ELSE 'due' END AS reason FROM l""",
)
def stream_followups(spark, sf):
    """The newest marker of an issue replaces its earlier ones; all are due by now."""
    markers = q.parse_followups(stream_project(spark, sf, FOLLOWUPS))
    entries = markers.select(
        F.col("conv_id").cast("string").alias("key"), "due", F.col("due_at").alias("fire_at"), F.timestamp_seconds("turn").alias("queued_at"),
        F.concat("task", F.lit(": "), "reason").alias("payload"),
    )
    return run_timers(q.stream_delayed(entries), "followups").drop("queued_us")


@query(
    "stream_verify_fix",
    """
    WITH f AS (SELECT pr, deployed_at, unnest(list_distinct(regexp_extract_all(CASE WHEN body LIKE 'no %' THEN '' ELSE body END, '#([0-9]+)', 1))) AS ref
      FROM v_fix_deploys),
    e AS (SELECT event_id, CAST(ref AS VARCHAR) AS ref, ts FROM v_errors),
    hit AS (SELECT f.pr, f.ref, f.deployed_at, e.event_id FROM f JOIN e ON e.ref = f.ref AND e.ts > f.deployed_at AND e.ts <= f.deployed_at + INTERVAL 1 DAY),
    mark AS (SELECT least((SELECT max(deployed_at) FROM v_fix_deploys), (SELECT max(ts) FROM v_errors)) - INTERVAL 5 MINUTE AS wm)
    SELECT pr, ref, strftime(deployed_at, '%Y-%m-%d %H:%M:%S') AS deployed_at, event_id FROM (
      SELECT * FROM hit UNION ALL
      SELECT f.pr, f.ref, f.deployed_at, NULL FROM f ANTI JOIN hit ON hit.pr = f.pr AND hit.ref = f.ref AND hit.deployed_at = f.deployed_at
      WHERE f.deployed_at + INTERVAL 1 DAY < (SELECT wm FROM mark))""",
)
def stream_verify_fix(spark, sf):
    """Rows without an event appear once the watermark of both inputs has passed their window."""
    errors = stream_view(spark, sf, "v_errors").withColumn("ref", F.col("ref").cast("string"))
    out = run_available(t.stream_verify_fix(stream_view(spark, sf, "v_fix_deploys"), errors, "1 day"), "verify-fix")
    return out.withColumns(stamp("deployed_at"))


@query(
    "stream_commands",
    f"""
    WITH l AS (SELECT comment_id, author_assoc, regexp_extract(body, '(?m)^[ \\t\\r\\f\\v]*(/[a-z-][^\\n]*)', 1) AS line FROM v_comments),
    w AS (SELECT *, string_split(line, ' ')[1][2:] AS word FROM l)
    SELECT comment_id, CASE WHEN word IN ({COMMANDS}) THEN word ELSE 'none' END AS command,
      word IN ({COMMANDS}) AND (word = 'help' OR author_assoc IN ('OWNER', 'MEMBER', 'COLLABORATOR')) AS authorized FROM w""",
)
def stream_commands(spark, sf):
    """Every comment is delivered twice."""
    comments = stream_view(spark, sf, "v_comments").withColumn("ts", F.timestamp_seconds(F.col("comment_id") + 1_700_000_000))
    twice = comments.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    return run_available(t.stream_commands(twice), "commands").select("comment_id", "command", "authorized")


FAILURES = """
    SELECT concat('svc-', user_id % 5) AS target, concat('step-', event_id % 2) AS marker, ts AS at FROM {events} WHERE event_type = 'error'"""


@query(
    "stream_repeat_suppression",
    f"""
    WITH RECURSIVE a AS ({as_sql(FAILURES)}),
    f AS (SELECT DISTINCT target, marker, "at" AS t FROM a WHERE "at" <= (SELECT date_trunc('millisecond', max("at")) FROM a) - INTERVAL 5 MINUTE),
    r AS (SELECT target, marker, min(t) AS t FROM f GROUP BY target, marker
      UNION ALL SELECT r.target, r.marker, min(f.t) FROM r JOIN f ON f.target = r.target AND f.marker = r.marker AND f.t > r.t + INTERVAL 6 HOUR GROUP BY 1, 2)
    SELECT target, marker, strftime(t, '%Y-%m-%d %H:%M:%S') AS "at" FROM r""",
)
def stream_repeat_suppression(spark, sf):
    """Four files, one micro-batch each; runs that go on are reported every six hours."""
    failures = in_turn(project(spark, sf, FAILURES), "at", 4, "failures")
    return run_available(o.stream_repeat_suppression(failures), "repeats").withColumns(stamp("at"))


WATCHED = """
    WITH d AS (SELECT CAST(deploy_id AS VARCHAR) AS deploy_id, service, date_trunc('minute', ts + INTERVAL 1 MINUTE - INTERVAL 1 MICROSECOND) AS s FROM v_deploys),
    w AS (SELECT deploy_id, service, k AS window_no, s + INTERVAL ((k - 1) * 720) MINUTE AS a, s + INTERVAL (k * 720) MINUTE AS b FROM d CROSS JOIN range(1, 5) r(k)),
    c AS (SELECT w.deploy_id, w.service, window_no, a, b, count(v.event_id) AS n, CAST(coalesce(sum(v.is_error), 0) AS BIGINT) AS e
      FROM w LEFT JOIN v_counts v ON v.service = w.service AND v.ts >= a AND v.ts < b GROUP BY ALL),
    g AS (SELECT *, n >= 30 AND e * 10000 // greatest(n, 1) > 2000 AS failed FROM c),
    x AS (SELECT *, window_no - coalesce(max(CASE WHEN failed OR n < 30 THEN window_no END) OVER (PARTITION BY deploy_id ORDER BY window_no), 0) AS healthy FROM g),
    y AS (SELECT *, CASE WHEN failed THEN 'rollback' WHEN healthy >= 2 THEN 'promote' WHEN window_no = 4 THEN 'timeout' ELSE 'extend' END AS decision FROM x),
    z AS (SELECT *, min(CASE WHEN decision <> 'extend' THEN window_no END) OVER (PARTITION BY deploy_id) AS final FROM y)
    SELECT deploy_id, service, CAST(window_no AS INT) AS window_no, strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS window_end,
      n AS total_events, e AS error_events, decision FROM z WHERE window_no <= final"""
WATCH = {"baseline": 0.1, "multiplier": 2.0, "min_events": 30, "observe_minutes": 720}


@query("observe_deploys", WATCHED)
def observe_deploys(spark, sf):
    """Half a day after each deploy, and up to four such windows."""
    out = o.observe_deploys(view(spark, sf, "v_deploys"), view(spark, sf, "v_counts"), **WATCH)
    return out.withColumns(stamp("window_start", "window_end"))


@query(
    "stream_observe_deploys",
    WATCHED + """ AND b <= least((SELECT date_trunc('millisecond', max(ts)) FROM v_deploys), (SELECT date_trunc('millisecond', max(ts)) FROM v_counts)) - INTERVAL 5 MINUTE""",
)
def stream_observe_deploys(spark, sf):
    """Two streams of three files; rows appear when the watermark of both has passed their window."""
    deploys = in_turn(view(spark, sf, "v_deploys").select("deploy_id", "service", "ts"), "ts", 3, "deploys")
    counts = in_turn(view(spark, sf, "v_counts").select("service", "ts", "is_error"), "ts", 3, "counts")
    return run_available(o.stream_observe_deploys(deploys, counts, **WATCH), "observed").withColumns(stamp("window_start", "window_end"))


SESSIONS = f"""
    WITH m AS (SELECT service, date_trunc('minute', ts) AS mi, count(*) AS n, sum(is_error) AS e FROM v_counts GROUP BY 1, 2),
    g AS (SELECT *, CASE WHEN mi - lag(mi) OVER (PARTITION BY service ORDER BY mi) <= INTERVAL 40 MINUTE THEN 0 ELSE 1 END AS brk FROM m),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY service ORDER BY mi ROWS UNBOUNDED PRECEDING) AS grp FROM g),
    s AS (SELECT service, min(mi) AS f, max(mi) AS l, CAST(sum(n) AS BIGINT) AS total_events, CAST(sum(e) AS BIGINT) AS error_events FROM i GROUP BY service, grp),
    j AS (SELECT *, date_diff('minute', f, l) AS minutes, {RATE.replace("< 60", "< 10")} FROM s)"""
SESSION_ROW = """
    SELECT service, strftime(f, '%Y-%m-%d %H:%M') AS first_at, minutes, total_events, error_events, error_rate, passed,
      CASE WHEN NOT passed THEN 'rollback' WHEN minutes >= 30 THEN 'promote' ELSE 'extend' END AS decision FROM j"""


def session_rows(out):
    out = out.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm"))
    return out.select("service", "first_at", "minutes", "total_events", "error_events", "error_rate", "passed", "decision")


@query("observe_sessions", SESSIONS + SESSION_ROW)
def observe_sessions(spark, sf):
    return session_rows(t.observe_sessions(view(spark, sf, "v_counts"), 0.1, 2.0, 10, "40 minutes"))


@query(
    "stream_observe_sessions",
    SESSIONS + SESSION_ROW + " WHERE l + INTERVAL 41 MINUTE <= (SELECT max(ts) FROM v_counts) - INTERVAL 5 MINUTE",
)
def stream_observe_sessions(spark, sf):
    decided = t.observe_sessions(stream_view(spark, sf, "v_counts"), 0.1, 2.0, 10, "40 minutes")
    return session_rows(run_available(decided, "sessions"))


ITEMS = """
    SELECT o_orderkey AS item_id, CASE o_orderkey % 2 WHEN 0 THEN 'issue' ELSE 'pr' END AS kind,
      CASE o_orderkey % 5 WHEN 0 THEN 'closed' ELSE 'open' END AS state, o_orderdate AS last_activity,
      CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 30 DAY WHEN 1 THEN o_orderdate - INTERVAL 3 DAY END AS stale_since,
      CASE o_orderkey % 5 WHEN 0 THEN o_orderdate + INTERVAL 10 DAY END AS closed_at
    FROM {orders}"""


@query(
    "stale_sweep",
    f"""
    WITH i AS ({as_sql(ITEMS)}), a AS (SELECT *, date_diff('day', closed_at, TIMESTAMP '{NOW}') AS c, date_diff('day', stale_since, TIMESTAMP '{NOW}') AS s,
        date_diff('day', last_activity, TIMESTAMP '{NOW}') AS l FROM i)
    SELECT item_id, kind, CASE WHEN state = 'closed' THEN CASE WHEN c >= 30 THEN 'lock' ELSE 'none' END
      WHEN stale_since IS NOT NULL AND last_activity <= stale_since THEN CASE WHEN s >= CASE kind WHEN 'issue' THEN 14 ELSE 7 END THEN 'close' ELSE 'none' END
      WHEN l >= CASE kind WHEN 'issue' THEN 60 ELSE 30 END THEN 'mark-stale' ELSE 'none' END AS action FROM a""",
)
def stale_sweep(spark, sf):
    return q.stale_sweep(project(spark, sf, ITEMS), NOW).select("item_id", "kind", "action")
