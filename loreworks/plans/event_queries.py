"""Registered queries: the event log."""

from pyspark.sql import functions as F

from loreworks.operators import events as ev
from loreworks.operators import redaction as rd
from loreworks.plans.registry import query


def js(path: str, col: str = "payload") -> str:
    """Tolerant JSON text extraction for the twins."""
    return f"CASE WHEN json_valid({col}) THEN json_extract_string({col}, '$.{path}') END"


CRITICAL = ", ".join(f"'{x}'" for x in ev.CRITICAL_TYPES)
OTHER = ", ".join(f"'{x}'" for x in ev.OTHER_KNOWN_TYPES)


@query("l01_resume", "log", "SELECT seq, type FROM log WHERE seq > 100")
def _(t):
    twice = t("log").unionByName(t("log"))
    return ev.resume(twice, 100).select("seq", "type")


@query(
    "l02_resync", "log",
    """
WITH h AS (SELECT max(seq) AS head FROM log), c AS (SELECT c_custkey AS client, c_custkey * 10 AS since FROM customer),
x AS (SELECT client, since, head, greatest(0, head - 1000) AS f FROM c, h)
SELECT client, since > head OR (since > 0 AND since < f) AS resync,
  CASE WHEN since > head THEN 'ahead' WHEN since > 0 AND since < f THEN 'stale' END AS reason,
  CASE WHEN since > 0 AND since < f THEN f WHEN since > head THEN head ELSE since END AS baseline FROM x""",
)
def _(t):
    cursors = t("customer").select(F.col("c_custkey").alias("client"), (F.col("c_custkey") * 10).alias("since"))
    return ev.resync(cursors, t("log"), 1000)


@query(
    "l03_sequence_gaps", "log",
    """
SELECT prev + 1 AS expected, seq AS got FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS prev FROM log WHERE type <> 'error') x
WHERE seq <> prev + 1""",
)
def _(t):
    return ev.sequence_gaps(t("log").where("type <> 'error'"), segment=1000)


@query(
    "l04_classify_events", "log",
    f"""
SELECT type, type IN ({CRITICAL}) OR type IN ({OTHER}) AS known, type IN ({CRITICAL}) AS critical, count(*) AS n
FROM log GROUP BY 1, 2, 3""",
)
def _(t):
    return ev.classify_events(t("log")).groupBy("type", "known", "critical").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l05_session_page", "log",
    "SELECT seq, type FROM (SELECT * FROM log WHERE seq > 50 ORDER BY seq LIMIT 5000) p WHERE session_id = 's8'",
)
def _(t):
    return ev.session_page(t("log"), "s8", 50, 5000).select("seq", "type")


@query(
    "l05_session_page_filtered", "log",
    "SELECT seq, type FROM log WHERE session_id = 's8' AND seq > 50 ORDER BY seq LIMIT 20",
)
def _(t):
    return ev.session_page(t("log"), "s8", 50, 20, limit_first=False).select("seq", "type")


@query(
    "l06_recent_sessions", "log",
    """
SELECT session_id, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM log
GROUP BY 1 ORDER BY last_seq DESC, session_id LIMIT 50""",
)
def _(t):
    return ev.recent_sessions(ev.sessions_of(t("log")), 50)


HISTORY = """r AS (SELECT session_id, seq, CASE WHEN type = 'turn.started' THEN 'me: ' ELSE 'you: ' END || coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM src WHERE type IN ('turn.started', 'message.completed')),
k AS (SELECT * FROM r WHERE rn <= 6)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS line_no, text FROM k"""


@query(
    "l07_recent_history", "log",
    f"WITH src AS (SELECT session_id, seq, type, {js('text')} AS text FROM log WHERE seq > (SELECT max(seq) FROM log) - 200), {HISTORY}",
)
def _(t):
    return ev.recent_history(t("log").withColumn("text", ev.field("text")))


@query("l07_chat_history", "chat", f"WITH src AS (SELECT * FROM chat), {HISTORY}")
def _(t):
    return ev.recent_history(t("chat"), scan=None)


@query(
    "l08_timeline_groups", "log",
    f"""
WITH k AS (SELECT seq, CASE WHEN turn_id IS NOT NULL THEN 'turn:' || turn_id WHEN task_id IS NOT NULL THEN 'task:' || task_id ELSE 'system' END AS key,
  CASE WHEN type = 'turn.started' THEN {js('text')} END AS said FROM log),
c AS (SELECT *, lag(key) OVER (ORDER BY seq) AS before FROM k),
g AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM key THEN 0 ELSE 1 END) OVER (ORDER BY seq) AS grp FROM c),
a AS (SELECT grp, min(seq) AS first_seq, any_value(key) AS key, count(*) AS n, arg_min(said, seq) FILTER (said IS NOT NULL) AS said FROM g GROUP BY 1)
SELECT first_seq, split_part(key, ':', 1) AS kind, CASE WHEN key <> 'system' THEN substring(key, 6) END AS ref,
  CASE WHEN key LIKE 'turn:%' THEN CASE WHEN coalesce(said, '') <> '' THEN said ELSE 'turn ' || substring(key, 6) END
       WHEN key LIKE 'task:%' THEN 'task ' || substring(key, 6) ELSE 'system' END AS label, n FROM a""",
)
def _(t):
    return ev.timeline_groups(t("log"), segment=777)


@query(
    "l09_filter_timeline", "log",
    """
SELECT seq, type FROM log WHERE contains(lower(type || ' ' || coalesce(trace_id, '') || ' ' || coalesce(turn_id, '') || ' ' ||
  coalesce(task_id, '') || ' ' || payload), 'tr7')""",
)
def _(t):
    return ev.filter_timeline(t("log"), " TR7 ").select("seq", "type")


@query(
    "l10_fold_turns", "log",
    f"""
WITH e AS (SELECT seq, turn_id, session_id, type, {js('text')} AS text, {js('outcome')} AS outcome FROM log
  WHERE turn_id IS NOT NULL AND type IN ('turn.started', 'message.delta', 'message.completed', 'turn.finished')),
s AS (SELECT turn_id, min(seq) AS start, arg_min(session_id, seq) AS session_id, arg_min(text, seq) AS user_text FROM e WHERE type = 'turn.started' GROUP BY 1),
l AS (SELECT e.* FROM e JOIN s ON s.turn_id = e.turn_id AND e.seq > s.start),
c AS (SELECT turn_id, max(seq) AS at, arg_max(text, seq) AS text FROM l WHERE type = 'message.completed' AND text IS NOT NULL GROUP BY 1),
d AS (SELECT l.turn_id, string_agg(l.text, '' ORDER BY l.seq) AS tail FROM l LEFT JOIN c USING (turn_id)
  WHERE l.type = 'message.delta' AND l.text IS NOT NULL AND (c.at IS NULL OR l.seq > c.at) GROUP BY 1),
f AS (SELECT turn_id, true AS done, arg_max(coalesce(outcome, 'completed'), seq) AS outcome FROM l WHERE type = 'turn.finished' GROUP BY 1)
SELECT s.turn_id, s.session_id, coalesce(user_text, '') AS user_text, coalesce(c.text, '') || coalesce(tail, '') AS reply,
  coalesce(done, false) AS done, outcome FROM s LEFT JOIN c USING (turn_id) LEFT JOIN d USING (turn_id) LEFT JOIN f USING (turn_id)""",
)
def _(t):
    return ev.fold_turns(t("log"))


#: Twin of L-11 on tables and on streams.
CALL_PAIRS = f"""
WITH c AS (SELECT seq, turn_id, {js('tool')} AS tool, CASE WHEN type = 'tool.started' THEN 1 ELSE -1 END AS step,
  coalesce({js('ok')}, 'false') = 'true' AS ok FROM log WHERE type IN ('tool.started', 'tool.finished') AND turn_id IS NOT NULL),
s AS (SELECT *, sum(step) OVER (PARTITION BY turn_id, tool ORDER BY seq) AS s FROM c),
m AS (SELECT *, coalesce(min(s) OVER (PARTITION BY turn_id, tool ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was,
  min(s) OVER (PARTITION BY turn_id, tool ORDER BY seq) AS low FROM s),
v AS (SELECT *, s - least(low, 0) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS lvl FROM m WHERE NOT (step < 0 AND s < least(was, 0))),
p AS (SELECT *, lag(seq) OVER (PARTITION BY turn_id, tool, lvl ORDER BY seq) AS opened FROM v)
SELECT b.turn_id, b.tool, b.seq AS start_seq, e.seq AS finish_seq, e.ok FROM p b
LEFT JOIN p e ON e.step < 0 AND e.opened = b.seq WHERE b.step > 0"""


@query("l11_pair_tool_calls", "log", CALL_PAIRS)
def _(t):
    return ev.pair_tool_calls(t("log"), segment=500)


@query(
    "l12_project_tasks", "log",
    f"""
WITH e AS (SELECT * FROM (SELECT seq, task_id, type, {js('source')} AS source, {js('root_id')} AS root_id, {js('kind')} AS kind, {js('status')} AS status
  FROM log WHERE type IN ('task.created', 'task.updated', 'task.finished') AND task_id IS NOT NULL) x WHERE source = 'graph' AND root_id IS NOT NULL),
c AS (SELECT root_id, task_id, min(seq) AS created_seq, arg_min(kind, seq) AS kind FROM e WHERE type = 'task.created' GROUP BY 1, 2),
l AS (SELECT e.root_id, e.task_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, max(seq) AS last_seq FROM e JOIN c
  ON c.root_id = e.root_id AND c.task_id = e.task_id AND e.seq > c.created_seq WHERE type <> 'task.created' GROUP BY 1, 2)
SELECT root_id, task_id, coalesce(kind, '') AS kind, coalesce(status, 'pending') AS status, created_seq, coalesce(last_seq, created_seq) AS last_seq
FROM c LEFT JOIN l USING (root_id, task_id)""",
)
def _(t):
    return ev.project_tasks(t("log"))


@query(
    "l13_pending_approvals", "log",
    f"""
WITH b AS (SELECT coalesce(max(seq), 0) AS boot FROM log WHERE type = 'system.boot'),
q AS (SELECT {js('approval_id')} AS approval_id, seq, ts, CAST({js('expires_in_s')} AS DOUBLE) AS ttl, {js('waits')} AS waits FROM log WHERE type = 'approval.requested'),
r AS (SELECT {js('approval_id')} AS approval_id, max(seq) AS done_at FROM log WHERE type = 'approval.resolved' GROUP BY 1)
SELECT q.approval_id, min(seq) AS seq FROM q CROSS JOIN b LEFT JOIN r ON r.approval_id = q.approval_id
WHERE q.approval_id IS NOT NULL AND seq > boot AND (coalesce(waits, 'false') = 'true' OR epoch_us(ts) / 1e6 + coalesce(ttl, 0) > epoch_us(TIMESTAMP '2024-01-20 00:00:00') / 1e6)
  AND (done_at IS NULL OR done_at < seq) GROUP BY 1""",
)
def _(t):
    return ev.pending_approvals(t("log"), F.to_timestamp(F.lit("2024-01-20T00:00:00Z")))


@query(
    "l14_merge_health", "log probes",
    f"""
WITH live AS (SELECT component, arg_max(reason, seq) AS reason FROM (SELECT seq, coalesce({js('component')}, 'reasoning') AS component, {js('reason')} AS reason
  FROM log WHERE type = 'system.degraded') x GROUP BY 1)
SELECT component, reason, 'live' AS origin FROM live
UNION ALL SELECT component, detail, 'probe' FROM probes WHERE (NOT ok OR unknown) AND component NOT IN (SELECT component FROM live)""",
)
def _(t):
    return ev.merge_health(t("probes"), ev.live_degradations(t("log")))


@query("l15_redact_payloads")
def _(t):
    return rd.redact_payloads(t("log")).select("seq", "payload")


@query(
    "g13_retrieval_traces", "log",
    """
SELECT seq, tool, array_to_string(list_sort(list_distinct(list_transform(from_json(payload->'citations',
    '[{"collection":"VARCHAR","path":"VARCHAR"}]'), lambda c: c.collection || '/' || c.path))), ' ') AS documents
FROM (SELECT seq, payload, json_extract_string(payload, '$.tool') AS tool FROM log WHERE type = 'tool.finished' AND json_valid(payload)) x
WHERE json_array_length(payload, '$.citations') > 0""",
)
def _(t):
    return ev.retrieval_traces(t("log")).select(
        "seq", "tool", F.array_join(F.array_sort("documents"), " ").alias("documents")
    )
