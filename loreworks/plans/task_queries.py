"""Registered queries: task graphs."""

from pyspark.sql import functions as F

from loreworks.operators import taskgraph as tg
from loreworks.plans.event_queries import js
from loreworks.plans.project_queries import TERMINAL
from loreworks.plans.registry import query

BAD = "('failed','timeout','skipped','cancelled')"


@query(
    "t01_graph_problems", "planned faulty_edges agents role_table projects",
    """
WITH e AS (SELECT root_id AS graph, task, dep FROM faulty_edges),
h AS (SELECT DISTINCT role FROM agents),
j AS (SELECT p.*, r.role IS NOT NULL AS known, coalesce(r.deterministic, false) AS det, h.role IS NOT NULL AS held,
  x.name IS NOT NULL AS pk, g.agent IS NOT NULL AS hk FROM planned p LEFT JOIN role_table r ON r.role = p.role LEFT JOIN h ON h.role = p.role
  LEFT JOIN projects x ON x.name = p.project LEFT JOIN (SELECT DISTINCT agent FROM agents) g ON g.agent = p.hint)
SELECT c_custkey AS graph, CAST(NULL AS BIGINT) AS task, 'empty' AS problem FROM customer WHERE c_custkey NOT IN (SELECT graph FROM planned)
UNION ALL SELECT graph, task, 'duplicate id' FROM planned GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT graph, NULL, 'too large' FROM planned GROUP BY 1 HAVING count(*) > 12
UNION ALL SELECT DISTINCT graph, task, 'unknown dependency' FROM e WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.graph = e.graph AND p.task = e.dep)
UNION ALL SELECT DISTINCT graph, task, 'depends on itself' FROM e WHERE task = dep
UNION ALL SELECT graph, NULL, 'several roots' FROM planned GROUP BY 1 HAVING count(DISTINCT root) > 1
UNION ALL SELECT DISTINCT graph, task, 'unknown role' FROM j WHERE NOT known
UNION ALL SELECT DISTINCT graph, task, 'deterministic role needs a verdict' FROM j WHERE known AND det AND outcome <> 'verdict'
UNION ALL SELECT DISTINCT graph, task, 'role without holder' FROM j WHERE known AND NOT det AND NOT held
UNION ALL SELECT DISTINCT graph, task, 'unknown project' FROM j WHERE project IS NOT NULL AND NOT pk
UNION ALL SELECT DISTINCT graph, task, 'unknown agent hint' FROM j WHERE hint IS NOT NULL AND NOT hk
UNION ALL SELECT DISTINCT graph, task, 'diff without acceptance' FROM j WHERE outcome = 'diff' AND acceptance = 0""",
)
def _(t):
    return tg.graph_problems(
        t("customer").select(F.col("c_custkey").alias("graph")),
        t("planned"),
        t("faulty_edges").withColumnRenamed("root_id", "graph"),
        t("role_table"),
        t("agents").select("role"),
        t("projects").select(F.col("name").alias("project")),
        t("agents").select("agent"),
    )


CYCLES = """
WITH RECURSIVE e AS (SELECT DISTINCT root_id, task, dep FROM faulty_edges),
reach(root_id, a, b) AS (SELECT root_id, task, dep FROM e UNION SELECT r.root_id, r.a, e.dep FROM reach r JOIN e ON e.root_id = r.root_id AND e.task = r.b),
core AS (SELECT DISTINCT root_id, a AS n FROM reach WHERE (root_id, b) IN (SELECT root_id, a FROM reach WHERE a = b)
  UNION SELECT root_id, a FROM reach WHERE a = b),
f AS (SELECT e.root_id, e.task AS n, min(e.dep) AS nxt FROM e JOIN core c ON c.root_id = e.root_id AND c.n = e.task
  JOIN core d ON d.root_id = e.root_id AND d.n = e.dep GROUP BY 1, 2),
walk(root_id, start, path, nxt) AS (SELECT root_id, n, [n], nxt FROM f
  UNION ALL SELECT w.root_id, w.start, list_append(w.path, w.nxt), f.nxt FROM walk w JOIN f ON f.root_id = w.root_id AND f.n = w.nxt WHERE NOT list_contains(w.path, w.nxt)),
rings AS (SELECT root_id, start, list_append(path, nxt) AS path FROM walk WHERE nxt = start AND start = list_min(path))
SELECT root_id, array_to_string(arg_min(path, start), ' → ') AS path FROM rings GROUP BY 1"""


def _cycle_text(df):
    return df.select("root_id", F.array_join(F.col("path").cast("array<string>"), " → ").alias("path"))


@query("t02_find_cycles", "faulty_edges", CYCLES)
def _(t):
    return _cycle_text(tg.find_cycles(t("faulty_edges")))


@query(
    "t03_ready", "tasks task_edges",
    """
SELECT root_id, id FROM tasks t WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM task_edges e JOIN tasks d ON d.id = e.dep AND d.root_id = e.root_id
  WHERE e.task = t.id AND e.root_id = t.root_id AND d.status <> 'succeeded')""",
)
def _(t):
    return tg.ready(t("tasks"), t("task_edges"))


@query(
    "t04_blocked", "tasks task_edges",
    f"""
SELECT root_id, id FROM tasks t WHERE status = 'pending' AND EXISTS (SELECT 1 FROM task_edges e JOIN tasks d ON d.id = e.dep AND d.root_id = e.root_id
  WHERE e.task = t.id AND e.root_id = t.root_id AND d.status IN {BAD})""",
)
def _(t):
    return tg.blocked(t("tasks"), t("task_edges"))


@query(
    "t04_skip_cascade", "tasks task_edges",
    f"""
WITH RECURSIVE s(root_id, id) AS (
  SELECT t.root_id, t.id FROM tasks t JOIN task_edges e ON e.task = t.id AND e.root_id = t.root_id JOIN tasks d ON d.id = e.dep AND d.root_id = e.root_id
    WHERE t.status = 'pending' AND d.status IN {BAD}
  UNION SELECT t.root_id, t.id FROM s JOIN task_edges e ON e.dep = s.id AND e.root_id = s.root_id JOIN tasks t ON t.id = e.task AND t.root_id = e.root_id WHERE t.status = 'pending')
SELECT root_id, id FROM s""",
)
def _(t):
    return tg.skip_cascade(t("tasks"), t("task_edges")).select("root_id", "id")


@query(
    "t05_dependents", "task_edges",
    "SELECT root_id, dep AS id, count(DISTINCT task) AS dependents FROM task_edges GROUP BY 1, 2",
)
def _(t):
    return tg.dependents(t("task_edges"))


@query(
    "t05_root_progress", "tasks",
    f"""SELECT root_id, count(*) AS tasks, count(*) FILTER (status NOT IN {TERMINAL}) AS active,
  count(*) FILTER (status NOT IN {TERMINAL}) = 0 AS done FROM tasks GROUP BY 1""",
)
def _(t):
    return tg.root_progress(t("tasks"))


RANKED = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(tg.AGGREGATE_ORDER)) + " END"
ROOT_STATUS = f"SELECT root_id, arg_min(status, {RANKED}) AS status FROM tasks GROUP BY 1"


@query("t06_root_status", "tasks", ROOT_STATUS)
def _(t):
    return tg.root_status(t("tasks"))


RANKS = """WITH RECURSIVE r(root_id, id, c) AS (SELECT root_id, id, 0 FROM tasks
  UNION SELECT e.root_id, e.task, r.c + 1 FROM r JOIN task_edges e ON e.root_id = r.root_id AND e.dep = r.id),
ranks AS (SELECT root_id, id, CAST(max(c) AS BIGINT) AS "column" FROM r GROUP BY 1, 2)"""


@query("t07_longest_path_rank", "tasks task_edges", f"{RANKS} SELECT * FROM ranks")
def _(t):
    return tg.longest_path_rank(t("tasks"), t("task_edges"))


@query(
    "t07_graph_shape", "tasks task_edges",
    f"""{RANKS}, per AS (SELECT root_id, "column" AS c, count(*) AS n FROM ranks GROUP BY 1, 2)
SELECT root_id, max(c) + 1 AS depth, max(n) AS width FROM per GROUP BY 1""",
)
def _(t):
    return tg.graph_shape(tg.longest_path_rank(t("tasks"), t("task_edges")))


@query(
    "t08_replan_eligibility", "tasks",
    f"""
WITH u AS (SELECT root_id, count(DISTINCT supersedes) AS used FROM tasks GROUP BY 1),
r AS (SELECT t.root_id, id, CASE WHEN status NOT IN ('failed','timeout') THEN 'not a failure' WHEN kind = 'planning' THEN 'planning is not replanned'
  WHEN {js('error.kind', 'result')} IN ('denied','refused','expired','halted','cancelled','approval_required','approval_invalid','interrupted') THEN 'a decision'
  WHEN id IN (SELECT supersedes FROM tasks WHERE supersedes IS NOT NULL) THEN 'already replanned' WHEN used >= 2 THEN 'budget spent' END AS reason FROM tasks t JOIN u USING (root_id))
SELECT root_id, id, reason IS NULL AS eligible, reason FROM r""",
)
def _(t):
    return tg.replan_eligibility(t("tasks"))


@query(
    "t09_attempts_report", "tasks",
    f"""
SELECT root_id, count(DISTINCT supersedes) AS replans_used, count(*) FILTER (status IN ('failed','timeout')) AS failures,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (coalesce({js('evidence.branch', 'result')}, '') <> '') AS partials FROM tasks GROUP BY 1""",
)
def _(t):
    return tg.attempts_report(t("tasks"))


@query(
    "t09_attempts_detail", "tasks",
    f"""
SELECT root_id, id, 'attempt' AS part, coalesce({js('error.message', 'result')}, {js('summary', 'result')}, '') AS text FROM tasks WHERE status IN ('failed','timeout')
UNION ALL SELECT root_id, id, 'skipped', '' FROM tasks WHERE status = 'skipped'
UNION ALL SELECT root_id, id, 'partial', {js('evidence.branch', 'result')} FROM tasks WHERE coalesce({js('evidence.branch', 'result')}, '') <> ''""",
)
def _(t):
    return tg.attempts_detail(t("tasks"))


@query(
    "t10_recovery_view", "tasks",
    f"""
SELECT root_id, id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'interrupted' END AS error_kind,
  CASE WHEN status = 'running' THEN started_at END AS interrupted_at FROM tasks WHERE status NOT IN {TERMINAL}""",
)
def _(t):
    return tg.recovery_view(t("tasks"))


@query(
    "t11_overdue", "tasks",
    """
WITH c AS (SELECT id, started_at, CAST(CASE kind WHEN 'tool' THEN 120 WHEN 'verify' THEN 900 WHEN 'report' THEN 120 WHEN 'planning' THEN 600 ELSE 3600 END AS DOUBLE) AS ceiling
  FROM tasks WHERE status = 'running')
SELECT id, ceiling, coalesce(date_diff('second', try_cast(started_at AS TIMESTAMPTZ), TIMESTAMPTZ '1997-01-01T00:00:00Z') > ceiling, false) AS overdue FROM c""",
)
def _(t):
    return tg.overdue(t("tasks"), F.to_timestamp(F.lit("1997-01-01T00:00:00Z")))


@query(
    "t12_rank_executors", "agents role_table",
    """
WITH d AS (SELECT role, max(agent) AS d FROM agents WHERE role <> 'coder' GROUP BY 1),
a AS (SELECT a.role, a.agent, row_number() OVER (PARTITION BY a.role ORDER BY coalesce(a.agent = d.d, false) DESC,
  CASE cost WHEN 'free' THEN 0 WHEN 'subscription' THEN 1 WHEN 'quota' THEN 2 WHEN 'metered' THEN 3 ELSE 9 END, a.agent) AS rank
  FROM agents a JOIN role_table r ON r.role = a.role LEFT JOIN d ON d.role = a.role WHERE NOT (r.outcome = 'diff' AND a.read_only))
SELECT * FROM a""",
)
def _(t):
    stated = t("agents").where("role <> 'coder'").groupBy("role").agg(F.max("agent").alias("agent"))
    return tg.rank_executors(t("role_table"), t("agents"), stated)


@query(
    "t13_overridden_hints", "planned agents",
    """
SELECT task, p.role, hint AS hinted, chosen, CASE WHEN a.agent IS NULL THEN 'not a registered agent' WHEN a.role <> p.role THEN 'does not hold the role'
  WHEN a.read_only THEN 'read-only' WHEN a.locality = 'local' AND kind IS NOT NULL THEN 'a local model' ELSE 'not honoured' END AS reason
FROM planned p LEFT JOIN agents a ON a.agent = p.hint WHERE hint IS NOT NULL AND hint IS DISTINCT FROM chosen""",
)
def _(t):
    return tg.overridden_hints(t("planned"), t("agents"))


@query(
    "t14_task_tree", "tasks",
    f"SELECT t.root_id, id, t.status, created_at, r.status AS root_status FROM tasks t JOIN ({ROOT_STATUS}) r USING (root_id)",
)
def _(t):
    return tg.task_tree(t("tasks"))


EVIDENCE = " UNION ALL ".join(
    f"SELECT id, '{k}' AS key, {js('evidence.' + k, 'result')} AS value FROM tasks" for k in tg.REPORTED
)


@query(
    "t15_evidence_report", "tasks task_edges",
    f"""
WITH ev AS (SELECT * FROM ({EVIDENCE}) x WHERE value IS NOT NULL)
SELECT e.task, e.dep, d.status AS dep_status, coalesce({js('summary', 'd.result')}, '') AS summary, ev.key, ev.value
FROM task_edges e JOIN tasks t ON t.id = e.task AND t.kind = 'report' JOIN tasks d ON d.id = e.dep LEFT JOIN ev ON ev.id = d.id""",
)
def _(t):
    return tg.evidence_report(t("tasks"), t("task_edges"))
