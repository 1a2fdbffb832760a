"""Registered queries: facts and attempts."""

from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators import memory as mem
from loreworks.plans.event_queries import js
from loreworks.plans.registry import query

REASON = """CASE WHEN tainted THEN 'tainted' WHEN plan_active THEN 'plan active' WHEN source IN ('user_stated','user_corrected') THEN 'owner said so'
  WHEN source = 'observed' AND observations >= 2 THEN 'observed often enough' WHEN source = 'observed' THEN 'observed too rarely'
  WHEN user_approved THEN 'owner approved' ELSE 'inferred' END"""
ADMITTED = f"""adm AS (SELECT *, CASE source WHEN 'user_corrected' THEN 4 WHEN 'user_stated' THEN 3 WHEN 'observed' THEN 2 ELSE 1 END AS auth,
  row_number() OVER (PARTITION BY key, scope, scope_ref ORDER BY seq) AS rn FROM fact_writes
  WHERE {REASON} IN ('owner said so', 'observed often enough', 'owner approved'))"""
FOLD = f"""WITH RECURSIVE {ADMITTED},
walk(key, scope, scope_ref, rn, seq, outcome, held, hv, ha, hf) AS (
  SELECT key, scope, scope_ref, rn, seq, 'new', CAST(NULL AS VARCHAR), value, auth, fact_id FROM adm WHERE rn = 1
  UNION ALL
  SELECT a.key, a.scope, a.scope_ref, a.rn, a.seq, CASE WHEN a.value = w.hv THEN 'confirmed' WHEN a.auth >= w.ha THEN 'superseded' ELSE 'contradicted' END, w.hf,
    CASE WHEN a.value <> w.hv AND a.auth >= w.ha THEN a.value ELSE w.hv END, CASE WHEN a.value <> w.hv AND a.auth >= w.ha THEN a.auth ELSE w.ha END,
    CASE WHEN a.value <> w.hv AND a.auth >= w.ha THEN a.fact_id ELSE w.hf END
  FROM walk w JOIN adm a ON a.key = w.key AND a.scope = w.scope AND a.scope_ref IS NOT DISTINCT FROM w.scope_ref AND a.rn = w.rn + 1),
judged AS (SELECT a.*, w.outcome, w.held FROM adm a JOIN walk w USING (seq)),
touch AS (SELECT CASE WHEN outcome = 'confirmed' THEN held WHEN outcome <> 'contradicted' THEN fact_id END AS fact_id, confidence, seq, at FROM judged),
kept AS (SELECT fact_id, max(confidence) AS confidence, arg_max(at, seq) AS last_confirmed_at FROM touch WHERE fact_id IS NOT NULL GROUP BY 1),
facts AS (SELECT j.fact_id, key, scope, scope_ref, kind, value, source, at AS created_at, k.confidence, k.last_confirmed_at, s.superseded_by
  FROM (SELECT * EXCLUDE (confidence) FROM judged WHERE outcome IN ('new','superseded')) j JOIN kept k ON k.fact_id = j.fact_id
  LEFT JOIN (SELECT held, fact_id AS superseded_by FROM judged WHERE outcome = 'superseded') s ON s.held = j.fact_id)""".replace(
    " at FROM judged", ' "at" FROM judged'
).replace("arg_max(at, seq)", 'arg_max("at", seq)').replace("at AS created_at", '"at" AS created_at')
NOW = "2024-09-15T00:00:00Z"


def _admitted(t):
    return mem.admit_writes(t("fact_writes")).where("allowed")


def _facts(t):
    return mem.fold_facts(_admitted(t), segment=1000)[0]


@query(
    "m01_admit_writes", "fact_writes",
    f"SELECT seq, {REASON} AS reason, {REASON} IN ('owner said so', 'observed often enough', 'owner approved') AS allowed FROM fact_writes",
)
def _(t):
    return mem.admit_writes(t("fact_writes")).select("seq", "reason", "allowed")


@query("m02_judge_writes", "fact_writes", f"{FOLD} SELECT seq, outcome, held FROM judged")
def _(t):
    return mem.judge_writes(_admitted(t), segment=1000).select("seq", "outcome", "held")


@query("m02_fold_facts", "fact_writes", f"{FOLD} SELECT * FROM facts")
def _(t):
    return _facts(t)


@query(
    "m02_contradictions", "fact_writes",
    f"{FOLD} SELECT seq, held AS fact_id, value AS proposed, source AS proposed_source FROM judged WHERE outcome = 'contradicted'",
)
def _(t):
    return mem.fold_facts(_admitted(t), segment=1000)[1]


@query(
    "m03_live_facts", "fact_writes",
    f"{FOLD} SELECT key, scope, scope_ref, fact_id, value FROM facts WHERE superseded_by IS NULL",
)
def _(t):
    return mem.live_facts(_facts(t)).select("key", "scope", "scope_ref", "fact_id", "value")


@query(
    "m04_fact_history", "fact_writes",
    f"{FOLD} SELECT fact_id, value, superseded_by FROM facts WHERE key = 'click'",
)
def _(t):
    return mem.fact_history(_facts(t), "click").select("fact_id", "value", "superseded_by")


@query(
    "m05_staleness", "fact_writes",
    f"""
WITH s AS (SELECT seq, confidence, epoch_us(TIMESTAMPTZ '{NOW}') - epoch_us(try_cast(w."at" AS TIMESTAMPTZ)) >= 90 * 86400000000 AS stale FROM fact_writes w)
SELECT seq, stale, round(CASE WHEN stale THEN confidence * 0.8 ELSE confidence END, 3) AS effective_confidence FROM s""",
)
def _(t):
    facts = t("fact_writes").withColumnRenamed("at", "last_confirmed_at").withColumn("confidence", F.col("confidence").cast("double"))
    return mem.with_staleness(facts, F.to_timestamp(F.lit(NOW))).select("seq", "stale", "effective_confidence")


@query(
    "m06_count_hits", "fact_writes",
    "SELECT fact_id, (SELECT count(*) FROM lineitem WHERE l_partkey = seq) AS hit_count FROM fact_writes",
)
def _(t):
    uses = t("lineitem").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("fact_id"))
    return mem.count_hits(t("fact_writes"), uses)


STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
WORDS = (
    "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), "
    f"lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))))"
)


@query(
    "m07_goal_signature", "goals",
    f"SELECT goal_id, lower(project) || ':' || array_to_string({WORDS.format('goal')}, ' ') AS signature FROM goals",
)
def _(t):
    return t("goals").select("goal_id", tx.goal_signature(F.col("goal"), F.col("project")).alias("signature"))


SETS = f"g AS (SELECT goal_id, project, {WORDS.format('goal')} AS w FROM goals), a AS (SELECT attempt_id, project, at_ AS t, {WORDS.format('goal')} AS w FROM (SELECT *, \"at\" AS at_ FROM attempts) x)"
JACCARD = "len(list_intersect(g.w, a.w)) / len(list_distinct(list_concat(g.w, a.w)))"


@query(
    "m08_match_attempts", "goals attempts",
    f"""WITH {SETS}, s AS (SELECT goal_id, attempt_id, t, {JACCARD} AS score FROM g, a),
r AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY score DESC, t DESC, attempt_id DESC) AS rank FROM s WHERE score >= 0.6)
SELECT goal_id, attempt_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""",
)
def _(t):
    return mem.match_attempts(t("goals"), t("attempts"))


PRIOR = f"""{SETS}, ex AS (SELECT goal_id, attempt_id, 'exact' AS how, row_number() OVER (PARTITION BY goal_id ORDER BY t DESC, attempt_id DESC) AS rank
  FROM g JOIN a ON a.project = g.project AND a.w = g.w),
fz AS (SELECT goal_id, attempt_id, 'fuzzy' AS how, row_number() OVER (PARTITION BY goal_id ORDER BY {JACCARD} DESC, t DESC, attempt_id DESC) AS rank
  FROM g JOIN a ON a.project = g.project WHERE {JACCARD} >= 0.6 AND goal_id NOT IN (SELECT goal_id FROM ex)),
prior AS (SELECT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz) u WHERE rank <= 3)"""


@query("m09_prior_attempts", "goals attempts", f"WITH {PRIOR} SELECT * FROM prior")
def _(t):
    return mem.prior_attempts(t("goals"), t("attempts"))


EV = ", ".join(f"'{k}=' || {js('evidence.' + k, 'result')}" for k in mem.MEASURED)
OBJ, ROLE, PROJ, SUMMARY = js("objective", "spec"), js("role", "spec"), js("project", "spec"), js("summary", "result")
BRANCH = js("evidence.branch", "result")


@query(
    "m10_attempts_from_tasks", "tasks",
    f"""
WITH x AS (SELECT id, status, agent, result, {OBJ} AS goal, {ROLE} AS role, {PROJ} AS project, {SUMMARY} AS summary, concat_ws(', ', {EV}) AS ev, {BRANCH} AS branch FROM tasks
  WHERE status IN ('succeeded','failed','timeout','skipped','cancelled'))
SELECT id AS task_id, lower(coalesce(project, '')) || ':' || array_to_string({WORDS.format("coalesce(goal, '')")}, ' ') AS signature, coalesce(goal, '') AS goal,
  coalesce(project, '') AS project, concat_ws('; ', CASE WHEN coalesce(role, '') <> '' THEN 'asked a ' || role || ' to: ' || coalesce(goal, '') END,
    CASE WHEN coalesce(summary, '') <> '' THEN summary END, CASE WHEN ev <> '' THEN 'measured ' || ev END) AS approach, coalesce(agent, '') AS agent,
  CASE WHEN status = 'succeeded' THEN 'success' WHEN status IN ('cancelled','skipped') THEN 'abandoned' ELSE 'failure' END AS outcome,
  CASE WHEN status <> 'succeeded' THEN {js('error.message', 'result')} END AS what_failed, CASE WHEN coalesce(branch, '') <> '' THEN 'branch:' || branch ELSE '' END AS files FROM x""",
)
def _(t):
    return mem.attempts_from_tasks(t("tasks")).withColumn("files", F.array_join("files", " "))


@query(
    "m11_memory_band", "goals attempts fact_writes",
    f"""{FOLD.replace('WITH RECURSIVE ', 'WITH RECURSIVE ' + PRIOR + ', ')},
lv AS (SELECT * FROM facts WHERE superseded_by IS NULL),
pf AS (SELECT fact_id, row_number() OVER (ORDER BY last_confirmed_at DESC, fact_id) AS p FROM lv WHERE kind = 'preference'),
gl AS (SELECT fact_id, row_number() OVER (ORDER BY last_confirmed_at DESC, fact_id) AS p FROM lv WHERE kind = 'fact' AND scope = 'global'),
pr AS (SELECT fact_id, scope_ref, row_number() OVER (PARTITION BY scope_ref ORDER BY last_confirmed_at DESC, fact_id) AS p FROM lv WHERE kind = 'fact' AND scope = 'project')
SELECT goal_id AS request, 'preferences' AS part, p AS position, fact_id AS id FROM goals, pf WHERE p <= 5
UNION ALL SELECT goal_id, 'global', p, fact_id FROM goals, gl WHERE p <= 8
UNION ALL SELECT goal_id, 'project', p, fact_id FROM goals JOIN pr ON scope_ref = project WHERE p <= 8
UNION ALL SELECT goal_id, 'attempts', rank, CAST(attempt_id AS VARCHAR) FROM prior""",
)
def _(t):
    goals = t("goals")
    return mem.memory_band(
        goals.select(F.col("goal_id").alias("request"), "project"),
        mem.live_facts(_facts(t)),
        mem.prior_attempts(goals, t("attempts")),
    )
