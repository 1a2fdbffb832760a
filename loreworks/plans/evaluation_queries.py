"""Registered queries: scoring retrieval, classifiers and latency."""

from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators import evaluation as ev
from loreworks.plans.registry import query
from loreworks.plans.retrieval_queries import ARM_TABLES, ARMS, arms
from loreworks.session import save_point

RANKED = f"{ARMS}, ranked AS (SELECT arm, qid, d.rel_path AS path, rank FROM arms a JOIN docs d ON d.doc_id = a.id)"
FOUND = """files AS (SELECT arm, qid, path, row_number() OVER (PARTITION BY arm, qid ORDER BY r) AS fr
  FROM (SELECT arm, qid, path, min(rank) AS r FROM {ranked} GROUP BY 1, 2, 3) x),
hit AS (SELECT arm, f.qid, min(fr) AS found FROM files f JOIN cases c ON c.qid = f.qid AND contains(f.path, c.expected) WHERE fr <= {k} GROUP BY 1, 2),
found AS (SELECT a.arm, c.qid, c.kind, h.found FROM (SELECT DISTINCT qid, kind FROM cases) c CROSS JOIN (SELECT DISTINCT arm FROM {ranked}) a
  LEFT JOIN hit h ON h.arm = a.arm AND h.qid = c.qid)"""
RECALL = """rec AS (SELECT arm, kind, k, count(*) FILTER (found <= k) / count(*) AS recall, count(*) AS n FROM (
  SELECT arm, kind, found FROM found UNION ALL SELECT arm, '*', found FROM found) f CROSS JOIN (VALUES (1), (5), (10)) ks(k) GROUP BY 1, 2, 3)"""
TABLES = ARM_TABLES + " cases"


def _ranked(t):
    paths = t("docs").select(F.col("doc_id").alias("id"), F.col("rel_path").alias("path"))
    return save_point(arms(t).join(paths, "id").select("arm", "qid", "path", "rank"))


@query(
    "e01_recall", TABLES,
    f"WITH {RANKED}, {FOUND.format(ranked='ranked', k=10)}, {RECALL} SELECT arm, kind, CAST(k AS BIGINT) AS k, recall, n FROM rec",
)
def _(t):
    return ev.recall(_ranked(t), t("cases"))


@query(
    "e01_misses", TABLES,
    f"WITH {RANKED}, {FOUND.format(ranked='ranked', k=5)} SELECT arm, qid FROM found WHERE found IS NULL",
)
def _(t):
    return ev.misses(_ranked(t), t("cases"))


@query(
    "e02_answer_key_exclusion", TABLES,
    f"""WITH {RANKED}, shown AS (SELECT * FROM ranked WHERE NOT starts_with(path, 'src1/') AND NOT starts_with(path, 'src2/')),
{FOUND.format(ranked='shown', k=10)}, {RECALL} SELECT arm, kind, CAST(k AS BIGINT) AS k, recall, n FROM rec""",
)
def _(t):
    return ev.recall(ev.drop_answer_key(_ranked(t), ("src1/", "src2/")), t("cases"))


@query(
    "e03_reachable", "docs unreachable_cases",
    """
SELECT qid, kind, expected, qid IN (SELECT c.qid FROM unreachable_cases c JOIN docs d ON contains(d.rel_path, c.expected)) AS reachable
FROM unreachable_cases""",
)
def _(t):
    ok, dropped = ev.split_reachable(t("unreachable_cases"), t("docs").select(F.col("rel_path").alias("path")))
    return ok.withColumn("reachable", F.lit(True)).unionByName(dropped.withColumn("reachable", F.lit(False)))


@query(
    "e04_sample_keeping", "chunks",
    """
WITH a AS (SELECT chunk_id, doc_id FROM chunks WHERE project = 'src1'),
r AS (SELECT chunk_id, doc_id, row_number() OVER (ORDER BY md5('12648430:' || chunk_id), chunk_id) AS nth FROM chunks WHERE project <> 'src1')
SELECT chunk_id, doc_id FROM a UNION ALL SELECT chunk_id, doc_id FROM r WHERE nth <= greatest(0, 1000 - (SELECT count(*) FROM a))""",
)
def _(t):
    answers = t("chunks").where("project = 'src1'").select("chunk_id")
    return ev.sample_keeping(t("chunks").select("chunk_id", "doc_id"), answers, 1000)


@query(
    "e05_arm_verdict", TABLES,
    f"""WITH {RANKED}, {FOUND.format(ranked='ranked', k=10)}, {RECALL},
v AS (SELECT max(recall) FILTER (arm = 'gated_w2') AS a, max(recall) FILTER (arm = 'gated') AS b, max(recall) AS best
  FROM rec WHERE kind = '*' AND k = 5)
SELECT round(a, 6) AS arm_recall, round(b, 6) AS base_recall, round(a - b, 6) AS delta,
  CASE WHEN round(a - b, 6) > 0 THEN 'helps' WHEN round(a - b, 6) = 0 THEN 'no movement' ELSE 'hurts' END AS verdict, best >= 0.80 AS gate_met FROM v""",
)
def _(t):
    scores = ev.recall(_ranked(t), t("cases")).where("kind = '*' AND k = 5")
    return ev.arm_verdict(scores, "gated_w2", "gated")


@query(
    "e06_latency_stats", "",
    """
WITH s AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS ms,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS i,
  count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)
SELECT l_returnflag, l_linestatus, n, round(median(ms), 6) AS p50,
  max(ms) FILTER (i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95, min(ms) AS min FROM s GROUP BY 1, 2, 3""",
)
def _(t):
    samples = t("lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("ms"))
    return ev.latency_stats(samples, ["l_returnflag", "l_linestatus"]).withColumn("p50", F.round("p50", 6))


@query(
    "e07_unaccounted", "",
    """
SELECT l_linestatus, round(median(l_extendedprice), 6) AS l_extendedprice, round(median(l_quantity), 6) AS l_quantity,
  round(median(l_discount), 6) AS l_discount, round(median(l_tax), 6) AS l_tax,
  round(median(l_extendedprice) - (median(l_quantity) + median(l_discount) + median(l_tax)), 6) AS unaccounted
FROM lineitem GROUP BY 1""",
)
def _(t):
    return ev.unaccounted(t("lineitem"), ["l_linestatus"], "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query(
    "e08_accuracy", "label_results",
    """
SELECT count(*) AS n, count(*) FILTER (expected_intent IS NULL OR got_intent = expected_intent) / count(*) AS intent,
  count(*) FILTER (expected_project IS NOT DISTINCT FROM got_project) / count(*) AS project,
  count(*) FILTER (NOT wants_clarify OR clarified) / count(*) AS clarify, count(*) FILTER (prerouted) AS prerouted FROM label_results""",
)
def _(t):
    return ev.accuracy(t("label_results"))


@query(
    "e09_confusion", "label_results",
    """
SELECT expected_intent AS expected, got_intent AS got, count(*) AS n FROM label_results
WHERE expected_intent IS NOT NULL AND expected_intent <> got_intent GROUP BY 1, 2""",
)
def _(t):
    return ev.confusion(
        t("label_results").select(F.col("expected_intent").alias("expected"), F.col("got_intent").alias("got"))
    )


@query(
    "e10_structured_rates", "structured_calls",
    """
SELECT schema, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(repairs) AS BIGINT) AS repairs,
  CAST(sum(failures) AS BIGINT) AS failures, round_even(sum(failures) / sum(attempts), 4) AS failure_rate FROM structured_calls GROUP BY 1""",
)
def _(t):
    return ev.structured_rates(t("structured_calls"))


SIZED = "s AS (SELECT kind, project AS path, greatest(1, CAST(round_even(length(text) / 3.6, 0) AS BIGINT)) AS tokens, kind <> 'config' AS semantic FROM chunks)"
LIMIT = 200


def _sized(t):
    return t("chunks").select(
        "kind", F.col("project").alias("path"), tx.approx_tokens(F.col("text")).alias("tokens"), tx.is_semantic(F.col("kind")).alias("semantic")
    )


@query(
    "e11_overflow_report", "chunks",
    f"""WITH {SIZED}, o AS (SELECT *, semantic AND tokens > {LIMIT} AS over FROM s),
w AS (SELECT max(l / t) AS worst FROM (SELECT path, sum(CASE WHEN over THEN tokens - {LIMIT} ELSE 0 END) AS l, sum(tokens) AS t FROM o WHERE semantic GROUP BY 1) f),
a AS (SELECT count(*) AS chunks, count(*) FILTER (semantic) AS embedded, count(*) FILTER (over) AS over,
  CAST(sum(tokens) FILTER (semantic) AS BIGINT) AS tokens, CAST(sum(tokens - {LIMIT}) FILTER (over) AS BIGINT) AS lost,
  CAST(median(tokens) FILTER (over) AS DOUBLE) AS median_over, round(avg(tokens - {LIMIT}) FILTER (over), 6) AS mean_overshoot FROM o)
SELECT a.*, round(over / embedded, 6) AS rate, round(worst, 6) AS worst_share,
  CASE WHEN over / embedded < 0.02 THEN 'negligible' WHEN worst < 0.15 THEN 'marginal' ELSE 'causal' END AS verdict FROM a, w""",
)
def _(t):
    return ev.overflow_report(_sized(t), LIMIT)


@query(
    "e11_overflow_by_kind", "chunks",
    f"""WITH {SIZED} SELECT kind, count(*) AS chunks, count(*) FILTER (tokens > {LIMIT}) AS over, CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(sum(CASE WHEN tokens > {LIMIT} THEN tokens - {LIMIT} ELSE 0 END) AS BIGINT) AS lost FROM s GROUP BY 1""",
)
def _(t):
    return ev.overflow_by_kind(_sized(t), LIMIT)


@query(
    "e11_overflow_by_file", "chunks",
    f"""WITH {SIZED} SELECT path, count(*) AS chunks, count(*) FILTER (tokens > {LIMIT}) AS over, max(tokens) AS max, CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(sum(CASE WHEN tokens > {LIMIT} THEN tokens - {LIMIT} ELSE 0 END) AS BIGINT) AS lost FROM s WHERE semantic GROUP BY 1""",
)
def _(t):
    return ev.overflow_by_file(_sized(t), LIMIT)


@query(
    "e12_size_distribution", "docs",
    """
SELECT kind, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS p50,
  round(quantile_cont(length(text), 0.95), 6) AS p95, max(length(text)) AS max FROM docs GROUP BY 1""",
)
def _(t):
    return ev.size_distribution(t("docs"), ["kind"])


PASSES = """p AS (SELECT l_suppkey AS project, l_linenumber - 1 AS pass_no, l_extendedprice AS ms FROM lineitem),
cw AS (SELECT project, max(ms) FILTER (pass_no = 0) AS cold, median(ms) FILTER (pass_no > 0) AS warm FROM p GROUP BY 1)"""


def _passes(t):
    return t("lineitem").select(
        F.col("l_suppkey").alias("project"), (F.col("l_linenumber") - 1).alias("pass_no"), F.col("l_extendedprice").alias("ms")
    )


@query("e13_cold_warm", "", f"WITH {PASSES} SELECT project, cold, round(warm, 6) AS warm FROM cw")
def _(t):
    return ev.cold_warm(_passes(t)).withColumn("warm", F.round("warm", 6))


@query(
    "e13_cold_warm_totals", "",
    f"""WITH {PASSES} SELECT count(*) AS projects, round(sum(cold), 4) AS cold, round(sum(warm), 4) AS warm,
  (SELECT project FROM cw ORDER BY warm DESC, project DESC LIMIT 1) AS worst, sum(warm) <= 1000.0 AS within FROM cw""",
)
def _(t):
    return ev.cold_warm_totals(ev.cold_warm(_passes(t)), 1000.0)


@query(
    "e14_regression_diff", "baseline_tests observed_tests",
    """
WITH j AS (SELECT coalesce(b.root, o.root) AS root, b.failed AS b, o.failed AS o FROM baseline_tests b
  FULL OUTER JOIN observed_tests o ON b.root = o.root AND b.test = o.test),
g AS (SELECT root, count(*) FILTER (coalesce(o, false) AND NOT coalesce(b, false)) AS nf, count(*) FILTER (coalesce(b, false) AND NOT coalesce(o, false)) AS fx,
  count(*) FILTER (o = false) - count(*) FILTER (b = false) AS dp, count(b) AS nb, count(o) AS no FROM j GROUP BY 1)
SELECT root, CASE WHEN nb > 0 THEN nf END AS new_failures, CASE WHEN nb > 0 THEN fx END AS fixed,
  CASE WHEN nb > 0 THEN dp END AS delta_passed, CASE WHEN nb > 0 THEN nf = 0 END AS ok FROM g WHERE no > 0""",
)
def _(t):
    return ev.regression_diff(t("baseline_tests"), t("observed_tests"))


@query(
    "e14_new_failures", "baseline_tests observed_tests",
    """
SELECT root, test FROM observed_tests WHERE failed AND root IN (SELECT root FROM baseline_tests)
EXCEPT SELECT root, test FROM baseline_tests WHERE failed""",
)
def _(t):
    return ev.new_failures(t("baseline_tests"), t("observed_tests"))
