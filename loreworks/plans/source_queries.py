"""Registered queries: sources and sinks."""

import os
import uuid

from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators import corpus
from loreworks.operators import events as ev
from loreworks.plans.event_queries import js
from loreworks.plans.policy_queries import _chain
from loreworks.plans.registry import query
from loreworks.operators import redaction as rd
from loreworks.session import shared_dir
from loreworks.sources import files as fl
from loreworks.sources import logs, reports, tables

RULES = fl.Rules(deny=("**/vendor/**", "src7/*"), exclude=("**/node_modules/**", "*.JSON"), max_bytes=5000)


def fresh(t, name: str) -> str:
    return os.path.join(shared_dir(t.spark), name, uuid.uuid4().hex)


@query(
    "s01_scan_files", "",
    "SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1",
)
def _(t):
    root = fresh(t, "scan")
    t("documents").select("lang", "text").write.partitionBy("lang").text(root)
    found, missing = fl.scan_files(t.spark, [root, root + "/none"], with_content=False)
    assert missing == [root + "/none"]
    lang = F.regexp_extract("rel_path", r"^lang=([a-z]+)/", 1)
    return found.where(F.col("rel_path").endswith(".txt")).groupBy(lang.alias("lang")).agg(F.sum("size").alias("bytes"))


def _kind_sql(path: str) -> str:
    return f"""CASE WHEN regexp_matches({path}, '\\.md$') THEN 'markdown' WHEN regexp_matches({path}, '\\.(py|js)$') THEN 'code'
  WHEN regexp_matches({path}, '\\.txt$') THEN 'text' WHEN regexp_matches({path}, '\\.json$') THEN 'config' WHEN regexp_matches({path}, '\\.pdf$') THEN 'pdf' END"""


VERDICT = f"""CASE WHEN rel_path LIKE '%/vendor/%' OR rel_path LIKE 'src7/%' THEN 'denied'
  WHEN rel_path LIKE '%/node_modules/%' OR rel_path LIKE '%.json' THEN 'excluded'
  WHEN project IN (SELECT project FROM listing) AND (project, rel_path) NOT IN (SELECT project, rel_path FROM listing) THEN 'untracked'
  WHEN {_kind_sql('rel_path')} IS NULL THEN 'wrong_type' WHEN NOT readable THEN 'unreadable' WHEN size > 5000 THEN 'too_large' ELSE 'admitted' END"""


@query("s02_admit_files", "files listing", f"SELECT doc_id, {VERDICT} AS verdict FROM files")
def _(t):
    return fl.admit_files(t("files"), RULES, t("listing")).select("doc_id", "verdict")


@query(
    "s03_keep_tracked", "files listing",
    """SELECT doc_id FROM files WHERE project NOT IN (SELECT project FROM listing) OR (project, rel_path) IN (SELECT project, rel_path FROM listing)""",
)
def _(t):
    return fl.keep_tracked(t("files"), t("listing")).select("doc_id")


@query(
    "s04_rejection_census", "files listing",
    f"""WITH j AS (SELECT *, {VERDICT} AS verdict FROM files)
SELECT collection, verdict AS reason, count(*) AS n FROM j WHERE verdict <> 'admitted' AND rel_path NOT LIKE '%/vendor/%' AND rel_path NOT LIKE '%/node_modules/%' GROUP BY 1, 2
UNION ALL SELECT collection, 'denied_dirs', count(DISTINCT split_part(rel_path, '/vendor/', 1)) FROM j WHERE rel_path LIKE '%/vendor/%' GROUP BY 1
UNION ALL SELECT collection, 'pruned_dirs', count(DISTINCT split_part(rel_path, '/node_modules/', 1)) FROM j WHERE rel_path LIKE '%/node_modules/%' GROUP BY 1""",
)
def _(t):
    return fl.rejection_census(fl.admit_files(t("files"), RULES, t("listing")), RULES)


@query("s05_content_kind", "files", f"SELECT doc_id, {_kind_sql('rel_path')} AS kind FROM files")
def _(t):
    return t("files").select("doc_id", tx.content_kind(F.col("rel_path")).alias("kind"))


@query(
    "s06_kind_counts", "files",
    f"SELECT kind, count(*) AS n FROM (SELECT {_kind_sql('rel_path')} AS kind FROM files) k WHERE kind IS NOT NULL GROUP BY 1",
)
def _(t):
    return corpus.kind_counts(t("files").withColumn("kind", tx.content_kind(F.col("rel_path"))))


@query("s07_read_range", "log", "SELECT seq, type FROM log WHERE seq > 20 AND seq <= 8000 ORDER BY seq LIMIT 5000")
def _(t):
    return ev.read_range(t("log"), 20, 8000, 5000).select("seq", "type")


@query(
    "s08_append_events", "log",
    "SELECT type, bool_and(type IN (" + ", ".join(f"'{x}'" for x in ev.CRITICAL_TYPES) + ")) AS critical, count(*) AS n FROM log GROUP BY 1",
)
def _(t):
    out = fresh(t, "events")
    logs.append_events(t("log"), out)
    return t.spark.read.parquet(out).groupBy("type").agg(F.bool_and("critical").alias("critical"), F.count(F.lit(1)).alias("n"))


@query("s08_compact_seq", "", "SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def _(t):
    return logs.compact_seq(t("events").select("ts", "event_id"), ["ts", "event_id"], 100).select("event_id", "seq")


@query(
    "s09_read_audit", "",
    "SELECT user_id, count(*) AS lines FROM events GROUP BY 1",
)
def _(t):
    out = fresh(t, "audit")
    line = F.to_json(F.struct("user_id", "event_id"))
    t("events").repartition(4, "user_id").sortWithinPartitions("user_id", "event_id").select(line.alias("value")).write.text(out)
    read = logs.read_audit(t.spark, out)
    parsed = read.select("log_id", "line_no", F.from_json("raw", "user_id long, event_id long").alias("r"))
    # the numbers must follow the order in which the lines were written
    checked = parsed.groupBy("log_id", "r.user_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.array_sort(F.collect_list(F.struct("line_no", F.col("r.event_id").alias("e")))).alias("a"),
    )
    return checked.where(F.col("a.e") == F.array_sort("a.e")).select("user_id", "lines")


@query(
    "s10_transcript_events", "transcript_lines",
    f"""
WITH v AS (SELECT * FROM transcript_lines WHERE json_valid(raw) AND line_no <= 4),
j AS (SELECT run, line_no, {js('type', 'raw')} AS type, {js('model', 'raw')} AS model, raw FROM v)
SELECT run, line_no, CAST(0 AS BIGINT) AS part, CASE WHEN raw LIKE '%plugin_errors%' THEN 'error' ELSE 'started' END AS kind,
  CASE WHEN raw LIKE '%plugin_errors%' THEN 'boom' ELSE coalesce(model, '') END AS text, CAST(NULL AS VARCHAR) AS tool, false AS from_subagent FROM j WHERE type = 'system'
UNION ALL SELECT run, line_no, 0, 'text', {js('message.content[0].text', 'raw')}, NULL, raw LIKE '%parent_tool_use_id%' FROM j WHERE type = 'assistant'
UNION ALL SELECT run, line_no, 1, 'tool_use', '', 'fs.read', raw LIKE '%parent_tool_use_id%' FROM j WHERE type = 'assistant'
UNION ALL SELECT run, line_no, 0, CASE WHEN {js('is_error', 'raw')} = 'true' THEN 'error' ELSE 'finished' END, 'done', NULL, false FROM j WHERE type = 'result'""",
)
def _(t):
    return logs.transcript_events(t("transcript_lines"))


@query(
    "s11_transcript_summary", "transcript_lines run_exits",
    f"""
WITH l AS (SELECT * FROM transcript_lines x WHERE line_no <= 4),
j AS (SELECT run, line_no, json_valid(raw) AS ok, {js('type', 'raw')} AS type, {js('is_error', 'raw')} AS err, {js('session_id', 'raw')} AS sid, {js('duration_ms', 'raw')} AS ms, raw FROM l),
p AS (SELECT run, bool_or(coalesce(type = 'result', false)) AS has, bool_or(coalesce(type = 'result' AND err = 'true', false)) AS err, bool_or(raw LIKE '%plugin_errors%') AS broken,
  max(CASE WHEN type = 'result' THEN 0.25 END) AS cost, max(CAST(ms AS BIGINT)) AS ms, max(CASE WHEN type = 'result' THEN line_no END) AS turns, max(sid) AS sid,
  count(*) FILTER (NOT ok) AS bad FROM j GROUP BY 1)
SELECT run, exit_code = 0 AND has AND NOT err AND NOT broken AS success, CAST(cost AS DOUBLE) AS cost_usd, ms AS duration_ms, turns AS num_turns, sid AS session_id, bad AS bad_lines
FROM run_exits JOIN p USING (run)""",
)
def _(t):
    return logs.transcript_summary(t("transcript_lines"), t("run_exits"))


def report_sql(passed: str, failed: str, named: str, message: str, duration: str) -> str:
    said = f"CASE WHEN {named} = 0 THEN '' ELSE repeat('{message}|', CAST({named} AS INTEGER) - 1) || '{message}' END"
    return f"SELECT run, {passed} AS passed, {failed} AS failed, skipped, {named} AS named, {said} AS messages, CAST({duration} AS DOUBLE) AS duration_s FROM report_rows"


def _named(df):
    return df.select(
        "run", "passed", "failed", "skipped", F.size("failures").cast("long").alias("named"), F.array_join("details.message", "|").alias("messages"), "duration_s"
    )


def _case(tag: str):
    return F.concat(F.lit('<testcase classname="c" name="t"><'), F.lit(tag), F.lit(' message="m"/></testcase>'))


@query("s12_junit_reports", "report_rows", report_sql("tests - failures - errors - skipped", "failures + errors", "failures + errors", "m", "tests + 0.25"))
def _(t):
    r = t("report_rows")
    suite = F.concat(
        F.format_string('<testsuite tests="%d" failures="%d" errors="%d" skipped="%d" time="%d.25">', "tests", "failures", "errors", "skipped", "tests"),
        F.repeat(_case("failure"), F.col("failures").cast("int")), F.repeat(_case("error"), F.col("errors").cast("int")), F.lit("</testsuite>"),
    )
    half = F.lit('<testsuite tests="0" failures="0" errors="0" skipped="0"></testsuite>')
    raw = F.when(F.col("run") % 2 == 0, suite).otherwise(F.concat(F.lit("<testsuites>"), suite, half, F.lit("</testsuites>")))
    return _named(reports.parse_junit(r.select("run", raw.alias("raw"))))


@query("s12_js_reports", "report_rows", report_sql("tests - failures - skipped", "failures", "failures", "n", "tests"))
def _(t):
    case = lambda status: F.struct(F.lit(status).alias("status"), F.lit("t").alias("title"), F.array(F.lit("n"), F.lit("more")).alias("failureMessages"))
    cases = F.concat(
        F.array_repeat(case("failed"), F.col("failures").cast("int")), F.array_repeat(case("passed"), F.col("skipped").cast("int"))
    )
    doc = F.to_json(
        F.struct(
            (F.col("tests") - F.col("failures") - F.col("skipped")).alias("numPassedTests"), F.col("failures").alias("numFailedTests"),
            F.col("skipped").alias("numPendingTests"), F.lit(500).alias("startTime"), (F.col("tests") * 1000 + 500).alias("endTime"), F.array(F.struct(cases.alias("assertionResults"))).alias("testResults"),
        )
    )
    return _named(reports.parse_js_json(t("report_rows").select("run", doc.alias("raw"))))


@query("s12_cargo_reports", "report_rows", report_sql("2 * tests", "failures", "failures", "see the log for the assertion", "0"))
def _(t):
    raw = F.concat(
        F.format_string("running\ntest result: ok. %d passed; 0 failed; %d ignored; 0 measured\n", "tests", "skipped"),
        F.lit("failures:\n"), F.repeat(F.lit("    mod::case\n"), F.col("failures").cast("int")),
        F.format_string("\ntest result: FAILED. %d passed; %d failed; 0 ignored\n", "tests", "failures"),
    )
    return _named(reports.parse_cargo(t("report_rows").select("run", raw.alias("raw"))))


@query(
    "s13_read_commits", "commit_lines",
    """
SELECT p[1] AS sha, p[2] AS short, p[3] AS author, p[4] AS date, p[5] AS subject FROM (SELECT string_split(raw, chr(31)) AS p FROM commit_lines) c WHERE len(p) = 5""",
)
def _(t):
    out = fresh(t, "commits")
    t("commit_lines").select("raw").write.text(out)
    return logs.read_commits(t.spark, out)


@query(
    "s14_load_cases", "cases questions",
    "SELECT CAST(qid AS VARCHAR) AS qid, kind, expected, length(text) AS chars FROM cases JOIN questions USING (qid)",
)
def _(t):
    out = fresh(t, "cases")
    grouped = t("cases").groupBy("qid", "kind").agg(F.collect_list("expected").alias("expect_any"))
    grouped.join(t("questions"), "qid").select(
        F.col("qid").cast("string").alias("id"), F.col("text").alias("q"), "kind", "expect_any"
    ).write.json(out)
    return logs.load_cases(t.spark, out).select("qid", "kind", "expected", F.char_length("text").cast("long").alias("chars"))


@query(
    "s15_replace_documents", "chunks",
    """
SELECT doc_id, chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || CAST(length(text) AS VARCHAR) ELSE sha256(text) END AS body
FROM chunks WHERE doc_id % 7 <> 1 AND NOT (doc_id % 3 = 0 AND ordinal > 0)""",
)
def _(t):
    path = fresh(t, "index")
    rows = t("chunks").select("doc_id", "chunk_id", F.sha2("text", 256).alias("body"))
    tables.write_index(rows, path, bucket_keys=500)
    new = t("chunks").where("doc_id % 3 = 0 AND doc_id % 7 <> 1 AND ordinal = 0").select(
        "doc_id", "chunk_id", F.concat(F.lit("new "), F.char_length("text").cast("string")).alias("body")
    )
    gone = t("docs").where("doc_id % 7 = 1").select("doc_id")
    tables.replace_documents(new, path, removed=gone)
    return tables.read_index(t.spark, path)


@query(
    "c28_safe_scan", "files listing",
    f"SELECT doc_id, {_chain('text', len(rd.PATTERNS))} AS text FROM files WHERE {VERDICT} = 'admitted'",
)
def _(t):
    return fl.safe_scan(t("files"), RULES, t("listing")).select("doc_id", "text")
