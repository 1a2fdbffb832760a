"""Registered queries: the streaming operators, run to the end of the given events."""

import os
import uuid

from pyspark.sql import functions as F

from loreworks.plans.corpus_queries import sizes
from loreworks.plans.event_queries import CALL_PAIRS, js
from loreworks.plans.registry import query
from loreworks.session import shared_dir
from loreworks.sources.files import Rules
from loreworks.streaming import changes as ch
from loreworks.streaming import late
from loreworks.streaming import state as st
from loreworks.streaming import stateful as sf

CHANGE_RULES = Rules(deny=("**/private/**", "private/*"), exclude=("**/node_modules/**", "node_modules/*"))
DELAY = "10 minutes"


def _work(t, name: str) -> str:
    return os.path.join(shared_dir(t.spark), "streams", f"{name}-{uuid.uuid4().hex}")


def _stream(t, table: str, like: str):
    """The rows of a derived table as a stream: saved as files, then read back file by file."""
    path = _work(t, like)
    t(table).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    schema = t.spark.read.parquet(path).schema
    return t.spark.readStream.schema(schema).parquet(path)


def _run(t, stream, name: str):
    """Run an append-mode stream until its input is used up; its output as a table."""
    out = _work(t, name)
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


ADMITTED = "rel_path NOT LIKE 'private/%' AND rel_path NOT LIKE 'node_modules/%' AND regexp_matches(rel_path, '\\.(py|md)$')"


@query(
    "w01_quiet_batches", "change_events",
    """
WITH e AS (SELECT collection, ts, rel_path, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY collection ORDER BY ts) >= 600000000 AS cut FROM change_events),
g AS (SELECT *, sum(CASE WHEN coalesce(cut, true) THEN 1 ELSE 0 END) OVER (PARTITION BY collection ORDER BY ts) AS grp FROM e),
s AS (SELECT collection, grp, min(ts) AS b, max(ts) AS e, count(DISTINCT rel_path) AS paths FROM g GROUP BY 1, 2)
SELECT collection, epoch_us(b) AS start_us, paths FROM s WHERE epoch_us(e) + 600000000 <= (SELECT epoch_ms(max(ts)) * 1000 FROM change_events) - 600000000""",
)
def _(t):
    with ch.merged_early(t.spark):
        out = _run(t, ch.quiet_batches(_stream(t, "change_events", "changes"), "10 minutes", delay=DELAY), "quiet")
    return out.select("collection", F.unix_micros("start").alias("start_us"), F.size("paths").cast("long").alias("paths"))


@query("w02_admit_changes", "change_events", f"SELECT event_id, rel_path FROM change_events WHERE {ADMITTED}")
def _(t):
    changed = _stream(t, "change_events", "changes").withColumn("path", F.concat(F.lit("/corpus/"), "rel_path"))
    return _run(t, ch.admit_changes(changed, CHANGE_RULES).select("event_id", "rel_path"), "admitted")


def _lines(live):
    """Chunks of a document: its lines that are not empty, as SQL can cut them too."""
    cut = live.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where("text <> ''")
    return cut.select("doc_id", F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), "ordinal", F.lit("").alias("anchor"), "text")


def _reindexed(t):
    """Folder of an index that took the old half of the documents in one batch and then the changes as a stream."""
    root = _work(t, "index")
    docs = t("docs").select("doc_id", "collection", "project", "rel_path", "kind", "text").withColumn("deleted", F.lit(False))
    old = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("old\n"), F.substring("text", 1, 40)))
    ch.create_index(t.spark, root)
    ch.reindex_batch(docs.where("doc_id % 4 < 2").withColumn("text", old), root, sizes, _lines)
    feed = _work(t, "feed")
    docs.withColumn("deleted", F.col("doc_id") % 13 == 5).withColumn("ts", F.timestamp_seconds("doc_id")).write.parquet(feed)
    stream = t.spark.readStream.schema(t.spark.read.parquet(feed).schema).parquet(feed)
    ch.reindex_stream(stream, root, root + "-state", sizes, _lines).awaitTermination()
    return root


LIVE_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM docs WHERE doc_id % 13 <> 5),
k AS (SELECT doc_id, doc_id || '-' || ordinal AS chunk_id, ordinal, line FROM l WHERE line <> '')"""


@query(
    "w03_reindex_stream", "docs",
    """
SELECT CASE WHEN doc_id % 13 = 5 THEN 'removed' WHEN doc_id % 4 = 0 THEN 'unchanged' WHEN doc_id % 4 = 1 THEN 'changed' ELSE 'new' END AS action, count(*) AS n FROM docs GROUP BY 1""",
)
def _(t):
    return t.spark.read.parquet(f"{_reindexed(t)}/log").groupBy("action").agg(F.sum("n").alias("n"))


@query("w03_index_hashes", "docs", "SELECT doc_id, sha256(text) AS content_hash FROM docs WHERE doc_id % 13 <> 5")
def _(t):
    return ch.index_tables(t.spark, _reindexed(t))[0].read()


@query("w03_index_chunks", "docs", f"WITH {LIVE_LINES} SELECT doc_id, chunk_id, ordinal, sha256(line) AS text_hash FROM k")
def _(t):
    return ch.index_tables(t.spark, _reindexed(t))[1].read().select("doc_id", "chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "text_hash")


@query(
    "w03_index_vectors", "docs",
    f"WITH {LIVE_LINES} SELECT doc_id, chunk_id, length(line)::DOUBLE AS size, length(string_split(line, ' ')[1])::DOUBLE AS head FROM k",
)
def _(t):
    v = ch.chunk_vectors(t.spark, _reindexed(t))
    return v.select("doc_id", "chunk_id", F.col("vec")[0].cast("double").alias("size"), F.col("vec")[1].cast("double").alias("head"))


def _approvals(t):
    ev = _stream(t, "log", "approvals")
    ids = F.get_json_object("payload", "$.approval_id").alias("approval_id")
    asked = ev.where("type = 'approval.requested'").select(
        ids, "ts", "seq", (F.coalesce(F.get_json_object("payload", "$.waits"), F.lit("false")) == "true").alias("waits")
    ).where("approval_id IS NOT NULL")
    ev2 = _stream(t, "log", "approvals")
    answered = ev2.where("type = 'approval.resolved'").select(
        ids, "ts", "seq", F.get_json_object("payload", "$.resolution").alias("resolution")
    ).where("approval_id IS NOT NULL")
    return asked, answered


APPROVALS = f"""q AS (SELECT {js('approval_id')} AS approval_id, ts, seq, coalesce({js('waits')}, 'false') = 'true' AS waits FROM log WHERE type = 'approval.requested'),
r AS (SELECT {js('approval_id')} AS approval_id, ts, seq, {js('resolution')} AS resolution FROM log WHERE type = 'approval.resolved')"""


@query(
    "w04_expire_approvals", "log",
    f"""WITH {APPROVALS}, rr AS (SELECT * FROM r WHERE approval_id IS NOT NULL), qq AS (SELECT * FROM q WHERE NOT waits AND approval_id IS NOT NULL),
wm AS (SELECT (least((SELECT epoch_ms(max(ts)) FROM qq), (SELECT epoch_ms(max(ts)) FROM rr)) - 600000) * 1000 AS at_us),
m AS (SELECT qq.approval_id, qq.ts, rr.resolution FROM qq LEFT JOIN rr ON rr.approval_id = qq.approval_id AND rr.ts >= qq.ts AND rr.ts <= qq.ts + INTERVAL 180 SECOND)
SELECT approval_id, coalesce(resolution, 'expired') AS outcome FROM m, wm WHERE resolution IS NOT NULL OR epoch_us(ts) + 180000000 < at_us""",
)
def _(t):
    asked, answered = _approvals(t)
    return _run(t, st.expire_approvals(asked, answered, delay=DELAY), "expiry").select("approval_id", "outcome")


def _approval_tables(t):
    ids = F.get_json_object("payload", "$.approval_id").alias("approval_id")
    log = t("log").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = log.where("type = 'approval.requested'").select(
        ids, "ts", "seq", (F.coalesce(F.get_json_object("payload", "$.waits"), F.lit("false")) == "true").alias("waits")
    ).where("approval_id IS NOT NULL")
    answered = log.where("type = 'approval.resolved'").select(
        ids, "ts", "seq", F.get_json_object("payload", "$.resolution").alias("resolution")
    ).where("approval_id IS NOT NULL")
    return asked, answered


@query(
    "w04_expire_approvals_batch", "log",
    f"""WITH {APPROVALS}, a AS (SELECT q.approval_id, arg_min(resolution, r.ts) AS res FROM q JOIN r ON r.approval_id = q.approval_id
  AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 180 SECOND GROUP BY 1)
SELECT q.approval_id, coalesce(res, 'expired') AS outcome FROM q LEFT JOIN a USING (approval_id) WHERE NOT waits AND q.approval_id IS NOT NULL""",
)
def _(t):
    return st.expire_approvals_batch(*_approval_tables(t)).select("approval_id", "outcome")


@query(
    "w04_dispatched", "log",
    f"""WITH {APPROVALS}, a AS (SELECT q.approval_id, arg_min(resolution, r.ts) AS res FROM q JOIN r ON r.approval_id = q.approval_id AND r.ts >= q.ts GROUP BY 1)
SELECT q.approval_id, coalesce(res, 'open') AS outcome FROM q LEFT JOIN a USING (approval_id) WHERE waits AND q.approval_id IS NOT NULL""",
)
def _(t):
    return st.dispatched(*_approval_tables(t)).select("approval_id", "outcome")


@query("w05_first_resolution", "log", f"WITH {APPROVALS} SELECT approval_id, min(seq) AS seq FROM r WHERE approval_id IS NOT NULL GROUP BY 1")
def _(t):
    return st.first_resolution(_approval_tables(t)[1]).select("approval_id", "seq")


@query("w05_first_resolution_stream", "log", f"WITH {APPROVALS} SELECT DISTINCT approval_id FROM r WHERE approval_id IS NOT NULL")
def _(t):
    return _run(t, st.first_resolution(_approvals(t)[1], "30 days").select("approval_id"), "resolved")


@query("w06_dedupe_stream", "log", "SELECT type, count(*) AS n FROM log GROUP BY 1")
def _(t):
    s = _stream(t, "log", "log")
    twice = s.unionByName(_stream(t, "log", "log"))
    out = _run(t, ch.dedupe_stream(twice.select("seq", "ts", "type"), delay="60 days"), "deduped")
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w07_live_tasks", "log",
    f"""
WITH e AS (SELECT * FROM (SELECT seq, task_id, type, {js('source')} AS source, {js('root_id')} AS root_id, {js('kind')} AS kind, {js('status')} AS status
  FROM log WHERE type IN ('task.created', 'task.updated', 'task.finished') AND task_id IS NOT NULL) x WHERE source = 'graph' AND root_id IS NOT NULL),
c AS (SELECT root_id, task_id, min(seq) AS created_seq, arg_min(kind, seq) AS kind FROM e WHERE type = 'task.created' GROUP BY 1, 2),
l AS (SELECT e.root_id, e.task_id, arg_max(status, seq) FILTER (status IS NOT NULL AND seq > created_seq) AS status, max(seq) AS last_seq FROM e JOIN c
  ON c.root_id = e.root_id AND c.task_id = e.task_id GROUP BY 1, 2)
SELECT root_id, task_id, coalesce(kind, '') AS kind, coalesce(status, 'pending') AS status, created_seq, greatest(last_seq, created_seq) AS last_seq
FROM c JOIN l USING (root_id, task_id)""",
)
def _(t):
    out = _work(t, "tasks")
    st.run_updates(st.live_tasks(_stream(t, "log", "log")), out, out + "-state").awaitTermination()
    return st.settle_tasks(t.spark.read.parquet(out))


@query(
    "w08_event_rates", "log",
    """
WITH w AS (SELECT epoch_us(ts) - epoch_us(ts) % 3600000000 AS start_us, type, count(*) AS n FROM log GROUP BY 1, 2)
SELECT * FROM w WHERE start_us + 3600000000 <= (SELECT epoch_ms(max(ts)) * 1000 FROM log) - 600000000""",
)
def _(t):
    out = _run(t, ch.event_rates(_stream(t, "log", "log").select("ts", "type"), "1 hour", DELAY), "rates")
    return out.select(F.unix_micros("start").alias("start_us"), "type", "n")


def _in_parts(t, table: str, parts: list, start, name: str) -> None:
    """Feed a table to a stream part by part; the stream is stopped after each and goes on from its checkpoint."""
    feed = _work(t, name)
    rows = t(table).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in parts:
        rows.where(part).write.mode("append").parquet(feed)
        start(t.spark.readStream.schema(t.spark.read.parquet(feed).schema).parquet(feed)).awaitTermination()


def _halves(t) -> list:
    middle = t("log").agg(F.percentile_approx("seq", 0.5)).first()[0]
    return [F.col("seq") <= middle, F.col("seq") > middle]


@query("l11_tool_calls_stream", "log", CALL_PAIRS)
def _(t):
    out = _work(t, "calls")
    _in_parts(t, "log", _halves(t), lambda s: _updates(sf.tool_calls(s), out), "calls-feed")
    return sf.settle_calls(t.spark.read.parquet(out))


def _updates(stream, out: str):
    with sf.rocksdb(stream.sparkSession):
        return st.run_updates(stream, out, out + "-state")


UNTIL_BOOT = f"""WITH {APPROVALS}, b AS (SELECT seq FROM log WHERE type = 'system.boot'),
qq AS (SELECT approval_id, seq FROM q WHERE waits AND approval_id IS NOT NULL),
a AS (SELECT qq.approval_id, qq.seq, min(r.seq) AS answered, arg_min(coalesce(resolution, 'resolved'), r.seq) AS res FROM qq JOIN r ON r.approval_id = qq.approval_id AND r.seq > qq.seq GROUP BY 1, 2),
n AS (SELECT qq.seq, min(b.seq) AS boot FROM qq JOIN b ON b.seq > qq.seq GROUP BY 1)
SELECT approval_id, seq, CASE WHEN boot IS NOT NULL AND (answered IS NULL OR boot < answered) THEN 'cleared' ELSE coalesce(res, 'open') END AS outcome
FROM qq LEFT JOIN a USING (approval_id, seq) LEFT JOIN n USING (seq)"""


@query("w04_dispatched_until_boot", "log", UNTIL_BOOT)
def _(t):
    return sf.dispatched_until_boot(t("log")).select("approval_id", "seq", "outcome")


@query("w04_dispatched_stream", "log", UNTIL_BOOT)
def _(t):
    out = _work(t, "requests")
    _in_parts(t, "log", _halves(t), lambda s: _updates(sf.dispatched_requests(s), out), "requests-feed")
    return sf.settle_requests(t.spark.read.parquet(out)).select("approval_id", "seq", "outcome")


def _routed(t) -> str:
    """Every third row of the log comes a batch later than it should."""
    out = _work(t, "routed")
    _in_parts(t, "log", [F.col("seq") % 3 == k for k in range(3)], lambda s: late.route_late(s, out, out + "-state", delay_s=86_400, width_s=3600), "routed-feed")
    return out


ROUTED = """n AS (SELECT seq % 3 AS batch, max(ts) AS newest FROM log GROUP BY 1),
w AS (SELECT batch, epoch_us((SELECT max(newest) FROM n x WHERE x.batch < n.batch)) AS us FROM n),
m AS (SELECT batch, make_timestamp(us - us % 1000 - 86400000000) AS watermark FROM w),
d AS (SELECT l.*, batch, watermark, coalesce(epoch_us(ts) - epoch_us(ts) % 3600000000 + 3600000000 <= epoch_us(watermark), false) AS late FROM log l JOIN m ON m.batch = l.seq % 3)"""


@query("w09_late_rows", "log", f"WITH {ROUTED} SELECT batch, seq, type, epoch_us(watermark) AS watermark_us FROM d WHERE late")
def _(t):
    return late.late_rows(t.spark, _routed(t)).select(F.col("batch").cast("long").alias("batch"), "seq", "type", F.unix_micros("watermark").alias("watermark_us"))


@query(
    "w09_late_census", "log",
    f"""WITH {ROUTED} SELECT batch, count(*) FILTER (WHERE NOT late) AS on_time, count(*) FILTER (WHERE late) AS late,
  max((epoch_us(watermark) - epoch_us(ts)) / 1e6) FILTER (WHERE late) AS worst_s FROM d GROUP BY 1""",
)
def _(t):
    return late.late_census(t.spark, _routed(t))
