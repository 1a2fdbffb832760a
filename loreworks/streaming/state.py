"""Streams that keep state: approvals that expire and live task status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreworks.operators.events import field
from loreworks.streaming.changes import DEFAULT_DELAY

APPROVAL_TTL_S = 180


def first_resolution(resolved: DataFrame, delay: str | None = None) -> DataFrame:
    """The first answer to each approval; later ones change nothing.

    On a stream (``delay`` given) duplicates are dropped within the watermark; on a table the
    earliest answer is taken.
    """
    if delay is not None:
        return resolved.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["approval_id"])
    first = F.struct("seq")
    others = [c for c in resolved.columns if c != "approval_id"]
    return (
        resolved.groupBy("approval_id").agg(F.min_by(F.struct(*others), first).alias("_r"))
        .select("approval_id", "_r.*").select(*resolved.columns)
    )


def expire_approvals(requested: DataFrame, resolved: DataFrame, ttl_s: int = APPROVAL_TTL_S, delay: str = DEFAULT_DELAY) -> DataFrame:
    """{approval_id, asked, outcome} of a request stream joined with an answer stream.

    ``requested`` {approval_id, ts, waits}; ``resolved`` {approval_id, ts, resolution}.  A request
    answered within its time gives that answer; one without gives ``expired`` when the watermark
    has passed its deadline.  Requests that wait without a clock are not part of this join
    (see :func:`dispatched`), so the state is bounded by the time to live.
    """
    q = requested.where(~F.col("waits")).select("approval_id", F.col("ts").alias("asked")).withWatermark("asked", delay)
    r = resolved.select(
        F.col("approval_id").alias("_id"), F.col("ts").alias("answered"), "resolution"
    ).withWatermark("answered", delay)
    within = (
        (F.col("approval_id") == F.col("_id"))
        & (F.col("answered") >= F.col("asked"))
        & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {ttl_s} SECONDS"))
    )
    return q.join(r, within, "left_outer").select(
        "approval_id", "asked", F.coalesce("resolution", F.lit("expired")).alias("outcome")
    )


def expire_approvals_batch(requested: DataFrame, resolved: DataFrame, ttl_s: int = APPROVAL_TTL_S) -> DataFrame:
    """The same over tables: the earliest answer in time, else expired."""
    q = requested.where(~F.col("waits")).select("approval_id", F.col("ts").alias("asked"))
    near = q.join(resolved.select("approval_id", "ts", "resolution"), "approval_id").where(
        (F.col("ts") >= F.col("asked")) & (F.col("ts") <= F.col("asked") + F.expr(f"INTERVAL {ttl_s} SECONDS"))
    )
    answer = near.groupBy("approval_id").agg(F.min_by("resolution", "ts").alias("_a"))
    return q.join(answer, "approval_id", "left").select("approval_id", "asked", F.coalesce("_a", F.lit("expired")).alias("outcome"))


def dispatched(requested: DataFrame, resolved: DataFrame) -> DataFrame:
    """{approval_id, asked, outcome} of requests that wait: answered at any later time or open."""
    q = requested.where("waits").select("approval_id", F.col("ts").alias("asked"))
    later = q.join(resolved.select("approval_id", "ts", "resolution"), "approval_id").where(F.col("ts") >= F.col("asked"))
    answer = later.groupBy("approval_id").agg(F.min_by("resolution", "ts").alias("_a"))
    return q.join(answer, "approval_id", "left").select("approval_id", "asked", F.coalesce("_a", F.lit("open")).alias("outcome"))


def live_tasks(stream: DataFrame) -> DataFrame:
    """Running fold of graph task events, one row per task (update mode).

    Plain streaming aggregates with map-side combining: the state of a task is five values,
    whatever its number of events.
    """
    kind = F.col("type")
    ev = stream.where(kind.isin("task.created", "task.updated", "task.finished")).select(
        "seq", "task_id", "type", field("source").alias("source"), field("root_id").alias("root_id"),
        field("kind").alias("task_kind"), field("status").alias("task_status"),
    ).where("source = 'graph' AND root_id IS NOT NULL AND task_id IS NOT NULL")
    created = kind == "task.created"
    changed = ~created & F.col("task_status").isNotNull()
    return ev.groupBy("root_id", "task_id").agg(
        F.min(F.when(created, F.col("seq"))).alias("created_seq"),
        F.min_by("task_kind", F.when(created, F.col("seq"))).alias("kind"),
        F.max(F.when(changed, F.col("seq"))).alias("status_seq"),
        F.max_by("task_status", F.when(changed, F.col("seq"))).alias("status"),
        F.max("seq").alias("last_seq"),
    )


def settle_tasks(updates: DataFrame) -> DataFrame:
    """{root_id, task_id, kind, status, created_seq, last_seq} from the stream's updates.

    The newest update of a task wins; a task never seen created is left out, and a change that
    precedes the creation does not count.
    """
    cols = ["created_seq", "kind", "status_seq", "status", "last_seq"]
    newest = updates.groupBy("root_id", "task_id").agg(F.max_by(F.struct(*cols), F.struct("last_seq", "batch")).alias("_r"))
    after = F.col("status_seq") > F.col("created_seq")
    return (
        newest.select("root_id", "task_id", "_r.*").where("created_seq IS NOT NULL")
        .select(
            "root_id", "task_id", F.coalesce("kind", F.lit("")).alias("kind"),
            F.when(after, F.col("status")).otherwise("pending").alias("status"), "created_seq",
            F.greatest("last_seq", "created_seq").alias("last_seq"),
        )
    )


def run_updates(stream: DataFrame, out: str, checkpoint: str):
    """Write a stream's updates with their batch number (an update-mode sink of plain files)."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
