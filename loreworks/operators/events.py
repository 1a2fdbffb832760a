"""The event log: resuming, gaps, timelines, turns, tool calls, tasks and approvals.

A log row is {seq, ts, type, session_id, turn_id, task_id, trace_id, payload}; ``seq`` is unique
and increasing, ``payload`` is JSON text that may be malformed.  Running computations go through
:func:`loreworks.operators.scale.running`, so one busy session cannot pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreworks.operators.scale import attach_row, first_rows, running

# Events that must not be lost, and the further known types.
CRITICAL_TYPES = (
    "session.created", "session.resync", "turn.started", "turn.finished", "agent.state",
    "approval.requested", "approval.resolved", "task.created", "task.updated", "task.finished",
    "pipeline.started", "pipeline.finished", "continue.derived", "system.boot", "system.shutdown",
    "error", "system.degraded", "system.health",
)
OTHER_KNOWN_TYPES = (
    "message.delta", "message.completed", "tool.started", "tool.finished", "term.output",
    "term.opened", "term.closed", "delegate.event", "log.entry", "system.metrics",
    "memory.written", "memory.forgotten", "memory.refused", "memory.contradicted",
    "memory.attempt_recorded", "plan.descended", "plan.rejected", "graph.replan_exhausted",
)
RESUME_WINDOW = 10_000
HISTORY_SCAN, HISTORY_TURNS = 200, 3
TEXT_SEGMENT = 4096


def field(name: str, payload: str = "payload") -> Column:
    """A payload value as text; NULL when absent, null or the JSON is malformed."""
    return F.get_json_object(payload, f"$.{name}")


def is_critical(kind: Column) -> Column:
    return kind.isin(*CRITICAL_TYPES)


def read_range(log: DataFrame, since: int, to: int | None = None, limit: int | None = None) -> DataFrame:
    """Events with since < seq <= to in order; the bounds are scan predicates."""
    keep = F.col("seq") > since
    if to is not None:
        keep = keep & (F.col("seq") <= to)
    out = log.where(keep).orderBy("seq")
    return out.limit(limit) if limit is not None else out


def resume(log: DataFrame, since: int) -> DataFrame:
    """Everything after ``since``, each sequence number once."""
    return log.where(F.col("seq") > since).dropDuplicates(["seq"])


def resync(cursors: DataFrame, log: DataFrame, window: int = RESUME_WINDOW) -> DataFrame:
    """{client, resync, reason, baseline} for {client, since}."""
    head = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    floor = F.greatest(F.lit(0), F.col("head") - window)
    stale = (F.col("since") > 0) & (F.col("since") < floor)
    ahead = F.col("since") > F.col("head")
    return attach_row(cursors, head).select(
        "client",
        (stale | ahead).alias("resync"),
        F.when(ahead, "ahead").when(stale, "stale").alias("reason"),
        F.when(stale, floor).when(ahead, F.col("head")).otherwise(F.col("since")).alias("baseline"),
    )


def sequence_gaps(log: DataFrame, segment: int = 65_536) -> DataFrame:
    """{expected, got} for every received number that does not follow its predecessor."""
    seen = running(log.select("seq"), [], "seq", {"_prev": (F.col("seq"), "prev")}, segment)
    return seen.where(F.col("seq") != F.col("_prev") + 1).select(
        (F.col("_prev") + 1).alias("expected"), F.col("seq").alias("got")
    )


def classify_events(log: DataFrame) -> DataFrame:
    """Adds ``known`` and ``critical``; unknown types are kept."""
    kind = F.col("type")
    return log.withColumn("critical", is_critical(kind)).withColumn(
        "known", F.col("critical") | kind.isin(*OTHER_KNOWN_TYPES)
    )


def session_page(log: DataFrame, session: str, since: int, limit: int, limit_first: bool = True) -> DataFrame:
    """One session's events; ``limit_first`` keeps the habit of limiting before filtering."""
    if limit_first:
        return read_range(log, since, limit=limit).where(F.col("session_id") == session)
    return read_range(log.where(F.col("session_id") == session), since, limit=limit)


def recent_sessions(sessions: DataFrame, limit: int = 50) -> DataFrame:
    return sessions.orderBy(F.col("last_seq").desc(), "session_id").limit(limit)


def sessions_of(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def recent_history(log: DataFrame, turns: int = HISTORY_TURNS, scan: int | None = HISTORY_SCAN) -> DataFrame:
    """{session_id, line_no, text}: each session's newest lines, oldest first.

    ``log`` needs {session_id, seq, type, text}.  ``scan`` looks at the newest numbers only.
    """
    lines = log.where(F.col("type").isin("turn.started", "message.completed"))
    if scan is not None:
        head = log.agg(F.max("seq").alias("_head"))
        lines = attach_row(lines, head).where(F.col("seq") > F.col("_head") - scan)
    who = F.when(F.col("type") == "turn.started", "me: ").otherwise("you: ")
    newest = first_rows(lines, ["session_id"], [F.col("seq").desc()], turns * 2, "_rn")
    size = newest.groupBy("session_id").agg(F.max("_rn").alias("_n"))
    return newest.join(size, "session_id").select(
        "session_id",
        (F.col("_n") - F.col("_rn") + 1).alias("line_no"),
        F.concat(who, F.coalesce("text", F.lit(""))).alias("text"),
    )


def timeline_groups(log: DataFrame, segment: int = 65_536) -> DataFrame:
    """{first_seq, kind, ref, label, n}: runs of consecutive events of one turn, task or the system."""
    key = (
        F.when(F.coalesce("turn_id", F.lit("")) != "", F.concat(F.lit("turn:"), "turn_id"))
        .when(F.coalesce("task_id", F.lit("")) != "", F.concat(F.lit("task:"), "task_id"))
        .otherwise("system")
    )
    keyed = log.select("seq", key.alias("_key"), F.when(F.col("type") == "turn.started", field("text")).alias("_said"))
    lagged = running(keyed, [], "seq", {"_before": (F.col("_key"), "prev")}, segment)
    starts = F.when(F.col("_key").eqNullSafe(F.col("_before")), None).otherwise(F.col("seq"))
    marked = running(lagged, [], "seq", {"first_seq": (starts, "last")}, segment)
    said = F.when(F.col("_said").isNotNull(), F.col("seq"))
    ref = F.regexp_extract("_key", r"^(?:turn|task):(.*)$", 1)
    kind = F.element_at(F.split("_key", ":"), 1)
    return (
        marked.groupBy("first_seq", "_key")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("_said", said).alias("_label"))
        .select(
            "first_seq", kind.alias("kind"), F.when(kind != "system", ref).alias("ref"),
            F.when(kind == "turn", F.when(F.coalesce("_label", F.lit("")) != "", F.col("_label")).otherwise(F.concat(F.lit("turn "), ref)))
            .when(kind == "task", F.concat(F.lit("task "), ref))
            .otherwise("system").alias("label"),
            "n",
        )
    )


def filter_timeline(log: DataFrame, needle: str) -> DataFrame:
    shown = F.concat_ws(
        " ", "type", F.coalesce("trace_id", F.lit("")), F.coalesce("turn_id", F.lit("")),
        F.coalesce("task_id", F.lit("")), "payload",
    )
    return log.where(F.contains(F.lower(shown), F.lit(needle.strip().lower())))


def fold_turns(log: DataFrame) -> DataFrame:
    """{turn_id, session_id, user_text, reply, done, outcome} per started turn.

    The reply is the last completed text followed by later deltas.  Deltas that a later
    completion replaces are dropped before anything is concatenated, and the rest is joined in
    bounded runs of sequence numbers first.
    """
    kind, text = F.col("type"), F.col("_text")
    ev = log.where(
        F.col("turn_id").isNotNull()
        & kind.isin("turn.started", "message.delta", "message.completed", "turn.finished")
    ).select(
        "seq", "turn_id", "session_id", "type", field("text").alias("_text"), field("outcome").alias("_outcome")
    )
    started = ev.where(kind == "turn.started").groupBy("turn_id").agg(
        F.min("seq").alias("_start"), F.min_by("session_id", "seq").alias("session_id"),
        F.min_by("_text", "seq").alias("user_text"),
    )
    later = ev.where(kind != "turn.started").join(started.select("turn_id", "_start"), "turn_id").where("seq > _start")
    full = (kind == "message.completed") & text.isNotNull()
    closed = later.groupBy("turn_id").agg(
        F.max(F.when(full, F.col("seq"))).alias("_done_at"),
        F.max_by("_text", F.when(full, F.col("seq"))).alias("_full"),
        F.coalesce(F.bool_or(kind == "turn.finished"), F.lit(False)).alias("done"),
        F.max_by(F.coalesce("_outcome", F.lit("completed")), F.when(kind == "turn.finished", F.col("seq"))).alias("outcome"),
    )
    deltas = (
        later.where((kind == "message.delta") & text.isNotNull())
        .join(closed.select("turn_id", "_done_at"), "turn_id")
        .where(F.col("_done_at").isNull() | (F.col("seq") > F.col("_done_at")))
    )

    def glue(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, "_text")))
        return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["_text"]), "").alias(out))

    runs = glue(
        deltas.withColumn("_run", F.floor(F.col("seq") / TEXT_SEGMENT)), ["turn_id", "_run"], "seq", "_text"
    )
    tail = glue(runs, ["turn_id"], "_run", "_tail")
    return (
        started.join(closed, "turn_id", "left")
        .join(tail, "turn_id", "left")
        .select(
            "turn_id", "session_id", F.coalesce("user_text", F.lit("")).alias("user_text"),
            F.concat(F.coalesce("_full", F.lit("")), F.coalesce("_tail", F.lit(""))).alias("reply"),
            F.coalesce("done", F.lit(False)).alias("done"),
            "outcome",
        )
    )


def pair_tool_calls(log: DataFrame, segment: int = 65_536) -> DataFrame:
    """{turn_id, tool, start_seq, finish_seq, ok}: a finish closes the latest open start of its tool.

    Open calls form a stack per (turn, tool).  Its height is a running sum of +1 and -1 lifted by
    the lowest point so far (a finish that finds nothing open is ignored); a finish pairs with
    the start just before it on the same height.  ``finish_seq`` is NULL while a call runs.
    """
    calls = log.where(F.col("type").isin("tool.started", "tool.finished") & F.col("turn_id").isNotNull()).select(
        "seq", "turn_id", field("tool").alias("tool"),
        F.when(F.col("type") == "tool.started", 1).otherwise(-1).cast("long").alias("_step"),
        (F.coalesce(field("ok"), F.lit("false")) == "true").alias("ok"),
    )
    key = ["turn_id", "tool"]
    summed = running(calls, key, "seq", {"_sum": (F.col("_step"), "sum")}, segment)
    lows = running(summed, key, "seq", {"_low": (F.col("_sum"), "min")}, segment)
    real = running(lows, key, "seq", {"_was": (F.col("_low"), "prev")}, segment)
    height = F.col("_sum") - F.least(F.col("_low"), F.lit(0))
    # a finish that reaches a new low below zero found nothing open
    void = (F.col("_step") < 0) & (F.col("_sum") < F.least(F.coalesce("_was", F.lit(0)), F.lit(0)))
    real = real.withColumn("_void", void).withColumn("_h", height)
    level = F.when(F.col("_step") > 0, F.col("_h")).otherwise(F.col("_h") + 1)
    leveled = real.where(~F.col("_void")).select("seq", *key, "_step", "ok", level.alias("_level"))
    opened = F.when(F.col("_step") > 0, F.col("seq"))
    at = running(leveled, [*key, "_level"], "seq", {"_open": (opened, "last")}, segment)
    ends = at.where("_step < 0").select("turn_id", "tool", F.col("_open").alias("start_seq"), F.col("seq").alias("finish_seq"), "ok")
    begins = at.where("_step > 0").select("turn_id", "tool", F.col("seq").alias("start_seq"))
    return begins.join(ends, ["turn_id", "tool", "start_seq"], "left")


def project_tasks(log: DataFrame) -> DataFrame:
    """{root_id, task_id, kind, status, created_seq, last_seq} folded from graph task events.

    Only payloads stamped ``source = graph`` count; the first creation wins; updates of a task
    never seen created, or seen earlier than its creation, are ignored.
    """
    kind = F.col("type")
    ev = (
        log.where(kind.isin("task.created", "task.updated", "task.finished") & (F.coalesce("task_id", F.lit("")) != ""))
        .select(
            "seq", "task_id", "type", field("source").alias("_source"), field("root_id").alias("root_id"),
            field("kind").alias("kind"), field("status").alias("_status"),
        )
        .where((F.col("_source") == "graph") & (F.coalesce("root_id", F.lit("")) != ""))
    )
    key = ["root_id", "task_id"]
    created = ev.where(kind == "task.created").groupBy(*key).agg(
        F.min("seq").alias("created_seq"), F.min_by("kind", "seq").alias("kind")
    )
    changes = ev.where(kind != "task.created").join(created.select(*key, "created_seq"), key).where("seq > created_seq")
    last = changes.groupBy(*key).agg(
        F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col("seq"))).alias("_status"),
        F.max("seq").alias("last_seq"),
    )
    return created.join(last, key, "left").select(
        *key, F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("_status", F.lit("pending")).alias("status"),
        "created_seq", F.coalesce("last_seq", "created_seq").alias("last_seq"),
    )


def pending_approvals(log: DataFrame, now: Column) -> DataFrame:
    """{approval_id, seq} still open at ``now``.

    A request is cleared by a later resolution or boot; one that had already expired never
    enters, unless it waits for an answer without a clock.
    """
    boot = log.where(F.col("type") == "system.boot").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_boot"))
    ids = field("approval_id").alias("approval_id")
    asked = log.where(F.col("type") == "approval.requested").select(
        ids, "seq", "ts", field("expires_in_s").cast("double").alias("_ttl"), field("waits").alias("_waits")
    )
    alive = (F.coalesce("_waits", F.lit("false")) == "true") | (
        F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.coalesce("_ttl", F.lit(0.0)) > F.unix_micros(now) / 1e6
    )
    answered = log.where(F.col("type") == "approval.resolved").select(ids, F.col("seq").alias("_at"))
    last_answer = answered.groupBy("approval_id").agg(F.max("_at").alias("_at"))
    return (
        attach_row(asked.where(F.col("approval_id").isNotNull()), boot)
        .where((F.col("seq") > F.col("_boot")) & alive)
        .join(last_answer, "approval_id", "left")
        .where(F.col("_at").isNull() | (F.col("_at") < F.col("seq")))
        .groupBy("approval_id")
        .agg(F.min("seq").alias("seq"))
    )


def merge_health(probes: DataFrame, live: DataFrame) -> DataFrame:
    """{component, reason, origin}: a live degradation replaces the boot probe of its component."""
    bad = probes.where(~F.col("ok") | F.col("unknown")).select(
        "component", F.col("detail").alias("reason"), F.lit("probe").alias("origin"), F.lit(1).alias("_p")
    )
    now = live.select("component", "reason", F.lit("live").alias("origin"), F.lit(0).alias("_p"))
    return first_rows(now.unionByName(bad), ["component"], [F.col("_p"), F.col("reason")], 1).drop("_p")


def live_degradations(log: DataFrame) -> DataFrame:
    """The latest ``system.degraded`` of each component."""
    ev = log.where(F.col("type") == "system.degraded").select(
        "seq", F.coalesce(field("component"), F.lit("reasoning")).alias("component"), field("reason").alias("reason")
    )
    return ev.groupBy("component").agg(F.max_by("reason", "seq").alias("reason"))


def retrieval_traces(log: DataFrame) -> DataFrame:
    """{seq, tool, documents} of finished tools that cite something; documents are distinct."""
    cites = F.from_json(
        F.get_json_object("payload", "$.citations"), "array<struct<collection:string,path:string>>"
    )
    docs = F.array_distinct(F.transform("_c", lambda c: F.concat_ws("/", c["collection"], c["path"])))
    return (
        log.where(F.col("type") == "tool.finished")
        .select("seq", "ts", F.coalesce(field("tool"), F.lit("know.search")).alias("tool"), cites.alias("_c"))
        .where(F.size("_c") > 0)
        .select("seq", "ts", "tool", docs.alias("documents"))
    )
