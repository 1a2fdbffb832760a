"""Streams with state of their own shape: stacks of open tool calls, and requests that wait without a clock.

Both read rows in ``seq`` order within a batch and remember the last ``seq`` of their key, so a row that is delivered
again changes nothing.  Batches must follow the order of the log.  State is kept in RocksDB and is restored from
the checkpoint; what is kept is what is open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loreworks.operators.events import field
from loreworks.operators.scale import running

SHARDS = 64
CALLS = "turn_id string, tool string, start_seq long, finish_seq long, ok boolean"
OUTCOMES = "approval_id string, seq long, asked timestamp, outcome string, at_seq long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Spark also loads a processor in a Python process of the driver, which gets no shipped files and need not have this
# package on its path; so the classes below travel whole, instead of by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that these streams need, for those that are started inside; a running stream keeps its own."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _resolution():
    return F.coalesce(field("resolution"), F.lit("resolved"))


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key in one batch, by seq."""
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


class OpenCalls(StatefulProcessor):
    """A stack of open starts for each (turn, tool): a finish closes the latest of them."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stack = handle.getListState("open", "seq long", self.ttl_ms)
        self.last = handle.getValueState("last", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        held = [r[0] for r in self.stack.get()]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for row in _in_order(rows).itertuples(index=False):
            if last is not None and row.seq <= last:
                continue
            last = int(row.seq)
            if row.started:
                held.append(last)
                out.append((*key, last, None, None))
            elif held:
                out.append((*key, held.pop(), last, bool(row.ok)))
        if held:
            self.stack.put([(s,) for s in held])
        else:
            self.stack.clear()
        if last is not None:
            self.last.update((last,))
        frame = pd.DataFrame(out, columns=["turn_id", "tool", "start_seq", "finish_seq", "ok"])
        yield frame.astype({"start_seq": "int64", "finish_seq": "Int64", "ok": "boolean"})

    def close(self) -> None:
        pass


def tool_calls(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Updates {turn_id, tool, start_seq, finish_seq, ok}: one row when a call starts, one when it ends.

    A finish that finds nothing open gives no row.  With ``ttl_ms`` what is known of a tool in a turn is forgotten that
    long after its last event, which bounds the state of a stream that runs for ever; such a query keeps starting
    batches for the clock's sake, so it needs a periodic trigger instead of ``availableNow``.
    """
    calls = stream.where(F.col("type").isin("tool.started", "tool.finished") & F.col("turn_id").isNotNull()).select(
        "turn_id", field("tool").alias("tool"), "seq", (F.col("type") == "tool.started").alias("started"), (F.coalesce(field("ok"), F.lit("false")) == "true").alias("ok")
    )
    return calls.groupBy("turn_id", "tool").transformWithStateInPandas(OpenCalls(ttl_ms), CALLS, "Update", "None" if ttl_ms is None else "ProcessingTime")


def settle_calls(updates: DataFrame) -> DataFrame:
    """{turn_id, tool, start_seq, finish_seq, ok} from the stream's updates: the end of a call wins over its start."""
    ended = F.struct(F.col("finish_seq").isNotNull().alias("ended"), "finish_seq", "ok")
    return updates.groupBy("turn_id", "tool", "start_seq").agg(F.max(ended).alias("_e")).select("turn_id", "tool", "start_seq", "_e.finish_seq", "_e.ok")


class OpenRequests(StatefulProcessor):
    """Open requests of one shard of approval ids; a boot clears them all, an answer those of its id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "approval_id string", "seqs array<long>, asked array<long>")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        last = self.last.get()[0] if self.last.exists() else None
        out = []

        def close(name: str, outcome: str, at: int) -> None:
            seqs, asked = self.open.getValue((name,))
            out.extend((name, s, a, outcome, at) for s, a in zip(seqs, asked))
            self.open.removeKey((name,))

        for row in _in_order(rows).itertuples(index=False):
            if last is not None and row.seq <= last:
                continue
            last = int(row.seq)
            if row.type == "system.boot":
                for (name,) in list(self.open.keys()):
                    close(name, "cleared", last)
            elif row.type == "approval.requested":
                known = self.open.getValue((row.approval_id,)) if self.open.containsKey((row.approval_id,)) else ([], [])
                self.open.updateValue((row.approval_id,), ([*known[0], last], [*known[1], int(row.asked)]))
                out.append((row.approval_id, last, int(row.asked), "open", last))
            elif self.open.containsKey((row.approval_id,)):
                close(row.approval_id, row.resolution, last)
        if last is not None:
            self.last.update((last,))
        frame = pd.DataFrame(out, columns=["approval_id", "seq", "asked", "outcome", "at_seq"])
        frame["asked"] = pd.to_datetime(frame["asked"], unit="us")
        yield frame

    def close(self) -> None:
        pass


def dispatched_requests(stream: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Updates {approval_id, seq, asked, outcome, at_seq} of requests that wait without a clock.

    A request is ``open`` until its id is answered (the answer is its outcome) or the system boots (``cleared``).  Ids are
    dealt over ``shards``, and a boot, which concerns all of them, is repeated once for each shard.
    """
    ids, waits = field("approval_id"), F.coalesce(field("waits"), F.lit("false")) == "true"
    one = F.array(F.pmod(F.xxhash64(ids), F.lit(shards)))
    kind = F.col("type")
    use = stream.where((kind == "system.boot") | ids.isNotNull() & (((kind == "approval.requested") & waits) | (kind == "approval.resolved")))
    dealt = use.select(
        F.explode(F.when(kind == "system.boot", F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).otherwise(one)).alias("shard"),
        "seq", "type", ids.alias("approval_id"), _resolution().alias("resolution"), F.unix_micros(F.col("ts").cast("timestamp")).alias("asked"),
    )
    return dealt.groupBy("shard").transformWithStateInPandas(OpenRequests(), OUTCOMES, "Update", "None")


def settle_requests(updates: DataFrame) -> DataFrame:
    """{approval_id, seq, asked, outcome}: the last word on each request."""
    return updates.groupBy("approval_id", "seq").agg(F.min("asked").alias("asked"), F.max_by("outcome", F.struct(F.col("outcome") != "open", "at_seq")).alias("outcome"))


def dispatched_until_boot(log: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The same over a table: {approval_id, seq, asked, outcome} of every request that waits.

    The next boot is carried backwards along each shard of ids, so no list of boots is sent anywhere.
    """
    ids, waits = field("approval_id"), F.coalesce(field("waits"), F.lit("false")) == "true"
    shard = F.pmod(F.xxhash64(ids), F.lit(shards))
    asked = log.where((F.col("type") == "approval.requested") & ids.isNotNull() & waits).select(
        shard.alias("_shard"), "seq", ids.alias("approval_id"), F.col("ts").cast("timestamp").alias("asked")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    boots = log.where(F.col("type") == "system.boot").select(every.alias("_shard"), "seq")
    both = asked.unionByName(boots, allowMissingColumns=True).withColumn("_back", -F.col("seq"))
    booted = F.when(F.col("approval_id").isNull(), F.col("seq"))
    judged = running(both, ["_shard"], "_back", {"_boot": (booted, "last")}).where("approval_id is not null")
    answered = log.where((F.col("type") == "approval.resolved") & ids.isNotNull()).select(ids.alias("approval_id"), F.col("seq").alias("_at"), _resolution().alias("_r"))
    first = asked.select("approval_id", "seq").join(answered, "approval_id").where("_at > seq").groupBy("approval_id", "seq").agg(F.min(F.struct("_at", "_r")).alias("_a"))
    cleared = F.col("_boot").isNotNull() & (F.col("_a").isNull() | (F.col("_boot") < F.col("_a._at")))
    return judged.join(first, ["approval_id", "seq"], "left").select(
        "approval_id", "seq", "asked", F.when(cleared, "cleared").otherwise(F.coalesce("_a._r", F.lit("open"))).alias("outcome")
    )
