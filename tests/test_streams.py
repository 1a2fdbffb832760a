"""Streams with state: stopped and started again, against plain Python."""

import os
import random
import subprocess
import sys
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loreworks.operators import events as ev
from loreworks.plans import registry
from loreworks.session import shared_dir
from loreworks.streaming import changes as ch
from loreworks.streaming import late
from loreworks.streaming import state as st
from loreworks.streaming import stateful as sf

LOG = "seq long, ts timestamp, type string, session_id string, turn_id string, task_id string, trace_id string, payload string"
BASE = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(s, BASE + timedelta(seconds=s), kind, "s", turn, None, "t", payload) for s, kind, turn, payload in rows], LOG)


def in_parts(spark, name, parts, start):
    """Each part is a batch of its own, and the stream is restarted before it."""
    feed = f"{shared_dir(spark)}/{name}-feed"
    for part in parts:
        part.write.mode("append").parquet(feed)
        start(spark.readStream.schema(part.schema).parquet(feed)).awaitTermination()


def test_tool_calls_across_restarts(spark, rows):
    rng = random.Random(3)
    events = [
        (s, rng.choice(["tool.started", "tool.finished"]), rng.choice(["a", "b", None]), '{"tool":"%s","ok":%s}' % (rng.choice("xy"), rng.choice(["true", "false"])))
        for s in range(1, 121)
    ]
    stacks, want = defaultdict(list), {}
    for s, kind, turn, payload in events:
        key = turn, payload[9]
        if turn is None:
            continue
        if kind == "tool.started":
            stacks[key].append(s)
            want[(*key, s)] = (None, None)
        elif stacks[key]:
            want[(*key, stacks[key].pop())] = (s, "true" in payload)
    whole = log(spark, events)
    out = shared_dir(spark) + "/calls-test"
    again = whole.where("seq between 30 and 80")  # delivered twice
    in_parts(spark, "calls", [whole.where("seq <= 40"), whole.where("seq between 41 and 80"), again, whole.where("seq > 80")],
             lambda s: st.run_updates(sf.tool_calls(s), out, out + "-state"))
    got = {(r.turn_id, r.tool, r.start_seq): (r.finish_seq, r.ok) for r in sf.settle_calls(spark.read.parquet(out)).collect()}
    assert got == want
    assert {(r.turn_id, r.tool, r.start_seq): (r.finish_seq, r.ok) for r in ev.pair_tool_calls(whole, segment=7).collect()} == want


def test_requests_without_a_clock_across_restarts(spark):
    rng = random.Random(8)
    ask, answer = '{"approval_id":"%s","waits":%s}', '{"approval_id":"%s","resolution":"%s"}'
    events = []
    for s in range(1, 151):
        name, kind = f"a{rng.randrange(8)}", rng.random()
        if kind < 0.5:
            events.append((s, "approval.requested", None, ask % (name, rng.choice(["true", "true", "false"]))))
        elif kind < 0.95:
            events.append((s, "approval.resolved", None, answer % (name, rng.choice(["approved", "denied"]))))
        else:
            events.append((s, "system.boot", None, "{}"))
    events.append((151, "approval.resolved", None, '{"approval_id":"a1"}'))
    events.append((152, "approval.resolved", None, "broken"))
    want, open_ = {}, defaultdict(list)
    for s, kind, _, payload in events:
        name = payload[16:18]
        if kind == "system.boot":
            for n, seqs in open_.items():
                want |= {(n, q): "cleared" for q in seqs}
            open_.clear()
        elif kind == "approval.requested" and '"waits":true' in payload:
            open_[name].append(s)
            want[name, s] = "open"
        elif kind == "approval.resolved":
            said = "approved" if "approved" in payload else "denied" if "denied" in payload else "resolved"
            want |= {(name, q): said for q in open_.pop(name, [])}
    whole = log(spark, events)
    out = shared_dir(spark) + "/requests-test"
    in_parts(spark, "requests", [whole.where("seq <= 60"), whole.where("seq between 61 and 110"), whole.where("seq between 50 and 110"), whole.where("seq > 110")],
             lambda s: st.run_updates(sf.dispatched_requests(s, 3), out, out + "-state"))
    assert {(r.approval_id, r.seq): r.outcome for r in sf.settle_requests(spark.read.parquet(out)).collect()} == want
    assert {(r.approval_id, r.seq): r.outcome for r in sf.dispatched_until_boot(whole, 3).collect()} == want
    assert set(want.values()) == {"open", "cleared", "approved", "denied", "resolved"}


def test_late_rows_are_set_aside_and_on_time_results_stay(spark, rows):
    def part(*minutes):
        return spark.createDataFrame([(i, BASE + timedelta(minutes=m) if m is not None else None, f"t{m}") for i, m in enumerate(minutes)], "id long, ts timestamp, type string")

    parts = [part(0, 5, 30), part(1, 12, 25, 60, None), part(3, 49, 51, 61), part(2, 200), part(189, 191)]
    out = shared_dir(spark) + "/late-test"
    in_parts(spark, "late", parts, lambda s: late.route_late(s, out, out + "-state", delay_s=600, width_s=600))
    got = sorted((r.batch, r.type) for r in late.late_rows(spark, out).collect())
    # windows of ten minutes end at 10, 20 ...; watermarks before the batches: none, 20, 50, 51, 190
    assert got == [(1, "t1"), (1, "t12"), (2, "t3"), (2, "t49"), (3, "t2"), (4, "t189")]
    census = {r.batch: (r.on_time, r.late, r.worst_s) for r in late.late_census(spark, out).collect()}
    assert census == {0: (3, 0, None), 1: (3, 2, 19 * 60.0), 2: (2, 2, 47 * 60.0), 3: (1, 1, 49 * 60.0), 4: (1, 1, 60.0)}

    # what a windowed aggregate gives is the same with the router before it
    direct, routed = shared_dir(spark) + "/late-direct", shared_dir(spark) + "/late-routed"
    write = lambda s, to: s.writeStream.format("parquet").option("path", to).option("checkpointLocation", to + "-state").trigger(availableNow=True).start()
    in_parts(spark, "late-a", parts, lambda s: write(ch.event_rates(s, "10 minutes", "10 minutes"), direct))
    kept = [late.on_time_rows(spark, out).where(F.col("batch") == k).drop("batch") for k in range(5)]
    in_parts(spark, "late-b", kept, lambda s: write(ch.event_rates(s, "10 minutes", "10 minutes"), routed))
    assert rows(spark.read.parquet(direct)) == rows(spark.read.parquet(routed))

    # a batch that is replayed gives the same files
    late.route_batch(parts[2], 2, out, "ts", 600, 600)
    assert sorted((r.batch, r.type) for r in late.late_rows(spark, out).collect()) == got


def test_processors_load_without_the_package(tmp_path):
    payload = tmp_path / "processors"
    payload.write_bytes(cloudpickle.dumps((sf.OpenCalls(None), sf.OpenRequests())))
    code = "import sys; from pyspark import cloudpickle; print([type(p).__name__ for p in cloudpickle.loads(open(sys.argv[1], 'rb').read())])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(payload)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "['OpenCalls', 'OpenRequests']", done.stderr


def test_state_store_is_set_for_the_start_only(spark):
    before = spark.conf.get(sf.PROVIDER, None)
    spark.conf.set(sf.PROVIDER, "other")
    try:
        with sf.rocksdb(spark):
            assert spark.conf.get(sf.PROVIDER) == sf.ROCKS
        assert spark.conf.get(sf.PROVIDER) == "other"
    finally:
        spark.conf.set(sf.PROVIDER, before)


def test_late_rows_of_fractions_of_a_millisecond(spark, tmp_path):
    con = duckdb.connect()
    stamp = "date_trunc('milliseconds', ts) + INTERVAL 600 MICROSECOND"
    con.execute(f"COPY (SELECT * REPLACE ({stamp} AS ts) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = registry.queries()["w09_late_rows"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.twins()['w09_late_rows']}) q").fetchall()
    assert want and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sessions_of_a_hot_key_are_merged_before_the_exchange(spark):
    rng = random.Random(12)
    at = sorted(rng.sample(range(40_000), 600))
    events = [(BASE + timedelta(seconds=s), "hot", f"p{rng.randrange(9)}") for s in at]
    want, last = [], None
    for ts, _, path in events:
        if last is None or ts - last >= timedelta(seconds=120.5):
            want.append((ts, set()))
        want[-1][1].add(path)
        last = ts
    want = [(start, len(paths)) for start, paths in want]
    feed = shared_dir(spark) + "/hot-feed"
    frame = spark.createDataFrame(events, "ts timestamp, collection string, rel_path string")
    frame.repartition(4).write.parquet(feed)
    spark.createDataFrame([(BASE + timedelta(days=9), "end", "")], frame.schema).write.mode("append").parquet(feed)
    before = spark.conf.get(ch.MERGE_EARLY, None)
    with ch.merged_early(spark):
        stream = ch.quiet_batches(spark.readStream.schema(frame.schema).parquet(feed), "120500 milliseconds")
        query = (
            stream.select("start", F.size("paths").alias("n")).writeStream.format("parquet").option("path", feed + "-out")
            .option("checkpointLocation", feed + "-state").outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert spark.conf.get(ch.MERGE_EARLY, None) == before
    got = sorted((r.start, r.n) for r in spark.read.parquet(feed + "-out").collect())
    assert got == want and len(want) > 10
    updated = max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress)
    assert updated <= len(want) + 1
    assert query._jsq.explainInternal(False).split("== Physical Plan ==")[-1].count("MergingSessions") == 2
