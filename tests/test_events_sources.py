import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loreworks.operators import corpus
from loreworks.operators import events as ev
from loreworks.operators import projects as pj
from loreworks.plans import registry
from loreworks.session import shared_dir
from loreworks.sources import files as fl
from loreworks.sources import logs, reports, tables
from loreworks.streaming import changes as ch

LOG = "seq long, ts timestamp, type string, session_id string, turn_id string, task_id string, trace_id string, payload string"


def log(spark, rows):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    full = [(s, base + timedelta(seconds=s), t, "s", turn, task, "tr", p) for s, t, turn, task, p in rows]
    return spark.createDataFrame(full, LOG)


def test_tool_pairing_is_last_in_first_out(spark):
    r = random.Random(7)
    rows_ = []
    for i in range(1, 200):
        rows_.append((i, r.choice(["tool.started", "tool.finished"]), r.choice(["t1", "t1", "t2"]), None, '{"tool":"%s","ok":true}' % r.choice("ab")))
    want, open_ = {}, {}
    for seq, kind, turn, _, p in rows_:
        stack = open_.setdefault((turn, p[9]), [])
        if kind == "tool.started":
            stack.append(seq)
            want[seq] = None
        elif stack:
            want[stack.pop()] = seq
    for segment in (5, 10_000):
        got = {x["start_seq"]: x["finish_seq"] for x in ev.pair_tool_calls(log(spark, rows_), segment).collect()}
        assert got == want


def test_turn_folding(spark):
    rows_ = [
        (1, "message.delta", "t", None, '{"text":"early"}'), (2, "turn.started", "t", None, '{"text":"hi"}'), (3, "message.delta", "t", None, '{"text":"a"}'),
        (4, "message.completed", "t", None, '{"text":"full"}'), (5, "message.delta", "t", None, '{"text":"+x"}'), (6, "message.completed", "t", None, "{bad"),
        (7, "turn.finished", "t", None, "{}"), (8, "turn.started", "u", None, "{bad"), (9, "message.delta", "u", None, '{"text":"only"}'), (10, "error", None, None, "{}"),
    ]
    got = {r["turn_id"]: r for r in ev.fold_turns(log(spark, rows_)).collect()}
    assert (got["t"]["reply"], got["t"]["outcome"], got["t"]["done"]) == ("full+x", "completed", True)
    assert (got["u"]["reply"], got["u"]["user_text"], got["u"]["done"]) == ("only", "", False)


def test_approvals_cleared_by_boot_and_answers(spark, rows):
    ask = '{"approval_id":"%s","expires_in_s":%d}'
    rows_ = [
        (1, "approval.requested", None, None, ask % ("old", 10_000_000)), (2, "system.boot", None, None, "{}"),
        (3, "approval.requested", None, None, ask % ("gone", 1)), (4, "approval.requested", None, None, '{"approval_id":"waits","waits":true}'),
        (5, "approval.requested", None, None, ask % ("live", 10_000_000)), (6, "approval.requested", None, None, ask % ("done", 10_000_000)),
        (7, "approval.resolved", None, None, '{"approval_id":"done"}'), (8, "approval.resolved", None, None, '{"approval_id":"again"}'),
        (9, "approval.requested", None, None, ask % ("again", 10_000_000)),
    ]
    got = rows(ev.pending_approvals(log(spark, rows_), F.to_timestamp(F.lit("2024-01-02T00:00:00Z"))))
    assert got == [("again", 9), ("live", 5), ("waits", 4)]


def test_task_projection_and_unknown_types(spark, rows):
    rows_ = [
        (1, "task.updated", None, "k", '{"source":"graph","root_id":"r","status":"running"}'), (2, "task.created", None, "k", '{"source":"graph","root_id":"r","kind":"tool"}'),
        (3, "task.finished", None, "k", '{"outcome":"done","root_id":"r"}'), (4, "task.finished", None, "x", '{"source":"graph","root_id":"r","status":"failed"}'),
        (5, "task.created", None, "m", '{"source":"graph","root_id":"r"}'), (6, "task.finished", None, "m", '{"source":"graph","root_id":"r","status":"timeout"}'), (7, "odd", None, None, "{}"),
    ]
    df = log(spark, rows_)
    assert rows(ev.project_tasks(df), "task_id", "status") == [("k", "pending"), ("m", "timeout")]
    kinds = {r["type"]: (r["known"], r["critical"]) for r in ev.classify_events(df).collect()}
    assert kinds["odd"] == (False, False) and kinds["task.created"] == (True, True)


def test_resync(spark):
    c = spark.createDataFrame([(1, 0), (2, 5), (3, 95), (4, 101), (5, 100)], "client long, since long")
    got = {r["client"]: (r["resync"], r["reason"], r["baseline"]) for r in ev.resync(c, spark.range(1, 101).withColumnRenamed("id", "seq"), 20).collect()}
    assert got == {1: (False, None, 0), 2: (True, "stale", 80), 3: (False, None, 95), 4: (True, "ahead", 100), 5: (False, None, 100)}


def test_cost_is_tolerant(spark):
    shapes = {
        '{"cost":{"tokens":5,"usd":1}}': (5, 1.0), '{"cost":{"tokens":5.0,"usd":0.5}}': (0, 0.5), '{"cost":{"tokens":"5","usd":"1"}}': (0, 0.0),
        "{}": (0, 0.0), "bad": (0, 0.0), '{"cost":[1]}': (0, 0.0), '{"cost":{"usd":1e-3}}': (0, 0.001),
    }
    df = spark.createDataFrame([(s,) for s in shapes] + [(None,)], "r string")
    for row in df.select("r", pj.task_cost(F.col("r")).alias("c")).collect():
        assert tuple(row["c"]) == shapes.get(row["r"], (0, 0.0))


def test_briefing_counts(spark):
    tasks = spark.createDataFrame(
        [(i, "P", s, "2024-01-01T01:00:00Z", "2024-01-01T00:00:00Z" if s == "failed" else "2024-01-01T01:00:09Z", '{"cost":{"tokens":1}}')
         for i, s in enumerate(["succeeded", "failed", "timeout", "waiting", "running", "cancelled", "skipped"])]
        + [(50, "Q", "skipped", None, None, None)],
        "id long, project string, status string, started_at string, finished_at string, result string",
    )
    got = pj.briefing_totals(tasks).collect()
    assert [r["project"] for r in got] == ["P"]
    r = got[0]
    assert (r["completed"], r["failed"], r["waiting"], r["in_flight"], r["cancelled"], r["n"], r["tokens"], r["elapsed_s"]) == (1, 2, 1, 1, 1, 7, 7, 54.0)


def test_routing(spark):
    texts = ["/status now", "/h", "/Stop it", "/staus", "СТОП!", "stop please", "Попроси Claude починить", "use the agy tool", "run nightly deploy", "nightly", "", "askclaude"]
    r = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = spark.createDataFrame([("nightly",), ("Nightly deploy",), ("light",)], "name string")
    got = {x["id"]: (x["kind"], x["command"], x["args"]) for x in pj.route_requests(r, p).collect()}
    assert got[0] == ("command", "status", "now") and got[1][1] == "help" and got[2] == ("halt", "halt", "") and got[3] == ("command", "help", "staus")
    assert got[4][0] == "halt" and got[5][0] == "none" and got[6][0] == "delegate" and got[7][0] == "delegate"
    assert got[8] == ("pipeline", "Nightly deploy", "") and got[9][1] == "nightly" and got[10][0] == "none" and got[11][0] == "none"


def test_admission_order_and_globs(spark):
    rules = fl.Rules(deny=("**/Passwords/**", "**\\*.PEM"), exclude=("*.min.js",), max_bytes=10)
    rows_ = [
        ("p", "a/passwords/x.md", 1, True, "denied"), ("p", "k/a.pem", 1, True, "denied"), ("p", "a.MIN.js", 1, True, "excluded"), ("p", "u.py", 1, True, "untracked"),
        ("p", "t.bin", 1, True, "wrong_type"), ("p", "t.py", 1, False, "unreadable"), ("p", "t.md", 11, True, "too_large"), ("q", "any.md", 1, True, "admitted"),
    ]
    df = spark.createDataFrame([(a, b, "/r/" + b, c, d, e) for a, b, c, d, e in rows_], "project string, rel_path string, path string, size long, readable boolean, want string")
    listing = spark.createDataFrame([("p", "t.bin"), ("p", "t.py"), ("p", "t.md")], "project string, rel_path string")
    for r in fl.admit_files(df, rules, listing).collect():
        assert r["verdict"] == r["want"], r


def test_scan_and_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\n\ntwo\n")
    found, missing = fl.scan_files(spark, [str(tmp_path), str(tmp_path / "nope")])
    assert [(r["rel_path"], r["size"], bytes(r["content"])) for r in found.collect()] == [("a/x.txt", 9, b"one\n\ntwo\n")]
    assert missing == [str(tmp_path / "nope")]
    big = tmp_path / "big.log"
    big.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = logs.read_lines(spark, str(big)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["raw"] for r in got] == [f"line {i}" for i in range(5000)]
    assert len({r["line_no"] for r in got}) == 5000


def test_yaml_cases(spark, tmp_path, rows):
    path = tmp_path / "cases.yaml"
    path.write_text("cases:\n  - {id: a, q: what, kind: lexical, expect_any: [x.md, y.md]}\n")
    assert rows(logs.load_cases(spark, str(path)), "qid", "expected") == [("a", "x.md"), ("a", "y.md")]


def test_index_table_keeps_the_latest_version(spark, rows):
    """Random batches against a dictionary, through merges and compactions."""
    rng = random.Random(4)
    table = tables.IndexTable(spark, shared_dir(spark) + "/index-test", bucket_keys=3)
    held: dict[int, list[str]] = {}
    for n in range(14):
        new = {rng.randrange(12): [f"{n}-{k}" for k in range(rng.randint(1, 2))] for _ in range(rng.randint(0, 2))}
        gone = [i for i in range(12) if rng.random() < 0.1]
        frame = spark.createDataFrame([(i, v) for i, vs in new.items() for v in vs], "doc_id long, body string")
        assert table.append(frame, spark.createDataFrame([(i,) for i in gone], "doc_id long"), tag=f"t/{n}")
        assert not table.append(frame, tag=f"t/{n}")  # a replay
        for i in gone:
            held.pop(i, None)
        held |= new
        if n in (3, 8, 13):
            want = sorted((i, v) for i, vs in held.items() for v in vs)
            assert rows(table.read(), "doc_id", "body") == want
            some = spark.createDataFrame([(1,), (5,), (7,), (99,)], "doc_id long")
            assert rows(table.lookup(some), "doc_id", "body") == [x for x in want if x[0] in (1, 5, 7)]
        if n == 6:
            table.compact()
    base, deltas = table.snapshot()
    assert base is not None and len(deltas) <= tables.MAX_DELTAS + 1
    table.vacuum()
    assert rows(table.read(), "doc_id", "body") == want


def test_index_table_writes_in_proportion_to_the_batch(spark, rows):
    table = tables.write_index(spark.range(5000).selectExpr("id AS doc_id", "'x' AS body"), shared_dir(spark) + "/index-big", bucket_keys=100)
    assert table.snapshot()[0].buckets == 64
    table.append(spark.createDataFrame([(7, "y")], "doc_id long, body string"), spark.createDataFrame([(8,)], "doc_id long"))
    base, deltas = table.snapshot()
    assert base.version == 1 and [d.keys for d in deltas] == [2]
    found = table.lookup(spark.createDataFrame([(7,), (8,), (9,)], "doc_id long"))
    assert rows(found, "doc_id", "body") == [(7, "y"), (9, "x")]
    assert table.read().count() == 4999


def test_index_table_emptied_and_a_failed_write(spark, rows):
    path = shared_dir(spark) + "/index-empty"
    table = tables.write_index(spark.createDataFrame([("aa", "x"), ("ff", "y")], "h string, body string"), path, "h", by_prefix=True)
    spark.createDataFrame([("aa", "never committed")], "h string, body string").write.parquet(f"{path}/delta-2-2/rows")
    assert rows(table.read(), "h", "body") == [("aa", "x"), ("ff", "y")]
    table.append(spark.createDataFrame([], "h string, body string"), spark.createDataFrame([("aa",), ("ff",)], "h string"))
    assert table.read().columns == ["h", "body"] and table.read().count() == 0
    table.append(spark.createDataFrame([("bb", "z")], "h string, body string"))
    assert rows(table.read(), "h", "body") == [("bb", "z")]


def test_guard_refuses_another_model(spark):
    meta = spark.createDataFrame([("model", "a"), ("dim", "64")], "key string, value string")
    corpus.require_compatible(meta, {"model": "a", "dim": "64", "chunker": "2"})
    with pytest.raises(corpus.IncompatibleIndex):
        corpus.require_compatible(meta, {"model": "b"})


def test_incremental_reindex_equals_a_rebuild(spark, rows):
    root = shared_dir(spark) + "/reindex-test"
    cols = "doc_id long, collection string, project string, rel_path string, kind string, text string, deleted boolean"
    body = "some words to keep " * 10
    ch.create_index(spark, root)

    def embed(frames):
        for pdf in frames:
            pdf["vec"] = [[float(len(x))] for x in pdf["text"]]
            yield pdf[["text_hash", "vec"]]

    def apply(*docs, tag=""):
        changes = spark.createDataFrame([(i, "c", "p", f"d{i}.txt", "text", t, t is None) for i, t in docs], cols)
        return rows(ch.reindex_batch(changes, root, embed, tag=tag))

    assert apply((1, body), (2, body + "two")) == [("new", 2)]
    assert apply((1, body), (2, body + "changed"), (3, body), tag="b1") == [("changed", 1), ("new", 1), ("unchanged", 1)]
    assert apply((1, body), (2, body + "changed"), (3, body), tag="b1") == [("unchanged", 3)]
    assert apply((1, None)) == [("removed", 1)]
    hashes, chunks, vectors = ch.index_tables(spark, root)
    assert rows(chunks.read(), "doc_id", "text") == [(2, "p / d2.txt\n\n" + body + "changed"), (3, "p / d3.txt\n\n" + body)]
    assert rows(hashes.read(), "doc_id") == [(2,), (3,)]
    assert rows(ch.chunk_vectors(spark, root), "doc_id", "vec") == [(2, [len("p / d2.txt\n\n" + body + "changed")]), (3, [len("p / d3.txt\n\n" + body)])]
    assert vectors.read().count() == 4
    ch.drop_unused_vectors(spark, root)
    assert vectors.read().count() == 2 and ch.chunk_vectors(spark, root).count() == 2


def test_fingerprint_tree_is_renewed_along_changed_paths(spark):
    texts = {i: f"text {i}" for i in range(200) if i % 7}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "ordinal long, text string")
    tree = corpus.FingerprintTree(spark, shared_dir(spark) + "/tree-test", fan=4, height=4)
    tree.build(frame(texts))
    whole = lambda d: corpus.fingerprint(frame(d), "m", fan=4, height=4).first()[0]
    assert tree.digest("m").first()[0] == whole(texts)
    for changed, removed in (({5: "new", 199: "last", 7: "put in"}, [1, 2, 3, 100]), ({}, [4, 5, 6, 7]), ({6: "back"}, [])):
        texts = {i: t for i, t in texts.items() if i not in removed} | changed
        gone = spark.createDataFrame([(i,) for i in removed], "ordinal long")
        tree.renew(frame(changed) if changed else frame({0: ""}).limit(0), gone)
        assert tree.digest("m").first()[0] == whole(texts)


def test_fingerprint_of_large_ids(spark, tmp_path):
    frame = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "ordinal long, text string")
    with pytest.raises(Exception, match="too low"):
        corpus.fingerprint(frame(1, 256), "m", fan=4, height=4).first()
    docs = str(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT doc_id * 1000 AS doc_id, * EXCLUDE doc_id FROM '/root/testdata/sf0.001/documents.parquet') TO '{docs}'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs}'")
    for name in ("c25_fingerprint", "c25_fingerprint_renewed"):
        got = registry.queries()[name](spark, str(tmp_path)).collect()
        assert [tuple(r) for r in got] == con.sql(registry.twins()[name]).fetchall()


def test_report_details(spark):
    long = "m" * 700
    junit = [
        ("a", '<testsuites><testsuite tests="3" failures="2" errors="1" skipped="0" time="1.5"><testcase classname="m.C" name="x"><failure message="bad &lt;1&gt;">trace</failure><error message="">text only</error></testcase>'
              f'<testcase name="y"><failure>{long}</failure></testcase><testcase name="z"/></testsuite><testsuite tests="1" time="0.25"/></testsuites>'),
        ("b", '<testsuite tests="1" failures="0" errors="0" skipped="1" time="2"><testcase name="q"/></testsuite>'),
        ("c", "no xml"),
    ]
    frame = lambda rows: spark.createDataFrame(rows, "run string, raw string")
    got = {r.run: r for r in reports.parse_junit(frame(junit)).collect()}
    assert [tuple(d) for d in got["a"].details] == [("m.C::x", "bad <1>"), ("m.C::x", "text only"), ("y", long[:500])]
    assert got["a"].failures == ["m.C::x", "m.C::x", "y"] and got["a"].duration_s == 1.75 and got["b"].duration_s == 2.0
    js = [
        ("a", '{"numPassedTests":1,"numFailedTests":2,"startTime":1000,"endTime":3500,"testResults":[{"assertionResults":[{"status":"failed","fullName":"f g","failureMessages":["first","second"]},'
              '{"status":"failed","title":"t"},{"status":"passed","title":"p"}]}]}'),
        ("b", '{"numPassedTests":1,"startTime":5000,"endTime":1}'), ("c", '{"numPassedTests":1}'),
    ]
    got = {r.run: r for r in reports.parse_js_json(frame(js)).collect()}
    assert [tuple(d) for d in got["a"].details] == [("f g", "first"), ("t", "")]
    assert [got[k].duration_s for k in "abc"] == [2.5, 0.0, 0.0]
    cargo = reports.parse_cargo(frame([("a", "test result: FAILED. 1 passed; 1 failed; 0 ignored\nfailures:\n    m::t\n")])).first()
    assert [tuple(d) for d in cargo.details] == [("m::t", "see the log for the assertion")] and cargo.duration_s == 0.0
