import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreworks.operators import corpus, evaluation, knn, lexical
from loreworks.operators import retrieval as rt

TEXTS = ["the cat sat on the mat", "the dog ate the cat", "a tokenService refresh call", "the the the", "", "dog dog dog cat"]


def chunks(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")


def brute_bm25(texts, question):
    bags = [t.lower().split() for t in texts]
    avg = sum(map(len, bags)) / len(bags)
    out = {}
    for i, bag in enumerate(bags):
        tf, score = Counter(bag), 0.0
        for term in set(question.lower().split()):
            df = sum(term in b for b in bags)
            if df and tf[term]:
                idf = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                score += idf * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(bag) / avg))
        if score > 0:
            out[i] = round(score, 6)
    return out


def test_bm25_matches_brute_force_on_every_path(spark):
    texts = [t.lower().replace("tokenservice", "token") for t in TEXTS]
    q = spark.createDataFrame([(1, "dog cat"), (2, "the zebra"), (3, "zebra")], "qid long, text string")
    docs = chunks(spark, texts)
    terms = lexical.question_terms(q)
    hits = lexical.term_hits(docs, terms)
    for small in (100, 0):
        got = lexical.ranked(lexical.bm25_scores(terms, hits, small=small), 10).collect()
        for qid, text in [(1, "dog cat"), (2, "the zebra"), (3, "zebra")]:
            assert {r["chunk_id"]: r["score"] for r in got if r["qid"] == qid} == brute_bm25(texts, text)
    stored = lexical.bm25_from_index(q, *lexical.build_postings(docs), 10)
    assert {(r["qid"], r["chunk_id"], r["score"]) for r in stored.collect()} == {(r["qid"], r["chunk_id"], r["score"]) for r in got}


def test_best_chunks_by_score_bounds_equal_all_scores(spark, monkeypatch):
    """Blocks of few chunks, copies that tie, common and rare words, a scope, and the path without bags."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)]
    texts += [texts[3]] * 60 + ["", " "]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(90, texts[3]), (91, "nowhere"), (92, "")]
    q = spark.createDataFrame(asked, "qid long, text string")
    docs = chunks(spark, texts).withColumn("text", F.when(F.length("text") > 1, F.col("text")))
    terms = lexical.question_terms(q)
    every = {i: brute_bm25(texts, text) for i, text in asked}

    def best(found, allowed=lambda i: True):
        want = {i: sorted(((-s, c) for c, s in scores.items() if allowed(c)))[:7] for i, scores in every.items()}
        got = {i: [] for i, _ in asked}
        for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
            got[r.qid].append((-r.score, r.chunk_id))
        return got == want

    hits = lexical.term_hits(docs, terms)
    assert hits.bags is not None and best(lexical.bm25_best(terms, hits, 7))
    assert best(lexical.bm25_best(terms, hits, 7, small=3))
    assert best(lexical.bm25_best(terms, lexical.term_hits(docs, terms, limit=10), 7))
    assert best(lexical.bm25_best(terms, hits, 7, chunks=docs.where("chunk_id % 3 = 0")), lambda i: i % 3 == 0)
    index = lexical.build_postings(docs)
    assert best(lexical.bm25_from_index(q, *index, 7)) and best(lexical.bm25_from_index(q, *index, 7, limit=10))
    named = docs.select(F.format_string("c%05d", "chunk_id").alias("chunk_id"), "text")
    by_name = lexical.bm25_best(terms, lexical.term_hits(named, terms), 7).withColumn("chunk_id", F.expr("cast(substr(chunk_id, 2) as long)"))
    assert best(by_name)


def test_bounds_leave_out_chunks_that_cannot_be_among_the_best():
    lists = {0: (np.arange(0, 1000), np.full(1000, 1.0)), 1: (np.array([5, 700]), np.array([2.0, 2.0])), 2: (np.array([5]), np.array([2.0]))}
    read = []
    here, score = lexical.max_score(np.array([0, 1, 2]), np.array([0.1, 3.0, 3.0]), lambda t: read.append(t) or lists[t], 6.05)
    assert here.tolist() == [5, 700] and score.round(6).tolist() == [12.1, 6.1]


def test_gate(spark):
    docs = [f"common word{i} the" for i in range(60)] + ["редкий термин common the"]
    q = spark.createDataFrame(
        [(1, "word3 word4"), (2, "common the"), (3, "zebra unknown"), (4, "редкий word5 common"), (5, "редкий")], "qid long, text string"
    )
    c = chunks(spark, docs)
    hits = lexical.term_hits(c, lexical.question_terms(q))
    got = lexical.gate_terms(q, hits.df, corpus.script_census(c))
    # 4: one of three answerable terms survives (a third of the question): closed
    assert sorted((r["qid"], r["term"]) for r in got.collect()) == [(1, "word3"), (1, "word4")]
    unknown = corpus.script_census(c).withColumn("cyrillic", F.lit(None).cast("long"))
    assert (5, "редкий") in {(r["qid"], r["term"]) for r in lexical.gate_terms(q, hits.df, unknown).collect()}


def test_identifier_is_found_by_its_part(spark):
    c = spark.createDataFrame([(1, "uses entitlementGuard here", "anchor")], "chunk_id long, text string, anchor string")
    q = spark.createDataFrame([(1, "entitlement")], "qid long, text string")
    assert lexical.bm25_topk(q, lexical.searchable_text(c), 5, text="searchable").count() == 1


@pytest.mark.parametrize("unit", [True, False])
def test_knn_paths_match_brute_force(spark, unit):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 6))
    v[40:80] = v[0]  # a third of the rows are copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if not unit:  # other lengths, and zero vectors
        v *= (np.arange(len(v)) % 4)[:, None] * 3.0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    q = df.withColumnRenamed("id", "qid")
    sims = np.round(v @ v.T, 6)
    for floor in (None, 0.6):
        want = set()
        for i in range(len(v)):
            order = sorted((j for j in range(len(v)) if j != i and (floor is None or sims[i, j] >= floor)), key=lambda j: (-sims[i, j], j))
            want |= {(i, j, r + 1) for r, j in enumerate(order[:5])}
        for opts in ({}, {"small": 0, "block": 16}, {"small": 0, "block": 1000}):
            got = knn.knn_topk(q, df.repartition(3), 5, skip_self=True, floor=floor, **opts)
            assert {(r["qid"], r["id"], r["rank"]) for r in got.collect()} == want


def test_knn_blocks_are_not_copied_by_pair(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(90, 5))
    v[20:60] = v[0]
    names = [f"d{i:03}" for i in range(90)]
    df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in zip(names, v)], "id string, vec array<double>")
    got = knn.knn_topk(df.withColumnRenamed("id", "qid"), df, 3, skip_self=True, small=0, block=2)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    sims = np.round(v @ v.T, 6)
    want = {(names[i], names[j]) for i in range(90) for j in sorted((j for j in range(90) if j != i), key=lambda j: (-sims[i, j], j))[:3]}
    assert {(r["qid"], r["id"]) for r in got.collect()} == want


def test_knn_distance_metric(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, vec array<double>")
    q = df.withColumnRenamed("id", "qid")
    for opts in ({}, {"small": 0, "block": 4}):
        got = knn.knn_topk(q, df, 2, skip_self=True, metric="distance", **opts).where("qid = 10").collect()
        assert {(r["id"], r["sim"]) for r in got} == {(9, -1.0), (11, -1.0)}


def test_fusion_boosts_and_diversity(spark):
    dense = spark.createDataFrame([(1, i, i) for i in range(1, 7)], "qid long, id long, rank long")
    words = spark.createDataFrame([(1, 7, 1), (1, 1, 2)], "qid long, id long, rank long")
    got = {r["id"]: (r["score"], r["first_seen"]) for r in rt.rrf([(dense, 1.0), (words, 0.5)]).collect()}
    assert got[1] == (round(1 / 61 + 0.5 / 62, 12), 1) and got[7] == (round(0.5 / 61, 12), 2 - 1 + 1_000_000)
    stamps = {1: "2024-01-13T00:00:00Z", 2: "2024-01-12T00:00:00Z", 3: "2024-02-01T00:00:00Z", 4: "bad", 5: "2024-01-12T00:00:01Z"}
    hits = spark.createDataFrame(
        [(1, i, 1.0, "P" if i == 4 else "Q", "Intro" if i == 2 else "", s, f"f{i % 2}") for i, s in stamps.items()],
        "qid long, id long, score double, project string, anchor string, indexed_at string, rel_path string",
    )
    q = spark.createDataFrame([(1, "the INTRO please", "P")], "qid long, text string, project string")
    boosted = rt.boost(hits, q, F.to_timestamp(F.lit("2024-01-20T00:00:00Z")))
    scores = {r["id"]: r["score"] for r in boosted.collect()}
    assert scores == {1: 1.15, 2: 1.2, 3: 1.15, 4: 1.3, 5: 1.15}  # 2: eight whole days old; 5: a second less
    top = rt.diversify(boosted, per_file=1, limit=8).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in top] == [(4, 1), (1, 2)]


def test_usable_translation(spark):
    rows = [("ok",), ("",), (" ",), ("по-русски",), ("x" * 401,), (None,)]
    got = spark.createDataFrame(rows, "t string").select(F.coalesce(rt.usable_translation(F.col("t")), F.lit(False)).alias("u")).collect()
    assert [r["u"] for r in got] == [True, False, False, False, False, False]


def test_global_search_is_literal(spark):
    t = spark.createDataFrame([(1, "100% done", "a", 1), (2, "100 done", "b", 2), (3, "a_b", "c", 3), (4, "axb", "d", 4)], "id long, text string, label string, sort long")
    q = spark.createDataFrame([(1, "100%"), (2, "A_B"), (3, "x")], "qid long, q string")
    got = rt.global_search(q, {"g": t}).collect()
    assert sorted((r["qid"], r["id"]) for r in got) == [(1, "1"), (2, "3")]


def test_latency_p95_is_an_index_pick(spark):
    r = random.Random(2)
    for n in (1, 2, 19, 20, 21, 100):
        values = [float(r.randint(0, 30)) for _ in range(n)]
        df = spark.createDataFrame([("c", v) for v in values], "by string, ms double")
        got = evaluation.latency_stats(df, ["by"]).first()
        s = sorted(values)
        assert (got["p95"], got["min"], got["n"]) == (s[min(n - 1, int(0.95 * n))], s[0], n)
        assert got["p50"] == float(np.median(values))


def test_recall_counts_files_not_chunks(spark):
    ranked = spark.createDataFrame(
        [("a", 1, f"f{i // 3}", i + 1) for i in range(12)] + [("a", 2, "zzz", 1)], "arm string, qid long, path string, rank long"
    )
    cases = spark.createDataFrame([(1, "k", "f1"), (2, "k", "nope")], "qid long, kind string, expected string")
    got = {(r["kind"], r["k"]): r["recall"] for r in evaluation.recall(ranked, cases).collect()}
    assert got[("*", 1)] == 0.0 and got[("*", 5)] == 0.5 and got[("k", 10)] == 0.5
    assert [r["qid"] for r in evaluation.misses(ranked, cases).collect()] == [2]


def test_sample_keeps_answers_and_repeats(spark):
    c = spark.range(100).withColumnRenamed("id", "chunk_id")
    a = spark.range(5).withColumnRenamed("id", "chunk_id")
    one = {r[0] for r in evaluation.sample_keeping(c, a, 20, 7).collect()}
    two = {r[0] for r in evaluation.sample_keeping(c.repartition(9), a, 20, 7).collect()}
    assert one == two and len(one) == 20 and set(range(5)) <= one


def test_order_statistics_with_an_outlier_and_repeated_values(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(500)] + [1e12] + [0.25] * 200 + [-1e9]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 3.0)], "by string, ms double")
    got = {r["by"]: r for r in evaluation.latency_stats(df, ["by"]).collect()}
    ordered = sorted(values)
    n = len(ordered)
    assert got["a"]["p50"] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert got["a"]["p95"] == ordered[min(n - 1, int(0.95 * n))] and got["a"]["min"] == -1e9
    assert got[None]["n"] == 1 and got[None]["p50"] == 3.0


class _Inline:
    """Stands for a DataFrame; keeps the function that would run in the workers."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):  # noqa: N802 - name of the interface
        return run


def test_a_scan_for_many_queries_stays_small(spark):
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(27)
    q, v = rng.normal(size=(2_000, 8)), rng.normal(size=(10_000, 8))
    run = knn._scan(list(zip(range(len(q)), q.tolist())), _Inline(spark), 3, False, None, "cosine", None)
    whole = pd.DataFrame({"id": np.arange(len(v)), "vec": list(v)})
    tracemalloc.start()
    got = pd.concat(run(iter([whole[:6_000], whole[6_000:]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = np.round(q @ v.T, 6)
    want = np.sort(sims, axis=1)[:, -3:]
    found = np.sort(got.sort_values(["qid", "sim"])["sim"].to_numpy().reshape(-1, 3), axis=1)
    assert np.allclose(found, want) and np.allclose(sims[got["qid"], got["id"]], got["sim"])
    assert peak < 100e6, peak  # all products of a batch at once take 96 MB and several copies


def test_tokens_are_counted_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "TOKENS", 10)
    bags = [["a"] * n for n in (0, 3, 4, 25, 0, 9, 9, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bags))), pa.array(bags, pa.list_(pa.string()))], ["chunk_id", "bag"])
    parts = list(lexical._some_tokens(batch))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 3
    assert all(p.num_rows == 1 or sum(len(b or ()) for b in p["bag"].to_pylist()[1:]) <= 10 for p in parts)
    counted = pa.Table.from_batches(lexical._count_words(pa.array(["a"]))(iter([batch])))
    assert counted["len"].to_pylist() == [len(b or ()) for b in bags]
    assert [sum(t) for t in counted["tfs"].to_pylist()] == [len(b or ()) for b in bags]
