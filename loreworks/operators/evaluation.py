"""Scoring retrieval, classifiers and latency: conditional aggregates over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreworks.operators.scale import attach_row, contains_join, dense_number, first_rows
from loreworks.session import save_point

RECALL_GATE = 0.80
NEGLIGIBLE_SHARE, MARGINAL_SHARE = 0.02, 0.15


def ranked_files(ranked: DataFrame, kmax: int) -> DataFrame:
    """{arm, qid, path, file_rank}: distinct files in rank order, cut at ``kmax``."""
    best = ranked.groupBy("arm", "qid", "path").agg(F.min("rank").alias("_r"))
    return first_rows(best, ["arm", "qid"], [F.col("_r")], kmax, "file_rank").drop("_r")


def drop_answer_key(ranked: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Rankings without the documents that hold the answers to the test itself."""
    hidden = F.lit(False)
    for p in prefixes:
        hidden = hidden | F.col("path").startswith(p)
    return ranked.where(~hidden)


def first_hit(ranked: DataFrame, cases: DataFrame, kmax: int) -> DataFrame:
    """{arm, qid, kind, found}: best file rank that matches an expected source, or NULL.

    ``cases`` is {qid, kind, expected} with one row per accepted source; a file matches when
    its path contains one.
    """
    files = ranked_files(ranked, kmax)
    hits = (
        files.join(cases.select("qid", "expected"), "qid")
        .where(F.contains(F.col("path"), F.col("expected")))
        .groupBy("arm", "qid")
        .agg(F.min("file_rank").alias("found"))
    )
    each = cases.select("qid", "kind").distinct()
    # every case counts for every arm, found or not
    arms = ranked.agg(F.collect_set("arm").alias("_arms"))
    named = attach_row(each, arms).select("qid", "kind", F.explode("_arms").alias("arm"))
    return named.join(hits, ["arm", "qid"], "left").select("arm", "qid", "kind", "found")


def recall(ranked: DataFrame, cases: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """{arm, kind, k, recall, n}; kind ``*`` is all cases together."""
    found = first_hit(ranked, cases, max(ks))
    both = found.unionByName(found.withColumn("kind", F.lit("*")))
    per_k = both.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    return per_k.groupBy("arm", "kind", "k").agg(
        (F.count_if(F.col("found") <= F.col("k")) / F.count(F.lit(1))).alias("recall"),
        F.count(F.lit(1)).alias("n"),
    )


def misses(ranked: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    return first_hit(ranked, cases, k).where("found IS NULL").select("arm", "qid")


def split_reachable(cases: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with at least one expected source in the corpus, and the others."""
    wanted = cases.select("expected").distinct()
    present = contains_join(files.select("path").distinct(), wanted, "path", "expected").select("expected").distinct()
    ok = cases.join(present, "expected", "left_semi").select("qid").distinct()
    return cases.join(ok, "qid", "left_semi"), cases.join(ok, "qid", "left_anti")


def sample_keeping(chunks: DataFrame, answers: DataFrame, n: int, seed: int = 0xC0FFEE) -> DataFrame:
    """Every answer chunk plus a repeatable random filling, ``n`` rows in all (sampling operator).

    ``answers`` is {chunk_id}.  The filling is ordered by a seeded digest of the id, so the same
    seed always picks the same chunks however the table is partitioned.  The order is numbered in
    ranges, so no task holds the sample.
    """
    keep = chunks.join(answers.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rest = chunks.join(answers.select("chunk_id"), "chunk_id", "left_anti")
    room = max(0, n - keep.count())
    drawn = rest.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("chunk_id").cast("string"))))
    filler = dense_number(drawn, ["_draw", "chunk_id"], "_nth").where(F.col("_nth") <= room)
    return keep.unionByName(filler.select(*chunks.columns))


def arm_verdict(scores: DataFrame, arm: str, base: str, gate: float = RECALL_GATE) -> DataFrame:
    """One row comparing two arms of {arm, recall}."""
    row = scores.agg(
        F.max(F.when(F.col("arm") == arm, F.col("recall"))).alias("arm_recall"),
        F.max(F.when(F.col("arm") == base, F.col("recall"))).alias("base_recall"),
        F.max("recall").alias("best"),
    )
    delta = F.round(F.col("arm_recall") - F.col("base_recall"), 6)
    return row.select(
        F.round("arm_recall", 6).alias("arm_recall"),
        F.round("base_recall", 6).alias("base_recall"),
        delta.alias("delta"),
        F.when(delta > 0, "helps").when(delta == 0, "no movement").otherwise("hurts").alias("verdict"),
        (F.col("best") >= gate).alias("gate_met"),
    )


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the right side's keys are dropped."""
    renamed = right
    same = F.lit(True)
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_m{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_m{i}"))
    return left.join(renamed, same, how).drop(*[f"_m{i}" for i in range(len(keys))])


def order_stats(samples: DataFrame, by: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """{by…, n, min, picks…}: the samples at given zero-based positions (columns over ``n``).

    Exact, and without sorting a group in one task.  Samples are counted per distinct value
    (map-side) and the values are dealt into ranges whose bounds Spark samples, so that ranges
    are alike in size wherever the values lie.  The ranges' counts tell which range holds a
    position, and only that range is walked.  The ranges are saved, so a lost executor cannot shift them.
    """
    have = samples.where(F.col(value).isNotNull())
    hist = have.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save_point(hist.repartitionByRange(parts, *by, "_v").withColumn("_b", F.spark_partition_id()))
    size = ranged.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("min"))
    upto = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.groupBy(*by, "_b").agg(F.sum("_c").alias("_c")).withColumn("_cum", F.sum("_c").over(upto(by, "_b")))
    coarse = _match(counted, size.select(*by, "n"), by)
    asked = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("at")) for k, v in picks.items()])
    here = (F.col("_p.at") < F.col("_cum")) & (F.col("_p.at") >= F.col("_cum") - F.col("_c"))
    target = coarse.withColumn("_p", F.explode(asked)).where(here).select(
        *by, "_b", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_cum") + F.col("_c")).alias("_rest")
    )
    walked = _match(ranged.select(*by, "_b", "_v", "_c"), target, [*by, "_b"]).withColumn(
        "_cum", F.sum("_c").over(upto([*by, "_name"], "_v"))
    )
    found = walked.where((F.col("_rest") < F.col("_cum")) & (F.col("_rest") >= F.col("_cum") - F.col("_c")))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in picks])
    return _match(size, wide, by).select(*by, "n", "min", *picks)


def _middle() -> dict[str, Column]:
    return {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.floor(F.col("n") / 2)}


def latency_stats(samples: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """{by…, n, p50, p95, min}; p95 is the sample at index min(n-1, floor(0.95 n))."""
    tail = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95).cast("long"))
    got = order_stats(samples, by, value, {**_middle(), "p95": tail})
    return got.select(*by, "n", ((F.col("_low") + F.col("_high")) / 2).alias("p50"), "p95", "min")


def medians(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """{by…, median}."""
    got = order_stats(samples, by, value, _middle())
    return got.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def unaccounted(samples: DataFrame, by: list[str], wall: str, parts: list[str]) -> DataFrame:
    """Median wall time minus the medians of its known parts."""
    names = [wall, *parts]
    long = samples.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("ms")) for c in names])).alias("_s")
    ).select(*by, "_s.name", "_s.ms")
    med = medians(long, [*by, "name"], "ms").groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in names]
    )
    inside = sum((F.col(p) for p in parts), F.lit(0.0))
    return med.select(*by, *[F.round(c, 6).alias(c) for c in names], F.round(F.col(wall) - inside, 6).alias("unaccounted"))


def accuracy(results: DataFrame) -> DataFrame:
    """{n, intent, project, clarify, prerouted}; a NULL expected intent always passes."""
    intent_ok = F.col("expected_intent").isNull() | (F.col("got_intent") == F.col("expected_intent"))
    project_ok = F.col("expected_project").eqNullSafe(F.col("got_project"))
    clarify_ok = ~F.col("wants_clarify") | F.col("clarified")
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("n"),
        (F.count_if(intent_ok) / n).alias("intent"),
        (F.count_if(project_ok) / n).alias("project"),
        (F.count_if(clarify_ok) / n).alias("clarify"),
        F.count_if("prerouted").alias("prerouted"),
    )


def confusion(results: DataFrame) -> DataFrame:
    """{expected, got, n} of the wrong pairs."""
    return (
        results.where(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("got")))
        .groupBy("expected", "got")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def structured_rates(calls: DataFrame) -> DataFrame:
    """{schema, attempts, repairs, failures, failure_rate}."""
    return calls.groupBy("schema").agg(
        F.sum("attempts").alias("attempts"),
        F.sum("repairs").alias("repairs"),
        F.sum("failures").alias("failures"),
        F.coalesce(F.bround(F.try_divide(F.sum("failures"), F.sum("attempts")), 4), F.lit(0.0)).alias("failure_rate"),
    )


def overflow_by_kind(chunks: DataFrame, limit: int = 512) -> DataFrame:
    """{kind, chunks, over, tokens, lost} of {kind, path, tokens, semantic}."""
    over = F.col("tokens") > limit
    return chunks.groupBy("kind").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(over).alias("over"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(over, F.col("tokens") - limit).otherwise(0)).alias("lost"),
    )


def overflow_by_file(chunks: DataFrame, limit: int = 512) -> DataFrame:
    """{path, chunks, over, max, tokens, lost} over embedded chunks."""
    over = F.col("tokens") > limit
    return chunks.where("semantic").groupBy("path").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(over).alias("over"),
        F.max("tokens").alias("max"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(over, F.col("tokens") - limit).otherwise(0)).alias("lost"),
    )


def overflow_report(chunks: DataFrame, limit: int = 512) -> DataFrame:
    """One row: share of embedded chunks over the window, tokens lost, overshoot, verdict."""
    emb, over = F.col("semantic"), F.col("semantic") & (F.col("tokens") > limit)
    total = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(emb).alias("embedded"),
        F.count_if(over).alias("over"),
        F.coalesce(F.sum(F.when(emb, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(over, F.col("tokens") - limit)), F.lit(0)).alias("lost"),
        F.median(F.when(over, F.col("tokens"))).alias("median_over"),
        F.round(F.avg(F.when(over, F.col("tokens") - limit)), 6).alias("mean_overshoot"),
    )
    worst = overflow_by_file(chunks, limit).agg(
        F.coalesce(F.max(F.col("lost") / F.greatest(F.col("tokens"), F.lit(1))), F.lit(0.0)).alias("worst_share")
    )
    rate = F.when(F.col("embedded") > 0, F.col("over") / F.col("embedded")).otherwise(F.lit(0.0))
    return attach_row(total, worst).select(
        "chunks", "embedded", "over", "tokens", "lost", "median_over", "mean_overshoot",
        F.round(rate, 6).alias("rate"),
        F.round("worst_share", 6).alias("worst_share"),
        F.when(rate < NEGLIGIBLE_SHARE, "negligible")
        .when(F.col("worst_share") < MARGINAL_SHARE, "marginal")
        .otherwise("causal").alias("verdict"),
    )


def size_distribution(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Characters per chunk: mean, p50, p95 (linear interpolation), max."""
    n = F.char_length("text")
    return chunks.groupBy(*(by or [])).agg(
        F.round(F.avg(n), 6).alias("mean"),
        F.round(F.percentile(n, F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile(n, F.lit(0.95)), 6).alias("p95"),
        F.max(n).cast("long").alias("max"),
    )


def cold_warm(samples: DataFrame) -> DataFrame:
    """{project, cold, warm} of {project, pass_no, ms}: pass 0 is cold, warm is the later median."""
    cold = samples.groupBy("project").agg(F.max(F.when(F.col("pass_no") == 0, F.col("ms"))).alias("cold"))
    warm = medians(samples.where("pass_no > 0"), ["project"], "ms").withColumnRenamed("median", "warm")
    return _match(cold, warm, ["project"], "left").select("project", "cold", "warm")


def cold_warm_totals(table: DataFrame, budget_ms: float) -> DataFrame:
    """{projects, cold, warm, worst, within}: totals, worst warm project, budget verdict."""
    order = F.struct(F.col("warm"), F.col("project"))
    return table.agg(
        F.count(F.lit(1)).alias("projects"),
        F.round(F.sum("cold"), 4).alias("cold"),
        F.round(F.sum("warm"), 4).alias("warm"),
        F.max(order)["project"].alias("worst"),
        (F.sum("warm") <= budget_ms).alias("within"),
    )


def regression_diff(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """{root, new_failures, fixed, delta_passed, ok}.

    Inputs are {root, test, failed}.  ``ok`` is NULL for a root without a baseline.  One full
    outer join on (root, test), then one aggregate per root; names are not gathered.
    """
    b = baseline.select("root", "test", F.col("failed").alias("_b"))
    o = observed.select("root", "test", F.col("failed").alias("_o"))
    per = (
        b.join(o, ["root", "test"], "full_outer")
        .groupBy("root")
        .agg(
            F.count_if(F.coalesce("_o", F.lit(False)) & ~F.coalesce("_b", F.lit(False))).alias("new_failures"),
            F.count_if(F.coalesce("_b", F.lit(False)) & ~F.coalesce("_o", F.lit(False))).alias("fixed"),
            (F.count_if(F.col("_o") == F.lit(False)) - F.count_if(F.col("_b") == F.lit(False))).alias("delta_passed"),
            F.count("_b").alias("_nb"),
            F.count("_o").alias("_no"),
        )
        .where("_no > 0")
    )
    judged = F.col("_nb") > 0
    return per.select(
        "root",
        F.when(judged, F.col("new_failures")).alias("new_failures"),
        F.when(judged, F.col("fixed")).alias("fixed"),
        F.when(judged, F.col("delta_passed")).alias("delta_passed"),
        F.when(judged, F.col("new_failures") == 0).alias("ok"),
    )


def new_failures(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """{root, test} failing now and not before, for roots that have a baseline."""
    return (
        observed.where("failed").select("root", "test")
        .join(baseline.where("failed").select("root", "test"), ["root", "test"], "left_anti")
        .join(baseline.select("root").distinct(), "root", "left_semi")
    )
