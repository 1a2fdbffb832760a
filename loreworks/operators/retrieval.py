"""Hybrid retrieval for a table of questions: fusion, boosts, diversity, citations.

Ranked lists are {qid, id, rank} with 1-based ranks and at most ``k`` rows per question, so
everything after candidate generation works on small, bounded groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators import lexical
from loreworks.operators.knn import knn_topk
from loreworks.operators.scale import contains_join, first_rows
from loreworks.session import save_point

# Candidates, result size, fusion and boost weights.
CANDIDATES, TOP_K, RRF_K, MAX_PER_FILE = 30, 8, 60, 3
LEXICAL_WEIGHT = 0.5
BOOST_SAME_PROJECT, BOOST_RECENT, BOOST_ANCHOR = 1.30, 1.15, 1.20
RECENT_DAYS = 7
MAX_TRANSLATION_CHARS = 400
OWNED = "local_owned"


@dataclass(frozen=True)
class Index:
    """The tables a search reads.

    chunks {chunk_id, doc_id, anchor, text, collection, project}, vectors {id, vec, collection,
    project}, documents {doc_id, rel_path, abs_path, provenance, indexed_at}, the one-row script
    census and, for the batch of questions at hand, the term hits of the whole corpus.
    """

    chunks: DataFrame
    vectors: DataFrame
    documents: DataFrame
    census: DataFrame | None
    hits: lexical.TermHits | None
    scope: bool = False


def scoped(index: Index, collection: str | None = None, project: str | None = None) -> Index:
    """Restrict chunks and vectors before anything is ranked; frequencies stay corpus-wide."""
    keep = F.lit(True)
    if collection is not None:
        keep = keep & (F.col("collection") == collection)
    if project is not None:
        keep = keep & (F.col("project") == project)
    return replace(index, chunks=index.chunks.where(keep), vectors=index.vectors.where(keep), scope=True)


def rrf(lists: list[tuple[DataFrame, float]], k: int = RRF_K, digits: int = 12) -> DataFrame:
    """{qid, id, score, first_seen}: sum of weight / (k + rank); lists of weight 0 are skipped.

    ``first_seen`` orders ties: the first list that holds the hit, then its rank there.
    """
    parts = [
        ranked.select(
            "qid", "id",
            (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("_s"),
            (F.lit(i * 1_000_000) + F.col("rank")).cast("long").alias("_p"),
        )
        for i, (ranked, w) in enumerate(lists)
        if w != 0
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("qid", "id")
        .agg(F.round(F.sum("_s"), digits).alias("score"), F.min("_p").alias("first_seen"))
    )


def rerank(scores: DataFrame, k: int) -> DataFrame:
    return first_rows(scores, ["qid"], [F.col("score").desc(), F.col("id")], k, "rank")


def admit(lexical_list: DataFrame, gate: DataFrame) -> DataFrame:
    """The lexical list of the questions whose gate is open."""
    return lexical_list.join(gate.where("open").select("qid"), "qid", "left_semi")


def gated_fusion(
    dense: DataFrame, lexical_list: DataFrame, gate: DataFrame, w_lex: float = LEXICAL_WEIGHT
) -> DataFrame:
    return rrf([(dense, 1.0), (admit(lexical_list, gate), w_lex)])


def strategies(questions: DataFrame, lexical_hits: DataFrame, translated: DataFrame | None = None) -> DataFrame:
    """{qid, strategy}: dense or hybrid, with +translated when the second probe found something."""
    words = lexical_hits.select("qid").distinct().withColumn("_l", F.lit(True))
    out = questions.select("qid").join(words, "qid", "left")
    label = F.when(F.col("_l"), "hybrid").otherwise("dense")
    if translated is not None:
        out = out.join(translated.select("qid").distinct().withColumn("_t", F.lit(True)), "qid", "left")
        label = F.concat(label, F.when(F.col("_t"), "+translated").otherwise(""))
    return out.select("qid", label.alias("strategy"))


def usable_translation(text: Column) -> Column:
    """Not empty, not overlong and no longer in the script it was translated from."""
    trimmed = F.trim(text)
    return (
        trimmed.isNotNull()
        & (trimmed != "")
        & (F.char_length(trimmed) <= MAX_TRANSLATION_CHARS)
        & ~tx.has_cyrillic(trimmed)
    )


def second_probe(questions: DataFrame, vectors: DataFrame, embed_fn: Callable, k: int = CANDIDATES) -> DataFrame:
    """Dense list of the translated questions {qid, translation}; unusable ones give no rows."""
    probes = questions.where(usable_translation(F.col("translation"))).select(
        F.col("qid"), F.trim("translation").alias("text")
    )
    return dense_list(probes, vectors, embed_fn, k)


def embed_questions(questions: DataFrame, embed_fn: Callable) -> DataFrame:
    hashed = questions.select("qid", F.sha2("text", 256).alias("text_hash"), "text")
    vecs = hashed.select("text_hash", "text").dropDuplicates(["text_hash"]).mapInPandas(
        embed_fn, "text_hash string, vec array<float>"
    )
    return hashed.join(vecs, "text_hash").select("qid", "vec")


def dense_list(questions: DataFrame, vectors: DataFrame, embed_fn: Callable, k: int = CANDIDATES) -> DataFrame:
    return knn_topk(embed_questions(questions, embed_fn), vectors, k).select("qid", "id", "sim", "rank")


def fusion_arms(
    dense: DataFrame, lexical_list: DataFrame, gate: DataFrame, probes: dict[str, DataFrame] | None = None, k: int = CANDIDATES * 2
) -> DataFrame:
    """{arm, qid, id, rank} for every fusion under comparison.

    The candidate lists feed six arms, so they are saved once (``CANDIDATES`` rows a question).
    """
    dense, plain = save_point(dense), save_point(lexical_list)
    gated = save_point(admit(plain, gate))
    arms = {
        "dense": dense,
        "lexical": plain,
        "rrf": rerank(rrf([(dense, 1.0), (plain, 1.0)]), k),
        "rrf_w2": rerank(rrf([(dense, 2.0), (plain, 1.0)]), k),
        "gated": rerank(rrf([(dense, 1.0), (gated, 1.0)]), k),
        "gated_w2": rerank(rrf([(dense, 1.0), (gated, LEXICAL_WEIGHT)]), k),
    }
    for name, probe in (probes or {}).items():
        arms[name] = rerank(rrf([(dense, 1.0), (probe, 1.0)]), k)
    return reduce(
        DataFrame.unionByName,
        [ranked.select(F.lit(arm).alias("arm"), "qid", "id", F.col("rank").cast("long").alias("rank")) for arm, ranked in arms.items()],
    )


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits {qid, id, score} with chunk and document attributes (inner: a purged chunk is gone)."""
    c = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "collection", "project", "anchor", "text")
    d = documents.select("doc_id", "rel_path", "abs_path", "provenance", "indexed_at")
    return hits.join(c, "id").join(d, "doc_id")


def boost_factor(now: Column) -> Column:
    """Multiplier from the columns of a hydrated hit joined with its question."""
    age = (F.unix_micros(now) - F.unix_micros(tx.iso_timestamp(F.col("indexed_at")))) / F.lit(1_000_000.0)
    one = F.lit(1.0)
    same = F.when(F.col("project") == F.col("asked_project"), BOOST_SAME_PROJECT).otherwise(one)
    anchored = (F.col("anchor") != "") & F.contains(F.lower("question"), F.lower("anchor"))
    return (
        same
        * F.when(anchored, BOOST_ANCHOR).otherwise(one)
        * F.when(F.floor(age / 86400) <= RECENT_DAYS, BOOST_RECENT).otherwise(one)
    )


def boost(hits: DataFrame, questions: DataFrame, now: Column, digits: int = 12) -> DataFrame:
    """Hydrated hits with the boosted score.  ``questions`` is {qid, text[, project]}."""
    asked = F.col("project") if "project" in questions.columns else F.lit(None).cast("string")
    q = questions.select("qid", F.col("text").alias("question"), asked.alias("asked_project"))
    return (
        hits.join(q, "qid")
        .withColumn("score", F.round(F.col("score") * boost_factor(now), digits))
        .drop("question", "asked_project")
    )


def diversify(hits: DataFrame, per_file: int = MAX_PER_FILE, limit: int = TOP_K) -> DataFrame:
    """At most ``per_file`` hits of a file, then the best ``limit``, with their ``rank``.

    Input is one fused candidate list per question, so both windows run on bounded groups.
    """
    tie = [F.col("score").desc()] + ([F.col("first_seen")] if "first_seen" in hits.columns else []) + [F.col("id")]
    per = first_rows(hits, ["qid", "rel_path"], tie, per_file)
    return first_rows(per, ["qid"], tie, limit, "rank")


def fuse_and_select(
    dense: DataFrame,
    lexical_list: DataFrame,
    questions: DataFrame,
    index: Index,
    now: Column,
    *,
    translated: DataFrame | None = None,
    lexical_weight: float = LEXICAL_WEIGHT,
    limit: int = TOP_K,
) -> DataFrame:
    """From candidate lists to final hits."""
    lists = [(dense, 1.0)] + ([(translated, 1.0)] if translated is not None else []) + [(lexical_list, lexical_weight)]
    hits = hydrate(rrf(lists), index.chunks, index.documents)
    return diversify(boost(hits, questions, now), limit=limit)


def lexical_list(terms: DataFrame, index: Index, k: int = CANDIDATES) -> DataFrame:
    """BM25 list of the given terms; weights are corpus-wide, a scope only filters the hits."""
    return lexical.bm25_best(terms, index.hits, k, chunks=index.chunks if index.scope else None).withColumnRenamed("chunk_id", "id")


def retrieve(
    questions: DataFrame,
    index: Index,
    now: Column,
    embed_fn: Callable,
    *,
    limit: int = TOP_K,
    lexical_weight: float = LEXICAL_WEIGHT,
) -> DataFrame:
    """Hits {qid, rank, score, …} for {qid, text[, project][, translation]}."""
    dense = dense_list(questions, index.vectors, embed_fn)
    gated = lexical.gate_terms(questions, index.hits.df, index.census)
    words = save_point(lexical_list(gated, index))
    translated = (
        save_point(second_probe(questions, index.vectors, embed_fn)) if "translation" in questions.columns else None
    )
    hits = fuse_and_select(
        dense, words, questions, index, now, translated=translated, lexical_weight=lexical_weight, limit=limit
    )
    return hits.join(strategies(questions, words, translated), "qid")


def taint(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid").agg(F.bool_or(F.col("provenance") != OWNED).alias("tainted"))


def citations(hits: DataFrame) -> DataFrame:
    return hits.select(
        "qid", "rank", F.col("id").alias("chunk_id"), "collection", "project",
        F.col("rel_path").alias("path"), "abs_path", "anchor",
        F.round(F.col("score"), 4).alias("score"), "provenance", "indexed_at",
        tx.snippet(F.col("text")).alias("text"),
    )


def context_block(hits: DataFrame, max_chars: int = 6000) -> DataFrame:
    """{qid, context, truncated, tainted, n}: numbered blocks up to the first that would not fit.

    A question has at most a result page of hits, so its blocks are a bounded group.
    """
    header = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("project", F.lit("")),
        F.lit(" / "), F.col("rel_path"),
        F.when(F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit(" / "), F.col("anchor"))).otherwise(""),
    )
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    blocks = hits.withColumn("_b", F.concat(header, F.lit("\n"), F.col("text"))).withColumn(
        "_fits", F.sum(F.char_length("_b")).over(w) <= max_chars
    )
    # Lengths are never negative, so the running sum passes the budget once and stays there.
    return blocks.groupBy("qid").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("rank", "_b")))), lambda s: s["_b"]
            ),
            "\n\n",
        ).alias("context"),
        (~F.bool_and("_fits")).alias("truncated"),
        F.coalesce(F.bool_or(F.col("_fits") & (F.col("provenance") != OWNED)), F.lit(False)).alias("tainted"),
        F.count_if("_fits").alias("n"),
    )


def untrusted_sources(hits: DataFrame) -> DataFrame:
    """{qid, sources}: distinct untrusted paths in rank order (a bounded page of hits)."""
    bad = hits.where(F.col("provenance") != OWNED)
    firsts = bad.groupBy("qid", "rel_path").agg(F.min("rank").alias("_r"))
    return firsts.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "rel_path"))), lambda s: s["rel_path"]).alias("sources")
    )


def fit_excerpts(excerpts: DataFrame, budget: int) -> DataFrame:
    """{request, id, kept} of {request, id, priority, position, tokens, base_tokens}.

    The lowest priority goes first until the rest fits: the kept ones are the longest prefix in
    priority order (earlier position first among equals).  The excerpts of a request are a page
    of retrieval hits.  ``over_budget`` marks a request whose
    fixed part alone is too big.
    """
    order = Window.partitionBy("request").orderBy(F.col("priority").desc(), "position", "id")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    return excerpts.select(
        "request", "id",
        (F.sum("tokens").over(w) + F.col("base_tokens") <= budget).alias("kept"),
        (F.col("base_tokens") > budget).alias("over_budget"),
    )


def global_search(queries: DataFrame, sources: dict[str, DataFrame], limit: int = 8) -> DataFrame:
    """{qid, group, rank, id, text}: literal, case-insensitive substring search per source.

    A source is {id, text, label, sort}: ``text`` is what is searched (fields joined by a
    newline, which no query contains), ``label`` is shown, and the highest ``sort`` comes first.
    """
    needles = queries.select("qid", F.lower("q").alias("_q")).where(F.char_length("_q") >= 2)
    parts = []
    for group, table in sources.items():
        texts = table.select("id", "label", "sort", F.lower("text").alias("_t"))
        found = contains_join(texts, needles, "_t", "_q")
        top = first_rows(found, ["qid"], [F.col("sort").desc(), F.col("id")], limit, "rank")
        parts.append(
            top.select("qid", F.lit(group).alias("group"), "rank", F.col("id").cast("string").alias("id"), F.col("label").alias("text"))
        )
    return reduce(DataFrame.unionByName, parts)
