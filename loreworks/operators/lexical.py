"""Word search: postings, BM25 top-k and the gate that decides whether words can help.

Postings are {term, chunk_id, tf}; corpus statistics travel as small tables.  Only terms that
occur in a question are ever joined, so a batch of questions touches a sliver of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loreworks.functions import text as tx
from loreworks.operators.scale import attach_row, first_rows
from loreworks.session import save_point, spread

# Ranking constants.
K1, B = 1.2, 0.75
MIN_DF_CEILING, MAX_DF_RATIO, MIN_COVERAGE = 5, 0.10, 0.40
POSTINGS_PER_SALT = 200_000
SMALL_TERMS = 500_000
#: Bytes of asked terms that may be sent to every task, and chunks that are searched at once.
WORDS_BYTES, BLOCK = 16 << 20, 2048
#: Tokens that are counted at once.
TOKENS = 1 << 18


def searchable_text(chunks: DataFrame) -> DataFrame:
    """Adds ``searchable``: text, anchor and exploded identifiers, as one searched field."""
    ident = F.array_join(tx.identifiers(F.col("text")), " ")
    return chunks.withColumn(
        "searchable", F.concat_ws(" ", "text", F.coalesce(F.col("anchor"), F.lit("")), ident)
    )


def build_postings(
    chunks: DataFrame, text: str = "text", tokenizer=tx.lex_tokens
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings {term, chunk_id, tf}, chunk_stats {chunk_id, len}, corpus_stats {n, avg_len}).

    Counting is combined map-side: all tokens of a chunk sit in one partition, so the shuffle
    carries one row per distinct (term, chunk).  Lengths come from array sizes, unshuffled.
    """
    bags = chunks.select("chunk_id", tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("_bag"))
    # the outer form keeps the optimizer from adding a "not empty" test that tokenizes twice
    postings = (
        bags.select("chunk_id", F.explode_outer("_bag").alias("term"))
        .where("term IS NOT NULL")
        .groupBy("term", "chunk_id")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    chunk_stats = bags.select("chunk_id", F.size("_bag").cast("long").alias("len"))
    corpus_stats = chunk_stats.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return postings, chunk_stats, corpus_stats


def question_terms(questions: DataFrame, tokenizer=tx.lex_tokens, min_len: int = 1) -> DataFrame:
    """Distinct {qid, term}, short terms left out."""
    return (
        questions.select("qid", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("term"))
        .where(F.char_length("term") >= min_len)
    )


@dataclass(frozen=True)
class TermHits:
    """What a batch of questions needs to know about a corpus, from one pass over its text.

    postings {term, chunk_id, tf, len} of the asked terms, df {term, df}, stats {n, avg_len}; and the same postings by
    chunk, bags {chunk_id, len, tids, tfs}, where ``words`` (sorted) gives the number of a term.  Without bags the
    asked terms were too many to send to every task.
    """

    postings: DataFrame
    df: DataFrame
    stats: DataFrame
    bags: DataFrame | None = None
    words: pa.Array | None = None


def asked_words(terms: DataFrame, limit: int = WORDS_BYTES) -> pa.Array | None:
    """The distinct terms, sorted; None if they have more than ``limit`` bytes."""
    distinct = terms.select("term").where("term is not null").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    if size > limit:
        return None
    return pa.array(sorted(distinct.toArrow()["term"].to_pylist()), pa.string())


def _some_tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows ``chunk_id, bag`` of a batch, cut so that a part has about ``TOKENS`` tokens or a single row."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(upto // TOKENS)) + 1, [batch.num_rows]])
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(int(a), int(b - a))


def _count_words(words: pa.Array):
    """Rows ``chunk_id, bag`` to ``chunk_id, len, tids, tfs`` of the words that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _some_tokens(whole)):
            bag = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            size = pc.list_value_length(bag).to_numpy(zero_copy_only=False).astype(np.int64)
            tid = pc.index_in(bag.flatten(), value_set=words)
            known = pc.is_valid(tid).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)[known]
            pair, tf = np.unique(row * max(len(words), 1) + pc.drop_null(tid).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            edge = np.searchsorted(pair // max(len(words), 1), np.arange(len(size) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v.astype(np.int32))) for v in (pair % max(len(words), 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *lists], ["chunk_id", "len", "tids", "tfs"])

    return run


def term_hits(chunks: DataFrame, terms: DataFrame, text: str = "text", tokenizer=tx.lex_tokens, limit: int = WORDS_BYTES) -> TermHits:
    """Tokenize once and keep the asked terms only.

    Asked terms of at most ``limit`` bytes go to every task: words are counted where the text is, chunk by chunk, and
    nothing is shuffled.  More of them are joined, and each chunk adds one marker row (the empty term) that
    carries its length, so corpus counts come out of the same pass.  What is left is saved, since scores,
    frequencies and counts all read it.
    """
    words = asked_words(terms, limit)
    if words is not None:
        kind = chunks.schema["chunk_id"].dataType.simpleString()
        bags = save_point(
            spread(chunks.select("chunk_id", text)).select("chunk_id", tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("bag"))
            .mapInArrow(_count_words(words), f"chunk_id {kind}, len long, tids array<int>, tfs array<int>")
        )
        return hits_of_bags(bags, words)
    marker = F.lit("")
    wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(marker.alias("term"))).distinct()
    kept = save_point(
        chunks.select("chunk_id", tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("_bag"))
        .select(
            "chunk_id",
            F.size("_bag").cast("long").alias("len"),
            F.explode(F.array_append("_bag", marker)).alias("term"),
        )
        .join(wanted, "term", "left_semi")
        .groupBy("term", "chunk_id", "len")
        .agg(F.count(F.lit(1)).alias("tf")),
        dealt=True,
    )
    postings = kept.where(F.col("term") != "")
    stats = kept.where(F.col("term") == "").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return TermHits(postings, document_frequency(postings), stats)


def _named(numbered: DataFrame, words: pa.Array) -> DataFrame:
    """``term`` in place of ``tid``; the words are few enough to go to every task."""
    names = numbered.sparkSession.createDataFrame(pa.table({"tid": pa.array(range(len(words)), pa.int32()), "term": words}))
    return numbered.join(F.broadcast(names), "tid").drop("tid")


def hits_of_bags(bags: DataFrame, words: pa.Array, stats: DataFrame | None = None) -> TermHits:
    pairs = bags.select("chunk_id", "len", F.explode(F.arrays_zip("tids", "tfs")).alias("_p"))
    postings = _named(pairs.select("chunk_id", "len", F.col("_p.tids").alias("tid"), F.col("_p.tfs").cast("long").alias("tf")), words)
    df = _named(bags.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df")), words)
    if stats is None:
        stats = bags.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return TermHits(postings, df, stats, bags, words)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _weighted(terms: DataFrame, hits: TermHits) -> DataFrame:
    """{qid, term, avg_len, df, idf} of the asked terms that occur."""
    return save_point(
        attach_row(terms.join(hits.df, "term"), hits.stats).select(
            "qid", "term", "avg_len", "df",
            F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
        )
    )


class Board:
    """The k best chunks of a question so far; equal scores, to ``digits``, are ordered by id."""

    def __init__(self, k: int, digits: int):
        self.k, self.scale = k, 10.0**digits
        self.score, self.ids = np.zeros(0), np.zeros(0, object)
        self.least = 0.0

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -np.floor(score * self.scale + 0.5)))[: self.k]
        self.score, self.ids = score[best], ids[best]
        if len(best) == self.k:
            self.least = max(0.0, self.score.min() - 2 / self.scale)


def max_score(tids: np.ndarray, weights: np.ndarray, lists, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the chunks of a block that can reach ``least``.

    ``lists(tid)`` gives places and impacts of a term in the block.  Terms are taken by the most they can add; once
    those that follow can't reach ``least`` together, no new chunk is a candidate, and candidates that fall behind
    are dropped before the long lists of common terms are looked at.
    """
    found = [lists(t) for t in tids.tolist()]
    most = np.array([w * imp.max() if len(imp) else 0.0 for w, (_, imp) in zip(weights.tolist(), found)])
    order = np.argsort(-most, kind="stable")
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])  # what the terms from here on can add
    essential = int((rest[:-1] >= least).sum()) if least > 0 else len(order)
    places = [found[i][0] for i in order[:essential]]
    values = [weights[i] * found[i][1] for i in order[:essential]]
    if not places or not sum(map(len, places)):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.concatenate(places)
    total = np.bincount(at, np.concatenate(values))
    here = np.unique(at)
    score = total[here]
    for n, i in enumerate(order[essential:], essential):
        near = score + rest[n] >= least
        here, score = here[near], score[near]
        if not len(here):
            break
        docs, impact = found[i]
        if len(docs):
            j = np.minimum(np.searchsorted(docs, here), len(docs) - 1)
            score = score + np.where(docs[j] == here, weights[i] * impact[j], 0.0)
    near = score >= least
    return here[near], score[near]


def _best_of_partition(questions: list[tuple[np.ndarray, np.ndarray]], n_words: int, avg_len: float, k: int, k1: float, b: float, digits: int, kind: pa.DataType):
    """Rows of ``bags`` to the ``k`` best chunks of every question among them: ``q, chunk_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boards = [Board(k, digits) for _ in questions]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(object)
                size = part.column(1).to_numpy(zero_copy_only=False)
                many = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(ids)), many)
                tid, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / avg_len))
                order = np.argsort(tid, kind="stable")
                doc, impact = doc[order], impact[order]
                edge = np.searchsorted(tid[order], np.arange(n_words + 1)).tolist()
                lists = lambda t: (doc[edge[t] : edge[t + 1]], impact[edge[t] : edge[t + 1]])  # noqa: B023, E731 - used within the turn
                for board, (tids, weights) in zip(boards, questions):
                    here, score = max_score(tids, weights, lists, board.least)
                    if len(here):
                        board.add(score, ids[here])
        q = np.repeat(np.arange(len(boards)), [len(x.ids) for x in boards])
        ids = [i for x in boards for i in x.ids]
        score = np.concatenate([x.score for x in boards]) if boards else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids, kind), pa.array(score)], ["q", "chunk_id", "score"])

    return run


def bm25_best(terms: DataFrame, hits: TermHits, k: int, k1: float = K1, b: float = B, digits: int = 6, small: int = SMALL_TERMS, chunks: DataFrame | None = None) -> DataFrame:
    """{qid, chunk_id, score, rank}: the top ``k`` of each question, among ``chunks`` if given.

    Each partition of chunks is searched by itself with score bounds (:func:`max_score`) and sends its ``k`` best of
    every question, so no row is made for a pair that can't be among them, and there is one exchange.  With more
    than ``small`` question terms, or without bags, scores are computed by joins.
    """
    weighted = _weighted(terms, hits)
    asked = None if hits.bags is None else weighted.limit(small + 1).toArrow()
    if asked is None or asked.num_rows > small:
        scores = bm25_scores(terms, hits, k1, b, small, weighted)
        if chunks is not None:
            scores = scores.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        return ranked(scores, k, digits)
    bags = hits.bags if chunks is None else hits.bags.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    qids, number = pc.unique(asked["qid"]), None
    number = pc.index_in(asked["qid"], value_set=qids).to_numpy()
    tids, idf = pc.index_in(asked["term"], value_set=hits.words).to_numpy(), asked["idf"].to_numpy()
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    questions = list(zip(np.split(tids[order], cuts), np.split(idf[order], cuts))) if len(order) else []
    avg_len = asked["avg_len"][0].as_py() if len(order) else 1.0
    field_ = bags.schema["chunk_id"].dataType
    run = _best_of_partition(questions, len(hits.words), avg_len, k, k1, b, digits, to_arrow_type(field_))
    found = spread(bags).mapInArrow(run, f"q int, chunk_id {field_.simpleString()}, score double")
    names = bags.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(qids)), pa.int32()), "qid": qids.combine_chunks() if isinstance(qids, pa.ChunkedArray) else qids}))
    return ranked(found.where("score > 0").join(F.broadcast(names), "q").select("qid", "chunk_id", "score"), k, digits)


def bm25_scores(
    terms: DataFrame, hits: TermHits, k1: float = K1, b: float = B, small: int = SMALL_TERMS, weighted: DataFrame | None = None
) -> DataFrame:
    """{qid, chunk_id, score > 0} of all pairs, by joins.

    Question terms counted to be few go to every task, so the postings are not moved at all.
    More than that are joined by term, and a term in very many chunks is split: its postings
    are salted by chunk and the question rows repeated per salt, so a stop word never lands in
    one task.  The number of salts follows from the document frequency that idf needs anyway.
    """
    weighted = _weighted(terms, hits) if weighted is None else weighted
    if weighted.limit(small + 1).count() <= small:
        pairs = hits.postings.join(F.broadcast(weighted), "term")
    else:
        salts = F.ceil(F.col("df") / POSTINGS_PER_SALT).cast("int")
        asked = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        salted = hits.postings.join(hits.df.select("term", salts.alias("_n")), "term").withColumn(
            "_salt", F.pmod(F.xxhash64("chunk_id"), F.col("_n")).cast("int")
        )
        pairs = salted.join(asked, ["term", "_salt"])
    denom = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    part = F.col("idf") * (F.col("tf") * (k1 + 1)) / denom
    return pairs.groupBy("qid", "chunk_id").agg(F.sum(part).alias("score")).where(F.col("score") > 0)


def ranked(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Top ``k`` per question, ties on the rounded score broken by id."""
    return first_rows(
        scores.withColumn("score", F.round("score", digits)),
        ["qid"], [F.col("score").desc(), F.col("chunk_id")], k, "rank",
    )


def bm25_topk(
    questions: DataFrame,
    chunks: DataFrame,
    k: int,
    k1: float = K1,
    b: float = B,
    text: str = "text",
    tokenizer=tx.lex_tokens,
    terms: DataFrame | None = None,
) -> DataFrame:
    """{qid, chunk_id, score, rank} of a batch of questions over raw chunks."""
    terms = terms if terms is not None else question_terms(questions, tokenizer)
    return bm25_best(terms, term_hits(chunks, terms, text, tokenizer), k, k1, b)


def bm25_from_index(
    questions: DataFrame,
    postings: DataFrame,
    chunk_stats: DataFrame,
    corpus_stats: DataFrame,
    k: int,
    terms: DataFrame | None = None,
    limit: int = WORDS_BYTES,
) -> DataFrame:
    """The same ranking from stored postings: those of the asked terms are gathered by chunk."""
    terms = terms if terms is not None else question_terms(questions)
    words = asked_words(terms, limit)
    if words is None:
        asked = postings.join(terms.select("term").distinct(), "term", "left_semi").join(chunk_stats, "chunk_id")
        return bm25_best(terms, TermHits(asked, document_frequency(asked), corpus_stats), k)
    names = postings.sparkSession.createDataFrame(pa.table({"tid": pa.array(range(len(words)), pa.int32()), "term": words}))
    mine = postings.join(F.broadcast(names), "term").groupBy("chunk_id").agg(F.collect_list(F.struct("tid", F.col("tf").cast("int").alias("tf"))).alias("_p"))
    bags = mine.join(chunk_stats, "chunk_id").select("chunk_id", "len", F.col("_p.tid").alias("tids"), F.col("_p.tf").alias("tfs"))
    return bm25_best(terms, hits_of_bags(save_point(bags), words, corpus_stats), k)


# ------------------------------------------------------------------------- the gate


def _expanded_df(terms: DataFrame, df: DataFrame) -> DataFrame:
    """{qid, term, df} with 0 for absent terms."""
    return terms.join(df, "term", "left").select("qid", "term", F.coalesce("df", F.lit(0)).alias("df"))


def gate_terms(
    questions: DataFrame,
    df: DataFrame,
    census: DataFrame,
    min_len: int = 3,
    max_df_ratio: float = MAX_DF_RATIO,
    tokenizer=tx.plain_words,
) -> DataFrame:
    """{qid, term}: the terms worth searching, for questions that words can answer at all.

    ``df`` is {term, df}; ``census`` is one row {total, cyrillic, majority_cyrillic}, where a
    NULL ``cyrillic`` means the script of the corpus is unknown and no term is in the minority.
    """
    counted = _expanded_df(question_terms(questions, tokenizer, min_len), df).where("df > 0")
    judged = attach_row(counted, census).withColumn(
        "_kept",
        (F.col("df") < F.greatest(F.lit(float(MIN_DF_CEILING)), F.col("total") * max_df_ratio))
        & (
            F.col("cyrillic").isNull()
            | (tx.has_cyrillic(F.col("term")) == F.col("majority_cyrillic"))
        ),
    )
    open_q = (
        judged.groupBy("qid")
        .agg(F.count_if("_kept").alias("_k"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_k") > 0) & (F.col("_k") / F.col("_n") >= MIN_COVERAGE))
        .select("qid")
    )
    return judged.where("_kept").select("qid", "term").join(open_q, "qid", "left_semi")


def lexical_gate(questions: DataFrame, gated: DataFrame) -> DataFrame:
    """{qid, open} for every question."""
    passed = gated.select("qid").distinct().withColumn("_o", F.lit(True))
    return questions.select("qid").join(passed, "qid", "left").select(
        "qid", F.coalesce("_o", F.lit(False)).alias("open")
    )


def expand_prefixes(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """{qid, term, word}: Cyrillic terms matched to every word they begin; others to themselves.

    The prefixes of each Cyrillic word are looked up by equality, so the join is an equi-join
    whatever the size of the vocabulary.
    """
    cyr = tx.has_cyrillic(F.col("term"))
    words = vocabulary.where(tx.has_cyrillic(F.col("word"))).select("word").distinct()
    prefixes = words.select(
        "word",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.char_length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n)
            )
        ).alias("term"),
    )
    plain = terms.where(~cyr).select("qid", "term", F.col("term").alias("word"))
    return terms.where(cyr).join(prefixes, "term").select("qid", "term", "word").unionByName(plain)


def prefix_document_frequency(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """{term, df} where a Cyrillic term counts the chunks holding any word it begins."""
    distinct = terms.select(F.lit(0).alias("qid"), "term").distinct()
    vocabulary = postings.select(F.col("term").alias("word")).distinct()
    expanded = expand_prefixes(distinct, vocabulary).select("term", "word")
    return (
        expanded.join(postings.select(F.col("term").alias("word"), "chunk_id"), "word")
        .groupBy("term")
        .agg(F.countDistinct("chunk_id").alias("df"))
    )


def lexical_only(questions: DataFrame, chunks: DataFrame, limit: int, collection: str | None = None, project: str | None = None) -> DataFrame:
    """Search without vectors: every term of two letters or more, no gate; says how it was done.

    A scope restricts the hits (``chunks`` then has collection and project); frequencies stay corpus-wide.
    """
    terms = question_terms(questions, min_len=2)
    within = None
    for column, value in (("collection", collection), ("project", project)):
        if value is not None:
            within = (chunks if within is None else within).where(F.col(column) == value)
    found = bm25_best(terms, term_hits(chunks, terms), limit, chunks=within)
    return found.withColumns({"strategy": F.lit("lexical"), "degraded": F.lit(True)})


def identifier_search(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """{qid, chunk_id, score, rank}: BM25 over text, anchor and the parts of identifiers, so a part finds the whole."""
    return bm25_topk(questions, searchable_text(chunks), k, text="searchable")
