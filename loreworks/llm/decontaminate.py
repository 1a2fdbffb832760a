"""Benchmark decontamination: BM25 over test items with block-max WAND bounds, then overlap of question and answer.

Test items are cut into units of at most ``UNIT`` words, which are indexed.  A unit's impacts are its BM25
term scores over their sum, so that a passage that has all of its words scores 1, whatever the unit's length.
Every document is read as passages of ``2 * UNIT`` words that overlap by half, so that a unit that occurs lies
within one.  All passages of a batch are queried together: first the sum of each term's greatest impact, then
the sums of its greatest impacts by block of ``BLOCK`` units bound what a passage can score; only blocks that
may reach ``threshold`` are scored in full.  Nothing that reaches it is missed, as both bounds are sums of
maxima.  A document's item is confirmed if enough of its question's and of its answer's word triples occur in
the document.

The documents aren't shuffled.  The index goes to the tasks in shards of at most ``SHARD_UNITS`` units, so its
size doesn't depend on how many items there are; each shard is a pass over the documents.

Defined cases: a null text is empty; items without words match nothing, items with the same words each match;
an item without answer (or question) needs the other only; fewer than three words of a part are one n-gram; rows
without item_id are left out; repeated items are reported once per document; repeated documents each get rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreworks.llm.words import find_words, shingles, slices, text_bytes

UNIT = 64
BLOCK = 8
SHARD_UNITS = 1024
THRESHOLD = 0.6
OVERLAP = 0.5
K1, B = 1.2, 0.75
GRAM = 3
SLICE = 1 << 19


@dataclass
class Index:
    """A shard of the index, ready to send."""

    terms: np.ndarray  # sorted word hashes
    best: np.ndarray  # greatest impact of each term
    by_block: np.ndarray  # greatest impact of each term by block
    blocks: list[tuple[np.ndarray, np.ndarray]]  # of each block: term indices, impacts (terms x units)
    units: np.ndarray  # item of each unit, as index of ``items``
    items: list  # item ids
    question: list[np.ndarray]  # n-gram hashes by item
    answer: list[np.ndarray]


def split_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, question, answer`` of items given as one text: the last fifth of the words is the answer."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != "")
    n = F.size("_w")
    cut = n - F.greatest(F.floor(n / 5), F.least(n, F.lit(1))).cast("int")
    part = lambda start, size: F.array_join(F.slice("_w", start, size), " ")
    return benchmark.select("item_id", words.alias("_w")).select("item_id", part(F.lit(1), cut).alias("question"), part(cut + 1, n - cut).alias("answer"))


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, unit, term, tf, size) of (item_id, text)."""
    for batch in batches:
        words = find_words(*text_bytes(batch.column(1)))
        owner = words.owner
        unit = (np.arange(len(owner)) - words.first[:-1][owner]) // UNIT if len(owner) else owner
        key, inverse = np.unique(np.stack([owner, unit], axis=1), axis=0, return_inverse=True) if len(owner) else (np.zeros((0, 2), int), owner)
        at, tf = np.unique(np.stack([inverse.ravel().astype(np.uint64), words.hash], axis=1), axis=0, return_counts=True) if len(owner) else (np.zeros((0, 2), np.uint64), owner)
        size = np.bincount(inverse.ravel(), minlength=len(key))
        u = at[:, 0].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(key[u, 0])), pa.array(key[u, 1]), pa.array(at[:, 1].copy().view(np.int64)), pa.array(tf.astype(np.int64)), pa.array(size[u])],
            ["item_id", "unit", "term", "tf", "size"],
        )


def _grams(texts: list[str | None]) -> list[np.ndarray]:
    words = find_words(*text_bytes(pa.array(texts, pa.string())))
    h, owner = shingles(words, GRAM)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(h[s:e]) for s, e in zip(edges, edges[1:])]


def build_index(items: DataFrame) -> Iterator[Index]:
    """Shards of the index over ``item_id, question, answer``.  Only one shard at a time is on the driver."""
    items = items.where("item_id is not null").groupBy("item_id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    kind = items.schema["item_id"].dataType.simpleString()
    whole = F.concat_ws(" ", "question", "answer")
    units = items.select("item_id", whole.alias("text")).mapInArrow(_unit_rows, f"item_id {kind}, unit long, term long, tf long, size long").cache()
    lengths = units.select("item_id", "unit", "size").distinct()
    stats = lengths.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    if stats.n:
        df = units.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") + K1 * (1 - B + B * F.col("size") / stats.mean)
        impacts = units.join(df, "term").select("item_id", "unit", "term", (idf * F.col("tf") * (K1 + 1) / norm).alias("impact"))
        shards = -(-stats.n // SHARD_UNITS)
        shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))  # all units of an item are in one
        for k in range(shards):
            rows = impacts.where(shard == k).collect()
            texts = items.where(shard == k).collect()
            if rows:
                yield _shard(rows, texts)
    units.unpersist()


def _shard(rows: list, texts: list) -> Index:
    by_unit: dict[tuple, list] = {}
    for r in rows:
        by_unit.setdefault((r.item_id, r.unit), []).append((r.term, r.impact))
    # units of alike sizes share a block: their impacts are of like magnitude
    names = sorted(by_unit, key=lambda u: (len(by_unit[u]), u))
    terms = np.unique(np.array([r.term for r in rows], np.int64).view(np.uint64))
    n_blocks = -(-len(names) // BLOCK)
    by_block = np.zeros((len(terms), n_blocks), np.float32)
    blocks = []
    for b in range(n_blocks):
        dense: dict[int, np.ndarray] = {}
        for k, name in enumerate(names[b * BLOCK : (b + 1) * BLOCK]):
            total = sum(v for _, v in by_unit[name])
            at = np.searchsorted(terms, np.array([t for t, _ in by_unit[name]], np.int64).view(np.uint64))
            for i, (_, v) in zip(at.tolist(), by_unit[name], strict=True):
                dense.setdefault(i, np.zeros(BLOCK, np.float64))[k] = v / total
        own = np.array(sorted(dense))
        impact = np.stack([dense[i] for i in own])
        by_block[own, b] = np.nextafter(impact.max(axis=1).astype(np.float32), np.float32(np.inf))
        blocks.append((own, impact))
    items = sorted({r.item_id for r in texts})
    place = {x: i for i, x in enumerate(items)}
    text = {r.item_id: r for r in texts}
    return Index(
        terms, by_block.max(axis=1), by_block, blocks, np.array([place[u[0]] for u in names]), items,
        _grams([text[i].question for i in items]), _grams([text[i].answer for i in items]),
    )


def _share(wanted: np.ndarray, have: np.ndarray) -> float:
    return 1.0 if not len(wanted) else float(np.isin(wanted, have, assume_unique=True).mean())


def matches(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of the confirmed items of each text."""
    words = find_words(data, offsets)
    if not len(words.hash):
        return []
    at = np.minimum(np.searchsorted(index.terms, words.hash), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[at] == words.hash)
    if not len(hit):
        return []
    count = np.diff(words.first)
    cells = -(-count // UNIT)  # half passages
    first_cell = np.cumsum(cells) - cells
    owner = words.owner[hit]
    cell = first_cell[owner] + (hit - words.first[:-1][owner]) // UNIT
    key = np.unique(cell * len(index.terms) + at[hit])  # a term counts once
    cell, term = key // len(index.terms), key % len(index.terms)
    total = int(cells.sum())
    last = np.zeros(total + 1, bool)
    last[(first_cell + cells - 1)[cells > 0]] = True
    other = np.where(last[:total], total, np.arange(total) + 1)  # the cell that completes the passage; none at the end
    slack = 1e-5
    bound = np.append(np.bincount(cell, index.best[term], total), 0.0)
    may = bound[:total] + bound[other] >= threshold - slack
    need = np.append(may, False)
    need[other[may]] = True
    used = need[cell]
    if not used.any():
        return []
    cell, term = cell[used], term[used]
    head = np.flatnonzero(np.diff(cell, prepend=-1))
    named = cell[head]
    sums = np.zeros((total + 1, len(index.blocks)), np.float32)
    sums[named] = np.add.reduceat(index.by_block[term], head, axis=0)
    sums[total] = 0
    begin = np.zeros(total + 1, np.int64)
    until = np.zeros(total + 1, np.int64)
    begin[named], until[named] = head, np.append(head[1:], len(cell))
    best: dict[tuple[int, int], float] = {}
    text_of = np.repeat(np.arange(len(count)), cells)
    for p, b in zip(*np.nonzero(sums[:total] + sums[other] >= threshold - slack), strict=True):
        q = other[p]
        asked = np.union1d(term[begin[p] : until[p]], term[begin[q] : until[q]])
        own, impact = index.blocks[b]
        score = impact[np.isin(own, asked, assume_unique=True)].sum(axis=0)
        for k in np.flatnonzero(score >= threshold - 1e-9):
            pair = (int(text_of[p]), int(index.units[b * BLOCK + k]))
            best[pair] = max(best.get(pair, 0.0), float(score[k]))
    out, have = [], {}
    for (text, item), score in sorted(best.items()):
        if text not in have:
            own = find_words(data[offsets[text] : offsets[text + 1]], np.array([0, offsets[text + 1] - offsets[text]]))
            have = {text: np.unique(np.concatenate([shingles(own, n)[0] for n in range(1, GRAM + 1)]))}
        asks, answers = _share(index.question[item], have[text]), _share(index.answer[item], have[text])
        if asks >= overlap and answers >= overlap:
            out.append((text, item, score, asks, answers))
    return out


def _batch_matches(index: Index, column: pa.Array, threshold: float, overlap: float):
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, SLICE):
        for text, *rest in matches(index, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], threshold, overlap):
            yield text + a, *rest


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of each document and each item that it holds."""
    spark = docs.sparkSession
    doc_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, score double, question_overlap double, answer_overlap double"

    def searcher(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_batch_matches(sent.value, batch.column(1), threshold, overlap))
                text, item, *numbers = zip(*found, strict=True) if found else [()] * 5
                ids = [sent.value.items[i] for i in item]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text, pa.int64())), pa.array(ids, pa.int64() if item_type.simpleString() == "bigint" else None), *[pa.array(n, pa.float64()) for n in numbers]],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        return run

    out = spark.createDataFrame([], schema)
    for index in build_index(items):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(searcher(spark.sparkContext.broadcast(index)), schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    at = docs.columns.index("text")

    def cleaner(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for text, *_ in _batch_matches(sent.value, batch.column(at), threshold, overlap):
                    keep[text] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in build_index(items):
        docs = docs.mapInArrow(cleaner(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
