"""Quality selection by importance resampling.

Two generative models of hashed word n-grams (one and two words) are counted: the target model from
labelled documents of good quality (each n-gram once a document), the raw model from all labelled documents, good or bad (from these
and not from the whole corpus: a text with thousands of unlabelled copies would count as raw, not as
target, and be rejected with all its copies).  A passage of ``PASSAGE`` words weighs the sum of its
n-grams' log ratio, target over raw, ratios within ``EVEN`` of 0 aside; a document weighs as much as its
least target-like passage, so that a long clean text does not outweigh a bad part.  Documents are then
sampled without replacement by Gumbel top-k: each gets ``log_weight`` plus Gumbel noise, drawn from a
hash of its id, and the k greatest keys are kept; k is the number of documents whose weight reaches the
cut that best separates the labelled sample.

Both models are fitted on a bounded sample (``sample`` labelled rows of least id hash), the model that is
sent to the tasks has ``buckets`` numbers at any input size; weights, k and the selection cover every document.

Defined cases: a null text is empty; a text without words weighs 0 and competes as such; labels that
are null take no part, repeated ones count by their worst value; without good and bad labels (or without
documents) nothing is rejected; repeated rows get equal keys and are all kept or all rejected; further
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreworks.llm.words import find_words, fresh, pairs, slices, text_bytes
from loreworks.session import save_point

BUCKETS = 1 << 20
SAMPLE = 20_000
PASSAGE = 32
#: Observations that pull a bucket's ratio to 1: a rare n-gram says little.
SHRINK = 5.0
#: Log ratios nearer to 0 count as 0: languages or topics may be spread unevenly, which says nothing of quality.
EVEN = 1.0
SLICE = 1 << 19
#: Keys that are sorted at once to find the last one kept.
SORTED_KEYS = 10_000


@dataclass
class ImportanceModel:
    """``ratio``: log of target over raw by bucket; ``cut``: weight from which a document counts as target-like."""

    ratio: np.ndarray
    cut: float = float("-inf")


def _ngrams(words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram (single words in the lower half, pairs in the upper) and the index of its first word."""
    half = np.uint64(buckets // 2 - 1)
    two, left = pairs(words)
    again = words.hash[left] == words.hash[left + 1]
    again[1:] &= again[:-1] & (left[1:] == left[:-1] + 1)
    again[:1] = False
    two[again] = 0  # a word said three times on end is one and the same n-gram, whatever the word
    slot = np.concatenate([words.hash & half, (two & half) + np.uint64(buckets // 2)]).astype(np.int64)
    return slot, np.concatenate([np.arange(len(words.hash)), left])


def _parts(column: pa.Array):
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, SLICE):
        yield a, b, find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1))
            for a, b, words in _parts(batch.column(0)):
                slot, at = _ngrams(words, buckets)
                # once a document, as what one junk text repeats a hundred times isn't frequent; but for
                # the n-gram that stands for repetition itself
                key = words.owner[at] * buckets + slot
                said = slot == buckets // 2
                key = np.concatenate([np.unique(key[~said]), key[said]])
                slot, owner = key % buckets, key // buckets
                raw += np.bincount(slot, minlength=buckets)
                if good[a:b].any():
                    target += np.bincount(slot[good[a:b][owner]], minlength=buckets)
        some = np.flatnonzero(raw)
        for k in range(0, len(some), 1 << 16):
            s = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(raw[s]), pa.array(target[s])], ["bucket", "raw", "target"])

    return count


def _weigher(ratio, passage: int):
    """``ratio``: a broadcast of the buckets' log ratios."""

    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ratio.value
        for column in texts:
            weight = np.zeros(len(column))
            for a, b, words in _parts(column):
                if not len(words.hash):
                    continue
                slot, at = _ngrams(words, len(table))
                by_word = np.bincount(at, table[slot], len(words.hash))
                has = np.flatnonzero(np.diff(words.first))
                begin = words.first[:-1][has]
                count = np.diff(words.first)[has]
                # passages start every `passage` words; the last words of a text form a shorter one
                runs = -(-count // passage)
                heads = np.repeat(begin, runs) + passage * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
                sums = np.add.reduceat(by_word, heads)
                weight[a + has] = np.minimum.reduceat(sums, np.cumsum(runs) - runs)
            yield pa.array(weight)

    return weigh


def weigh(docs: DataFrame, model: ImportanceModel, name: str = "log_weight", passage: int = PASSAGE) -> DataFrame:
    """All rows and columns of ``docs`` and the log importance weight of ``text`` as ``name``.

    Only texts go to the workers and only weights come back; the other columns stay where they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.ratio)
    return docs.withColumn(name, F.arrow_udf(_weigher(sent, passage), "double")("text"))


def _labelled(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids with ``good``: those of least hash, so any part of the table is as likely."""
    by_id = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(((F.min("quality") > 0) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good"))
    )
    return by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, passage: int = PASSAGE) -> ImportanceModel:
    """Count both models and choose the cut on the labelled sample (at most ``sample`` rows)."""
    chosen = _labelled(labels, sample).collect()
    spark = docs.sparkSession
    good = spark.createDataFrame([(r.doc_id, r.good) for r in chosen], "doc_id long, good boolean")
    known = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id").select("good", "text")
    counts = save_point(
        known.select("text", "good")
        .mapInArrow(_counter(buckets), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    ratio = np.zeros(buckets, np.float32)
    if not total.target:
        return ImportanceModel(ratio)
    log = F.log((F.col("target") + SHRINK) / (F.col("raw") * (total.target / total.raw) + SHRINK))
    for r in counts.select("bucket", log.alias("log")).where(F.abs("log") >= EVEN).collect():
        ratio[r.bucket] = r.log
    model = ImportanceModel(ratio)
    seen = weigh(known, model, passage=passage).select("good", "log_weight").toPandas()
    good_w = np.sort(seen.log_weight[seen.good].to_numpy())
    bad_w = np.sort(seen.log_weight[~seen.good].to_numpy())
    if len(good_w) and len(bad_w):
        cuts = np.unique(np.concatenate([good_w, bad_w]))
        lost = np.searchsorted(good_w, cuts) / len(good_w)  # good ones below the cut
        passed = 1 - np.searchsorted(bad_w, cuts) / len(bad_w)
        model.cut = float(cuts[np.argmin(20 * lost + passed)])  # to lose a clean document is worse
    return model


def _keyed(docs: DataFrame, model: ImportanceModel, weight: str, key: str, passage: int) -> DataFrame:
    # uniform in (0, 1) from the id; -log(-log(u)) is a Gumbel variate
    u = (F.xxhash64(F.lit("gumbel"), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return weigh(docs, model, weight, passage).withColumn(key, F.col(weight) - F.log(-F.log(u)))


def last_key(keys: DataFrame, k: int) -> float:
    """The k-th greatest value of ``key``.

    Counts in 1,024 equal ranges narrow down where it lies until a range has few rows, or one value
    only; only those rows are sorted.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.where(F.col("key").between(low, high))
        step = (high - low) / 1024
        if step <= 0 or low + step <= low:
            return low
        slot = F.least(F.floor((F.col("key") - low) / step), F.lit(1023))
        bins = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r.slot):
            if above + r.n >= k:
                low, high, n = r.lo, r.hi, r.n
                break
            above += r.n
        if n <= SORTED_KEYS or low == high:
            rows = keys.where(F.col("key").between(low, high)).select("key").orderBy(F.desc("key")).limit(min(n, SORTED_KEYS)).collect()
            return low if low == high else rows[k - above - 1].key


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, passage: int = PASSAGE, **fitting) -> DataFrame:
    """``doc_id, log_weight, key, kept`` for every row of ``docs``; ``kept`` marks the k greatest keys.

    ``k`` None: as many as there are documents that reach the model's cut.
    """
    ids = docs.select("doc_id", "text")
    model = fit(ids, labels, passage=passage, **fitting)
    keys = save_point(_keyed(ids, model, "log_weight", "key", passage).select("doc_id", "log_weight", "key"))
    return keys.withColumn("kept", F.col("key") >= F.lit(_bound(keys, model, k)))


def _bound(keys: DataFrame, model: ImportanceModel, k: int | None) -> float:
    if k is None:
        k = keys.where(F.col("log_weight") >= model.cut).count()
    total = keys.count()
    return float("-inf") if k >= total else float("inf") if k <= 0 else last_key(keys, k)


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, passage: int = PASSAGE, **fitting) -> DataFrame:
    """The rows of ``docs`` whose key is among the k greatest, with all their columns."""
    model = fit(docs, labels, passage=passage, **fitting)
    weight, key = fresh(docs, "_weight"), fresh(docs, "_key")
    keyed = _keyed(docs, model, weight, key, passage)
    only = _keyed(docs.select("doc_id", "text"), model, "log_weight", "key", passage)
    bound = _bound(save_point(only.select("log_weight", "key")), model, k)
    return keyed.where(F.col(key) >= F.lit(bound)).drop(weight, key)
