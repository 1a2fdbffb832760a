"""Change streams: filtering, quiet-period batches, incremental re-indexing, de-duplication."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators import chunking, corpus
from loreworks.session import save_point
from loreworks.sources.files import Rules, matches_any, whole_dirs
from loreworks.sources.tables import IndexTable

DEFAULT_DELAY = "10 minutes"
MERGE_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def admit_changes(stream: DataFrame, rules: Rules) -> DataFrame:
    """Changed paths {rel_path, path, …} worth re-indexing; stateless, so it scales with the source.

    Cheap directory tests come before the globs, and the verdicts are those of the file scan.
    """
    folders = F.slice(F.split("rel_path", "/"), F.lit(1), F.size(F.split("rel_path", "/")) - 1)
    banned = [*whole_dirs(rules.deny), *whole_dirs(rules.exclude)]
    below = F.exists(folders, lambda p: p.isin(*banned)) if banned else F.lit(False)
    rel, absolute = F.col("rel_path"), F.col("path")
    return stream.where(
        ~below & ~matches_any(rel, absolute, rules.deny) & ~matches_any(rel, absolute, rules.exclude)
        & tx.content_kind(rel).isNotNull()
    )


@contextmanager
def merged_early(spark: SparkSession) -> Iterator[None]:
    """Session streams started inside merge the sessions of each partition before the exchange.

    With few keys, the task of a key then gets a row for each partition and session instead of one for each change.
    """
    before = spark.conf.get(MERGE_EARLY, None)
    spark.conf.set(MERGE_EARLY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(MERGE_EARLY)
        else:
            spark.conf.set(MERGE_EARLY, before)


def quiet_batches(stream: DataFrame, gap: str = "2 seconds", key: str = "collection", delay: str = DEFAULT_DELAY) -> DataFrame:
    """{key, start, end, paths}: each burst of changes, once it has been quiet for ``gap``.

    One session per ``key``; a path that changes many times in a burst is kept once, so the
    state holds distinct paths.  Start it within :func:`merged_early` where keys are few.
    """
    windowed = stream.withWatermark("ts", delay).groupBy(F.col(key), F.session_window("ts", gap))
    return windowed.agg(F.collect_set("rel_path").alias("paths")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "paths"
    )


def dedupe_stream(stream: DataFrame, key: str = "seq", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Each sequence number once within the watermark; the checkpoint resumes where it stopped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def event_rates(stream: DataFrame, width: str = "1 minute", delay: str = DEFAULT_DELAY) -> DataFrame:
    """{start, type, n} per tumbling window."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "type", "n")
    )


def whole_chunks(live: DataFrame) -> DataFrame:
    """{doc_id, chunk_id, ordinal, anchor, text} of documents, cut by content kind."""
    docs = live.select("doc_id", "collection", "project", "rel_path", "kind", "text")
    return chunking.chunk_documents(docs).select("doc_id", "chunk_id", "ordinal", "anchor", "text")


def index_tables(spark: SparkSession, root: str) -> tuple[IndexTable, IndexTable, IndexTable]:
    """(hashes {doc_id, content_hash}, chunks {doc_id, chunk_id, ordinal, anchor, text, text_hash}, vectors {text_hash, vec}).

    Vectors belong to contents, not to documents: a text has one, however many chunks share it or come back to it.
    """
    return IndexTable(spark, f"{root}/hashes"), IndexTable(spark, f"{root}/chunks"), IndexTable(spark, f"{root}/vectors", "text_hash", by_prefix=True)


def create_index(spark: SparkSession, root: str) -> None:
    """The three tables without rows."""
    hashes, chunks, vectors = index_tables(spark, root)
    hashes.append(spark.createDataFrame([], "doc_id long, content_hash string"))
    chunks.append(spark.createDataFrame([], "doc_id long, chunk_id string, ordinal int, anchor string, text string, text_hash string"))
    vectors.append(spark.createDataFrame([], "text_hash string, vec array<float>"))


def chunk_vectors(spark: SparkSession, root: str) -> DataFrame:
    """{doc_id, chunk_id, vec} of the whole index."""
    _, chunks, vectors = index_tables(spark, root)
    return chunks.read().select("doc_id", "chunk_id", "text_hash").join(vectors.read(), "text_hash").select("doc_id", "chunk_id", "vec")


def reindex_batch(
    changes: DataFrame, root: str, embed_fn: Callable | None = None, chunk_fn: Callable[[DataFrame], DataFrame] = whole_chunks, tag: str = ""
) -> DataFrame:
    """Apply one batch of changed documents to the index tables below ``root`` and return {action, n}.

    ``changes`` is {doc_id, collection, project, rel_path, kind, text, deleted}.  Unchanged texts (by hash) touch
    nothing; the others have their chunks replaced, deleted ones lose them.  Only the stored hashes of these
    documents and the vectors of their chunks' contents are looked up, and each table gets one delta, so the work
    follows the batch and not the index.  The hashes are written last: a batch that failed midway is judged as
    before when it is replayed, and a ``tag`` that was written is not written again.
    """
    hashes, chunks, vectors = index_tables(changes.sparkSession, root)
    known = hashes.lookup(changes).select("doc_id", F.col("content_hash").alias("_was"))
    judged = save_point(
        changes.withColumn("content_hash", F.sha2("text", 256))
        .join(known, "doc_id", "left")
        .withColumn(
            "action",
            F.when(F.col("deleted"), "removed").when(F.col("_was").isNull(), "new")
            .when(F.col("_was") == F.col("content_hash"), "unchanged").otherwise("changed"),
        )
    )
    live = judged.where(F.col("action").isin("new", "changed"))
    gone = judged.where("action = 'removed'").select("doc_id")
    cut = save_point(chunk_fn(live).withColumn("text_hash", F.sha2("text", 256)))
    cache = save_point(vectors.lookup(cut.select("text_hash").distinct()))
    _, fresh, _ = corpus.embed_with_cache(cut, cache, embed_fn)
    vectors.append(fresh, tag=tag)
    # a document that shrank to nothing has no rows, and is removed like a deleted one
    chunks.append(cut, removed=gone.unionByName(live.select("doc_id")), tag=tag)
    hashes.append(live.select("doc_id", "content_hash"), removed=gone, tag=tag)
    return judged.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def drop_unused_vectors(spark: SparkSession, root: str) -> None:
    """Remove the vectors of contents that no chunk has any more: one pass over the index, for quiet times."""
    _, chunks, vectors = index_tables(spark, root)
    unused = save_point(vectors.read().select("text_hash").join(chunks.read().select("text_hash"), "text_hash", "left_anti"))
    vectors.append(vectors.read().limit(0), removed=unused)
    vectors.compact()


def reindex_stream(
    stream: DataFrame, root: str, checkpoint: str, embed_fn: Callable | None = None, chunk_fn: Callable[[DataFrame], DataFrame] = whole_chunks
):
    """Keep the index tables below ``root`` current from a change stream; what each batch did is in ``log/batch=N``.

    Within one micro-batch only a document's latest change counts.  A batch that is replayed after a failure is known
    by its tag and finds its hashes already stored, so it changes nothing.
    """
    def apply(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c not in ("doc_id", "ts")]
        latest = batch.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "ts").alias("_r")).select("doc_id", "_r.*")
        tag = f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{number}"
        reindex_batch(latest, root, embed_fn, chunk_fn, tag).write.mode("overwrite").parquet(f"{root}/log/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
