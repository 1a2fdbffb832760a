"""Corpus bookkeeping: incremental diffs, caches, vectors, health and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.functions.vectors import normalise
from loreworks.operators.scale import running
from loreworks.session import save_point
from loreworks.sources.tables import IndexTable

KEY = ("collection", "rel_path")
#: Children of a node of the fingerprint, and levels above the texts.
FAN, HEIGHT = 4096, 4


def kind_counts(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def diff_corpus(current: DataFrame, known: DataFrame) -> DataFrame:
    """{collection, rel_path, action}: new / changed / unchanged / removed, by content hash.

    One shuffle of both sides on the document key; hashes travel, texts do not.
    """
    cur = current.select(*KEY, F.col("content_hash").alias("_now"))
    old = known.select(*KEY, F.col("content_hash").alias("_was"))
    action = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_now").isNull(), "removed")
        .when(F.col("_now") == F.col("_was"), "unchanged")
        .otherwise("changed")
    )
    return cur.join(old, list(KEY), "full_outer").select(*KEY, action.alias("action"))


def cascade_delete(removed: DataFrame, *tables: DataFrame, key: str = "doc_id") -> tuple[DataFrame, ...]:
    """Each table without the rows derived from the removed documents."""
    gone = removed.select(key).distinct()
    return tuple(t.join(gone, key, "left_anti") for t in tables)


def prune(table: DataFrame, keep: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose document is still in the corpus."""
    return table.join(keep.select(key).distinct(), key, "left_semi")


def hashing_embedder(dim: int = 64) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Deterministic stand-in for a model: signed word hashing, unit length.

    Takes batches of {text_hash, text}, gives {text_hash, vec}.
    """
    import re
    import zlib

    words = re.compile(tx.WORD)

    def embed(batch_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch_iter:
            out = np.zeros((len(pdf), dim))
            for i, text in enumerate(pdf["text"]):
                for word in words.findall(text.lower()):
                    h = zlib.crc32(word.encode("utf-8"))
                    out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            norms = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
            vecs = (out / norms).astype(np.float32)
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "vec": list(vecs)})

    return embed


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct {text_hash, text} whose vector is not cached: the only texts worth embedding."""
    texts = chunks.select("text_hash", "text").dropDuplicates(["text_hash"])
    return texts.join(cache.select("text_hash"), "text_hash", "left_anti")


def cache_stats(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """{chunks, cached, embedded}: hits and misses counted per chunk, as texts are looked up."""
    known = cache.select("text_hash").distinct().withColumn("_hit", F.lit(1))
    return (
        chunks.groupBy("text_hash").agg(F.count(F.lit(1)).alias("_n"))
        .join(known, "text_hash", "left")
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"),
            F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("cached"),
            F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("embedded"),
        )
    )


def embed_with_cache(
    chunks: DataFrame, cache: DataFrame, embed_fn: Callable | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors {chunk_id, vec}, fresh cache rows {text_hash, vec}, stats).

    Only missing texts reach ``embed_fn``, each once however many chunks share it, ordered by
    length inside a partition so that a model pads little.
    """
    embed_fn = embed_fn or hashing_embedder()
    missing = cache_misses(chunks, cache).sortWithinPartitions(F.char_length("text"))
    fresh = missing.mapInPandas(embed_fn, "text_hash string, vec array<float>")
    every = cache.select("text_hash", F.col("vec").cast("array<float>").alias("vec")).unionByName(fresh)
    vectors = chunks.select("chunk_id", "text_hash").join(every, "text_hash").select("chunk_id", "vec")
    return vectors, fresh, cache_stats(chunks, cache)


def warm_cache(chunks: DataFrame, vectors: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache rows an existing index can supply: one vector per unseen text hash.

    The vector of the smallest chunk id is taken, so a rerun gives the same row.
    """
    have = chunks.select("chunk_id", "text_hash").join(vectors, "chunk_id")
    unseen = have.join(cache.select("text_hash"), "text_hash", "left_anti")
    return unseen.groupBy("text_hash").agg(F.min_by("vec", "chunk_id").alias("vec"))


def index_stats(actions: DataFrame, chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """One row of counters for an index run; each input is aggregated once, to one row."""
    a = actions.agg(
        F.count_if(F.col("action").isin("new", "changed")).alias("documents"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
        F.count_if(F.col("action") == "removed").alias("pruned"),
        F.count_if(F.col("action") == "failed").alias("failed"),
    ).withColumn("_one", F.lit(1))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks")).withColumn("_one", F.lit(1))
    h = hits.select("cached", "embedded").withColumn("_one", F.lit(1))
    total = F.col("cached") + F.col("embedded")
    return (
        a.join(c, "_one").join(h, "_one")
        .withColumn("hit_rate", F.when(total > 0, F.col("cached") / total).otherwise(F.lit(0.0)))
        .drop("_one")
    )


def with_throughput(stats: DataFrame, seconds: float) -> DataFrame:
    rate = F.lit(0.0) if seconds <= 0 else F.round(F.col("embedded") / F.lit(seconds), 2)
    return stats.withColumn("seconds", F.round(F.lit(seconds), 1)).withColumn("chunks_per_second", rate)


def check_compatible(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """{key, stored, expected} for every stored key that disagrees."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    return (
        meta.select("key", F.col("value").alias("stored"), F.try_element_at(want, F.col("key")).alias("expected"))
        .where(F.col("expected").isNotNull() & (F.col("stored") != F.col("expected")))
    )


class IncompatibleIndex(RuntimeError):
    """Stored rows were made with another model, dimension, schema or chunker."""


def require_compatible(meta: DataFrame, expected: dict[str, str]) -> None:
    bad = check_compatible(meta, expected).limit(len(expected)).collect()
    if bad:
        raise IncompatibleIndex(
            "; ".join(f"{r['key']}: stored {r['stored']}, expected {r['expected']}" for r in bad)
        )


def script_census(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(tx.has_cyrillic(F.col("text"))).alias("cyrillic")
    ).withColumn("majority_cyrillic", F.col("cyrillic") * 2 > F.col("total"))


def pool_vectors(chunk_vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """{doc_id, vec}: mean of a document's chunk vectors, unit length.

    Averaged per dimension with map-side partial sums, so a document with very many chunks is
    never gathered in one task; only its ``dim`` sums travel.
    """
    per_dim = chunk_vectors.select(key, F.posexplode("vec").alias("_d", "_v"))
    means = per_dim.groupBy(key, "_d").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    ordered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_s"))
    return ordered.select(key, normalise(F.col("_s._m")).alias("vec"))


def _parents(level: DataFrame, fan: int) -> DataFrame:
    """The level above: digests of runs of at most ``fan`` neighbours, in order."""
    kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
    return level.groupBy(F.floor(F.col("node") / fan).alias("parent")).agg(
        F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(kids, lambda s: s["digest"]), ""), 256).alias("digest")
    ).select(F.col("parent").alias("node"), "n", "digest")


def fingerprint_levels(chunks: DataFrame, order: str = "ordinal", fan: int = FAN, height: int = HEIGHT) -> list[DataFrame]:
    """Levels {node, n, digest} of a hash tree over texts: the texts first, the root (node 0) last.

    Every node has at most ``fan`` children, so no array grows with the corpus; ``fan ** height`` must
    exceed the largest ``order``, or the digest fails instead of leaving texts out.
    """
    levels = [chunks.select(F.col(order).cast("long").alias("node"), F.lit(1).cast("long").alias("n"), F.sha2("text", 256).alias("digest"))]
    for _ in range(height):
        levels.append(_parents(levels[-1], fan))
    return levels


def _sealed(root: DataFrame, key: str) -> DataFrame:
    one = F.coalesce(F.min("node") == 0, F.lit(True)) & F.coalesce(F.max("node") == 0, F.lit(True))
    digest = F.when(one, F.coalesce(F.max("digest"), F.lit(""))).otherwise(F.raise_error(F.lit("the tree is too low for its order: not one root but several")))
    whole = root.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), digest.alias("digest"))
    return whole.select(F.sha2(F.concat(F.lit(f"{key}|"), F.col("n").cast("string"), F.lit("|"), "digest"), 256).alias("digest"))


def fingerprint(chunks: DataFrame, key: str, order: str = "ordinal", fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """{digest}: order-sensitive digest of the texts plus the model key."""
    return _sealed(fingerprint_levels(chunks, order, fan, height)[-1], key)


class FingerprintTree:
    """The hash tree of a corpus, stored by level and renewed along changed paths only.

    Levels are index tables keyed by parent, so that a parent's children are looked up together; a change of m
    texts reads and writes at most m runs of ``fan`` siblings on each level.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN, height: int = HEIGHT):
        self.fan, self.height = fan, height
        self.levels = [IndexTable(spark, f"{path}/level={i}", "parent") for i in range(height + 1)]

    def _with_parent(self, level: DataFrame) -> DataFrame:
        return level.withColumn("parent", F.floor(F.col("node") / self.fan).cast("long"))

    def build(self, chunks: DataFrame, order: str = "ordinal") -> None:
        level = fingerprint_levels(chunks, order, self.fan, 0)[0]
        for table in self.levels:
            table.append(self._with_parent(level).select("parent", "node", "n", "digest"))
            level = _parents(table.read(), self.fan)

    def renew(self, changed: DataFrame, removed: DataFrame, order: str = "ordinal") -> None:
        """Put the texts of ``changed`` in their places and take those of ``removed`` out."""
        fresh = save_point(self._with_parent(fingerprint_levels(changed, order, self.fan, 0)[0]))
        gone = save_point(self._with_parent(removed.select(F.col(order).cast("long").alias("node"))))
        for table in self.levels:
            touched = save_point(fresh.select("parent").unionByName(gone.select("parent")).distinct())
            out = fresh.select("node").unionByName(gone.select("node"))
            kept = table.lookup(touched).join(out, "node", "left_anti").select("parent", "node", "n", "digest")
            now = save_point(kept.unionByName(fresh.select("parent", "node", "n", "digest")))
            table.append(now, removed=touched)
            # a parent that lost all its children goes, the others have a new digest
            above = self._with_parent(_parents(now, self.fan))
            gone = save_point(self._with_parent(touched.withColumnRenamed("parent", "node")).join(above.select("node"), "node", "left_anti"))
            fresh = save_point(above)

    def digest(self, key: str) -> DataFrame:
        return _sealed(self.levels[-1].read(), key)


def index_health(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per collection: documents, last indexed, bytes, failures, chunk and vector counts."""
    per_doc = (
        chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c"))
        .join(vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_v")), "doc_id", "full_outer")
    )
    return (
        documents.join(per_doc, "doc_id", "left")
        .groupBy("collection")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.max("indexed_at").alias("last_indexed"),
            F.sum("size").alias("bytes"),
            F.count_if(F.col("parse_error").isNotNull()).alias("failures"),
            F.coalesce(F.sum("_c"), F.lit(0)).alias("chunks"),
            F.coalesce(F.sum("_v"), F.lit(0)).alias("vectors"),
        )
    )


def read_documents(
    requests: DataFrame, documents: DataFrame, chunks: DataFrame, max_chars: int = 4000
) -> tuple[DataFrame, DataFrame]:
    """(found {request, position, doc_id, text, truncated}, missing {request, position, doc_id}).

    The joined text is rebuilt only for requested documents.  Chunks that start past the cut
    are dropped before anything is gathered, so a long document costs no more than the cut.
    """
    wanted = requests.select("doc_id").distinct()
    known = documents.select("doc_id").join(wanted, "doc_id", "left_semi")
    asked = chunks.join(wanted, "doc_id", "left_semi").select("doc_id", "ordinal", "text")
    sized = running(
        asked, ["doc_id"], "ordinal", {"_upto": (F.char_length("text").cast("long") + 2, "sum")}
    )
    total = sized.groupBy("doc_id").agg((F.max("_upto") - 2).alias("_len"))
    head = sized.where(F.col("_upto") - F.char_length("text") - 2 < max_chars)
    joined = head.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n\n"
        ).alias("_text")
    )
    found = (
        requests.join(known, "doc_id")
        .join(joined, "doc_id", "left")
        .join(total, "doc_id", "left")
        .select(
            "request", "position", "doc_id",
            F.coalesce(F.substring("_text", 1, max_chars), F.lit("")).alias("text"),
            (F.coalesce(F.col("_len"), F.lit(0)) > max_chars).alias("truncated"),
        )
    )
    missing = requests.join(documents.select("doc_id"), "doc_id", "left_anti").select(
        "request", "position", "doc_id"
    )
    return found, missing


