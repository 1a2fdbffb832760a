"""Token counts by way of a digest cache.

The cache is a table ``(version, digest, n_tokens)`` in a folder.  ``version`` is the digest of the tokenizer
file, ``digest`` that of the content as the tokenizer sees it (a null text is an empty one; nothing else is
changed, as this tokenizer doesn't normalise).  Counting joins the documents' digests to the cache, encodes
each distinct miss once, with the library, appends the new counts, and joins again.  A folder without a cache
counts as an empty one, so the first call encodes each distinct text once and later calls only new ones.

Equal texts are one before anything is encoded: first within each task, then by a shuffle.  Distinct misses are
encoded by units (see ``units``), each distinct unit once a worker.

Defined cases: empty texts have no tokens; repeated rows each get their count; strings of special tokens inside
texts count as the library has it by default; two runs that append the same text at once leave two equal rows,
of which one counts; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreworks.llm.units import UnitTable, text_slices

LIMIT = 1024
CACHE = "version string, digest binary, n_tokens long"


@lru_cache(maxsize=4)
def version(path: str) -> str:
    """Digest of a tokenizer file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def library(path: str):
    """``encode(list of str) -> lists of ids`` of a tokenizer file, by its library, without added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def cuts_at_spaces(path: str) -> bool:
    """Whether units may be encoded one by one: the file's pre-tokenizer never lets a token span a space and what is before it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    kinds = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
    return spec["model"]["type"] == "BPE" and '"ByteLevel"' in kinds and '"add_prefix_space": true' not in kinds


def lowers(path: str) -> bool:
    """Whether a tokenizer file lower-cases."""
    with open(path, encoding="utf-8") as file:
        return '"Lowercase"' in json.dumps(json.load(file)["normalizer"])


class _Whole:
    """Encodes whole texts, for tokenizers whose tokens may span spaces."""

    def __init__(self, encode):
        self.encode = encode

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.encode(texts)), np.int64, len(texts))


@lru_cache(maxsize=2)
def counter(path: str):
    """Counter of a tokenizer file; one for each worker process."""
    return UnitTable(library(path), lowers(path)) if cuts_at_spaces(path) else _Whole(library(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            counts = []
            for a in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(a, 512).to_pylist()
                counts += [table.counts(texts[s:e]) for s, e in text_slices(texts)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of a folder; an empty one if it has none."""
    try:
        return spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, path: str, folder: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``; new texts join the cache in ``folder``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    now = version(path)

    def known() -> DataFrame:
        found = read_cache(spark, folder).where(F.col("version") == now)
        return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    # equal texts meet in their task before they are shuffled
    distinct = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    missing = distinct.join(known(), "digest", "left_anti")
    counted = missing.mapInArrow(_count(path), "digest binary, n_tokens long")
    counted.select(F.lit(now).alias("version"), "digest", "n_tokens").write.mode("append").parquet(folder)
    sizes = docs.select("doc_id", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return sizes.join(known(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
