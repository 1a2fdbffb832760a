"""Token ids in files, compressed by Re-Pair grammars, with random access.

Documents are encoded in ascending doc_id order and collected into shards of about ``SHARD`` ids.  Each shard has
a grammar of its own: in rounds, the frequent pairs of neighbouring symbols (never across documents) get
nonterminals and are replaced, where two overlap the more frequent one; pairs that have a rule already are
replaced too.  Rounds end when no pair is frequent, or when the rules have run out and none is left to apply.  A shard stores its rules, the length each rule expands to, and the symbols, so that any span of
a document is decoded without the rest: lengths are summed to find the symbols that cover it.

The files are a Parquet table in the shared folder, a row for each shard: ``part, seq`` (their order),
``doc_ids``, ``n_tokens`` and ``payload``, which is, in little-endian numbers:

    magic "RPG1", base, rules, documents, symbols (uint32 each), width of a symbol in bytes (uint32)
    left and right symbol of each rule (uint32), length of each rule (uint32)
    end of each document in symbols (uint64), end of each document in ids (uint64)
    symbols (uint16 or uint32); those from ``base`` on are rules

Defined cases: a null text is an empty one and has the end id only; a null doc_id comes first; rows with equal
doc_id are ordered by their text's hash; a document longer than a shard is a shard alone; an empty table gives
no shards; further columns are left alone.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreworks.llm.token_counts import cuts_at_spaces, library, lowers
from loreworks.llm.units import UnitTable, text_slices

SHARD = 1 << 20
#: A pair is frequent from this number of occurrences on.
FREQUENT = 8
NEW_RULES = 4096
END = 1
MAGIC = b"RPG1"
_NONE = np.iinfo(np.int32).max


@dataclass
class Grammar:
    base: int  # symbols from here on are rules
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # ids that each rule expands to
    symbols: np.ndarray
    ends: np.ndarray  # end of each document in symbols
    id_ends: np.ndarray  # and in ids


def _slots(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)


def _frequent(key: np.ndarray, slot: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur ``least`` times or more, and how often: rare ones are ruled out by counts of hash buckets."""
    pair, count = np.unique(key[(np.bincount(slot, minlength=1 << 20) >= least)[slot]], return_counts=True)
    return pair[count >= least], count[count >= least]


def _rules_of(pairs: np.ndarray, key: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Place in ``pairs`` of each key, or ``_NONE``: a table of hash slots finds all but the pairs that share one."""
    own = _slots(pairs)
    table = np.full(1 << 20, -1, np.int32)
    table[own[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]  # the first of those that share a slot
    found = table[slot]
    rule = np.where((found >= 0) & (pairs[found] == key), found, _NONE).astype(np.int32)
    later = np.flatnonzero(table[own] != np.arange(len(pairs)))
    if len(later):
        shared = np.zeros(1 << 20, bool)
        shared[own[later]] = True
        at = np.flatnonzero(shared[slot] & (rule == _NONE))
        order = later[np.argsort(pairs[later])]
        place = np.minimum(np.searchsorted(pairs[order], key[at]), len(order) - 1)
        hit = pairs[order][place] == key[at]
        rule[at[hit]] = order[place[hit]]
    return rule


def compress(ids: np.ndarray, counts: np.ndarray, base: int, rounds: int | None = None, least: int = FREQUENT, limit: int | None = None) -> Grammar:
    """Re-Pair grammar of documents given end to end.  ``rounds``: at most; None goes on to the end.  ``limit``: rules at most; None fills 16 bits, or has no bound."""
    symbols = ids.astype(np.uint32)
    ends = np.cumsum(counts)
    if limit is None:
        limit = (1 << 16) - base if base < 1 << 16 else (1 << 31) - base
    pairs, left, right = np.zeros(0, np.uint64), [], []
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(symbols) < 2:
            break
        key = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        inner = np.ones(len(key), bool)
        cut = ends[(ends > 0) & (ends < len(symbols))] - 1
        inner[cut] = False
        slot = _slots(key)
        pair, count = _frequent(key[inner], slot[inner], least)
        new = ~np.isin(pair, pairs, assume_unique=True)
        order = np.argsort(-count[new], kind="stable")[: min(NEW_RULES, limit - len(pairs))]
        fresh = pair[new][order]
        if not len(fresh) and not len(pairs):
            break
        left.append((fresh >> np.uint64(32)).astype(np.uint32))
        right.append((fresh & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        pairs = np.concatenate([pairs, fresh])
        # rules made earlier were the more frequent: a lower number goes first
        rule = np.where(inner, _rules_of(pairs, key, slot), _NONE).astype(np.int32)
        before = np.concatenate([[_NONE], rule[:-1]]).astype(np.int32)
        after = np.append(rule[1:], _NONE).astype(np.int32)
        take = (rule < _NONE) & (rule <= before) & (rule <= after)
        runs = np.flatnonzero(take & ((rule == before) | (rule == after)))  # a a a: every other one
        if len(runs):
            first = np.ones(len(runs), bool)
            first[1:] = (runs[1:] != runs[:-1] + 1) | (rule[runs[1:]] != rule[runs[:-1]])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(runs)), 0))
            take[runs[(np.arange(len(runs)) - begin) % 2 == 1]] = False
        at = np.flatnonzero(take)
        if not len(at):
            break
        symbols[at] = base + rule[at].astype(np.uint32)
        gone = np.zeros(len(symbols), bool)
        gone[at + 1] = True
        ends = ends - np.cumsum(gone)[ends - 1] if len(ends) else ends
        symbols = symbols[~gone]
    left = np.concatenate([*left, np.zeros(0, np.uint32)])
    right = np.concatenate([*right, np.zeros(0, np.uint32)])
    grammar = Grammar(base, left, right, np.zeros(len(left), np.uint32), symbols, ends, np.cumsum(counts))
    for at in _levels(grammar):
        grammar.length[at] = _length(grammar, left[at]) + _length(grammar, right[at])
    return grammar


def _length(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < g.base, 1, g.length[np.maximum(symbols.astype(np.int64) - g.base, 0)] if len(g.length) else 1).astype(np.int64)


def _levels(g: Grammar) -> Iterator[np.ndarray]:
    """Rules by depth: the parts of each are ids or rules that came before."""
    open_ = np.arange(len(g.left))
    known = np.zeros(len(g.left) + 1, bool)
    known[-1] = True  # stands for ids
    place = lambda s: np.where(s < g.base, len(g.left), s.astype(np.int64) - g.base)
    while len(open_):
        ready = known[place(g.left[open_])] & known[place(g.right[open_])]
        yield open_[ready]
        known[open_[ready]] = True
        open_ = open_[~ready]


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i], begin[i] + 1, ...``, ``size[i]`` of each."""
    edge = np.cumsum(size)
    return np.repeat(begin - (edge - size), size) + np.arange(edge[-1] if len(edge) else 0)


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """Ids that ``symbols`` stand for."""
    size = np.concatenate([np.ones(g.base, np.int64), g.length.astype(np.int64)])
    begin = np.cumsum(size) - size
    flat = np.arange(size.sum(), dtype=np.uint32)  # ids stand for themselves
    for at in _levels(g):
        to = begin[g.base + at]
        for part in (g.left[at], g.right[at]):
            flat[_spans(to, size[part])] = flat[_spans(begin[part], size[part])]
            to = to + size[part]
    return flat[_spans(begin[symbols], size[symbols])]


def pack(g: Grammar) -> bytes:
    width = 2 if g.base + len(g.left) <= 1 << 16 else 4
    head = struct.pack("<4s5I", MAGIC, g.base, len(g.left), len(g.ends), len(g.symbols), width)
    parts = [(g.left, "<u4"), (g.right, "<u4"), (g.length, "<u4"), (g.ends, "<u8"), (g.id_ends, "<u8"), (g.symbols, f"<u{width}")]
    return head + b"".join(x.astype(kind).tobytes() for x, kind in parts)


def unpack(raw: bytes) -> Grammar:
    magic, base, rules, docs, symbols, width = struct.unpack_from("<4s5I", raw)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at, found = struct.calcsize("<4s5I"), []
    for n, kind in ((rules, "<u4"), (rules, "<u4"), (rules, "<u4"), (docs, "<u8"), (docs, "<u8"), (symbols, f"<u{width}")):
        found.append(np.frombuffer(raw, kind, n, at))
        at += found[-1].nbytes
    left, right, length, ends, id_ends, body = found
    return Grammar(base, left, right, length, body, ends.astype(np.int64), id_ends.astype(np.int64))


def read_span(raw: bytes, document: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a document of a shard; only the symbols that cover them are expanded."""
    g = unpack(raw)
    mine = g.symbols[g.ends[document - 1] if document else 0 : g.ends[document]]
    edge = np.cumsum(_length(g, mine))
    first, last = np.searchsorted(edge, start, "right"), np.searchsorted(edge, stop, "left")
    skip = start - (edge[first - 1] if first else 0)
    return expand(g, mine[first : last + 1])[skip : skip + stop - start]


@lru_cache(maxsize=2)
def _table(path: str):
    encode = library(path)
    return UnitTable(encode, lowers(path)) if cuts_at_spaces(path) else None, encode


def _size(path: str) -> int:
    """Ids of the file's vocabulary, added tokens included."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _lookup(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    table, encode = _table(path)
    if table:
        return table.lookup(texts)
    found = encode(texts)
    return np.fromiter((i for x in found for i in x), np.int32), np.fromiter(map(len, found), np.int64, len(found))


def _with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end, np.int32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    out[inner] = ids
    return out, counts + 1


def write_ids(docs: DataFrame, path: str, folder: str, end: int = END, shard: int = SHARD) -> None:
    """Encode ``text`` of all rows with the tokenizer file ``path`` and write the files to ``folder``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = max(_size(path), end + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held_ids, held_counts, held_docs, total = [], [], [], 0

        def close():
            g = compress(np.concatenate(held_ids), np.concatenate(held_counts), base)
            names = pa.concat_arrays(held_docs)
            lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), lists, pa.array([total], pa.int64()), pa.array([pack(g)], pa.binary())], ["part", "seq", "doc_ids", "n_tokens", "payload"]
            )

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for s, e in text_slices(texts):
                    ids, counts = _with_end(*_lookup(path, texts[s:e]), end)
                    if held_ids and total + len(ids) > shard:
                        yield close()
                        seq += 1
                        held_ids, held_counts, held_docs, total = [], [], [], 0
                    held_ids.append(ids)
                    held_counts.append(counts)
                    held_docs.append(rows.column(0).slice(s, e - s))
                    total += len(ids)
        if held_ids:
            yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, f"part long, seq long, doc_ids array<{kind}>, n_tokens long, payload binary").write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files: ``ids`` as little-endian uint32 bytes, ``start``
    counts the ids of all documents before it."""
    table = spark.read.parquet(folder)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names = batch.column(2).slice(i, 1).flatten()
                g = unpack(batch.column(3)[i].as_py())
                ids = expand(g, g.symbols)
                for a in range(0, len(names), 1024):
                    ends = g.id_ends[a : a + 1024]
                    begin = np.concatenate([[g.id_ends[a - 1] if a else 0], ends[:-1]])
                    raw = pa.array([ids[s:e].astype("<u4").tobytes() for s, e in zip(begin, ends, strict=True)], pa.binary())
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())), names.slice(a, n), pa.array(begin), pa.array(ends - begin), raw],
                        ["part", "seq", "doc_id", "begin", "n_tokens", "ids"],
                    )

    rows = table.select("part", "seq", "doc_ids", "payload").mapInArrow(run, f"part long, seq long, doc_id {kind}, begin long, n_tokens long, ids binary")
    return rows.join(shard_starts(table), ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids")


def shard_starts(table: DataFrame) -> DataFrame:
    """``part, seq, before``: ids in all shards before each.  Summed within parts, then over the parts' totals."""
    sizes = table.select("part", "seq", "n_tokens")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("parts_before"))
    own = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shards_before"))
    return own.join(parts, "part").select("part", "seq", (F.col("parts_before") + F.col("shards_before")).alias("before"))
