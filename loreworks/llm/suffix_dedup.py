"""Removal of repeated passages by a column-wise multi-document suffix order.

A byte goes if a string of ``length`` bytes covers it that also starts earlier (smaller doc_id, or earlier in
the same document).  Matches are judged on the input and never cross documents.

1. Anchors.  Every string of ``length`` bytes picks its least ``GRAM``-byte hash (leftmost of ties).  Equal
   strings pick equal grams at equal offsets, so strings can only be equal where anchors are.  Consecutive
   starts that share an anchor form one frame of at most 2 * length - GRAM bytes.
2. Grams that occur once in the corpus are ruled out: hashes are counted per shard, and each document gets
   back those of its hashes that occur again.
3. Frames of the other anchors are dealt by gram hash; a task sends equal frames once, the first of them, and
   marks the others as repeats.  Each shard lays its frames out by column, aligned at the anchor, and builds
   their order column by column from the last to the first: each round inserts one symbol of every frame,
   sorts stably by it (the symbols in their present order are the column's Burrows-Wheeler transform), and
   updates the common prefix of neighbours by a range minimum over the column before.  Suffixes that start in
   different columns can't match, so a segment of the transform for each column is enough, and only the last
   one is read again: columns are visited once, in sequence.  Neighbours with a common prefix of at least
   ``length`` are equal strings; all but the first of them are repeats.
4. Repeats become byte ranges, gathered by document.

Nothing is sampled: each string is judged.  Work is linear in bytes; a shard holds about
input / ``spark.sql.shuffle.partitions`` and no more than one frame of each content per task.

Defined cases: a null text is an empty one; texts shorter than ``length`` lose nothing; a row without doc_id
takes no part; rows with the same doc_id and text share their result, and none of them starts earlier than
the other; further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreworks.llm.words import fresh, mix, slices, text_bytes

LENGTH = 100
GRAM = 32
PIECE = 1 << 18
_U = np.uint64
_PLACE = _U((1 << 20) - 1)
#: Odd multipliers of the four words of a gram.
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


def frames(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of starts that share an anchor in the texts ``data[offsets[i]:offsets[i + 1]]`` (2**20 bytes at most).

    Returns text index, first start, last start, anchor (all within ``data``) and the anchor's gram hash.
    """
    n, span = len(data), length - GRAM + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    eight = np.ndarray((n - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    grams = n - GRAM + 1
    h = eight[:grams] * _ODD[0]
    for k in (1, 2, 3):
        h += eight[8 * k : 8 * k + grams] * _ODD[k]
    h = mix(h)
    least, width = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    edge = np.zeros(n + 1, np.int64)  # starts of strings that would cross the end of their text
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(least)] == 0)
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    last = starts[np.append(head[1:] - 1, len(starts) - 1)] if len(head) else starts[:0]
    first, anchor = starts[head], anchor[head]
    return np.searchsorted(offsets, first, "right") - 1, first, last, anchor, h[anchor]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Frames of all texts, with places counted from the start of each text."""
    for a, b in slices(offsets, PIECE):
        if b - a > 1 or offsets[b] - offsets[a] <= PIECE:
            parts = [(0, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        else:  # a long text: starts are dealt to pieces
            whole = data[offsets[a] : offsets[b]]
            cuts = [(s, whole[s : s + PIECE + length - 1]) for s in range(0, len(whole), PIECE)]
            parts = [(s, part, np.array([0, len(part)])) for s, part in cuts]
        for base, part, edges in parts:
            owner, first, last, anchor, gram = frames(part, edges, length)
            shift = base - edges[:-1][owner] if len(owner) else 0
            yield owner + a, first + shift, last + shift, anchor + shift, gram


def _all_frames(data, offsets, length):
    found = list(_pieces(data, offsets, length))
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else empty


def _packed(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _ask(length: int, shards: int):
    """By shard: the documents (fingerprint, number of hashes) and their gram hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            prints = np.asarray(batch.column(0))
            owner, *_, gram = _all_frames(data, offsets, length)
            shard = (gram % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(edges)):
                part = order[edges[k] : edges[k + 1]]
                at = np.flatnonzero(np.diff(owner[part], prepend=-1))
                yield _packed(
                    shard=pa.array([k], pa.int32()), prints=pa.array([prints[owner[part[at]]].tobytes()]),
                    counts=pa.array([np.diff(at, append=len(part)).astype(np.uint32).tobytes()]), grams=pa.array([gram[part].tobytes()]),
                )

    return run


def _answer(shards: int):
    """The hashes of a shard that occur again anywhere, with the prints of their documents, by range of prints."""

    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        grams = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs.grams])
        owner = np.concatenate([np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(n, np.uint32)) for ids, n in zip(blobs.prints, blobs.counts, strict=True)])
        _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(count[at] > 1)
        target = owner[hit].view(np.uint64) % _U(shards)
        order = hit[np.argsort(target, kind="stable")]
        edges = np.searchsorted(np.sort(target), np.arange(shards + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(edges))
        cut = [order[edges[k] : edges[k + 1]] for k in some]
        return pd.DataFrame({
            "target": some.astype(np.int32), "prints": pd.Series([owner[x].tobytes() for x in cut], dtype=object), "grams": pd.Series([grams[x].tobytes() for x in cut], dtype=object),
        })

    return run


def _by_print(blobs: pd.DataFrame) -> pd.DataFrame:
    """One row for each document of a range of prints: its hashes that occur again."""
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in blobs.prints])
    grams = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs.grams])
    order = np.argsort(owner, kind="stable")
    owner, grams = owner[order], grams[order]
    head = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
    lists = [grams[s:e].tobytes() for s, e in zip(head, np.append(head[1:], len(owner)), strict=True)]
    return pd.DataFrame({"print": owner[head], "again": pd.Series(lists, dtype=object)})


FRAME = "shard int, ids binary, prints binary, firsts binary, lefts binary, starts binary, bytes binary, repeated binary"


def _frames_of(length: int, shards: int, doc_id: int, text: int):
    """By shard: frames of anchors that occur again.  Rows: those of the table (``doc_id`` and ``text`` are places
    of columns), print, its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(doc_id).is_valid())
            data, offsets = text_bytes(batch.column(text))
            prints, ids = np.asarray(batch.column(batch.num_columns - 2)), np.asarray(batch.column(doc_id).cast(pa.int64()))
            owner, first, last, anchor, gram = _all_frames(data, offsets, length)
            lists = [np.sort(np.frombuffer(x, np.uint64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            edges = np.searchsorted(owner, np.arange(len(lists) + 1))
            keep = [np.isin(gram[s:e], x, kind="sort") for s, e, x in zip(edges, edges[1:], lists)]
            keep = np.flatnonzero(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
            if not len(keep):
                continue
            keep = keep[np.lexsort((anchor[keep], ids[owner[keep]]))]  # earliest first
            owner, first, last, anchor, gram = (x[keep] for x in (owner, first, last, anchor, gram))
            raw, seen = data.tobytes(), {}
            begin = offsets[owner] + first
            until = offsets[owner] + last + length
            repeated = np.zeros(len(keep), bool)
            content = []
            for i, (s, e, left) in enumerate(zip(begin.tolist(), until.tolist(), (anchor - first).tolist(), strict=True)):
                frame = (left, raw[s:e])
                # a copy with the same doc_id and start is a repeated row and not later
                source = seen.setdefault(frame, i)
                repeated[i] = source != i and (ids[owner[source]], anchor[source]) != (ids[owner[i]], anchor[i])
                content.append(frame[1])
            shard = (gram % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[k] : cuts[k + 1]]
                yield _packed(
                    shard=pa.array([k], pa.int32()), ids=pa.array([ids[owner[part]].tobytes()]), prints=pa.array([prints[owner[part]].tobytes()]),
                    firsts=pa.array([first[part].tobytes()]), lefts=pa.array([(anchor - first)[part].astype(np.uint8).tobytes()]),
                    starts=pa.array([(last - first + 1)[part].astype(np.uint8).tobytes()]),
                    bytes=pa.array([b"".join([content[i] for i in part if not repeated[i]])], pa.large_binary()).cast(pa.binary()),
                    repeated=pa.array([repeated[part].tobytes()]),
                )

    return run


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low..high]`` (both included) for each pair, over a table of power-of-two spans."""
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    table = [values]
    for k in range(int(level.max(initial=0))):
        table.append(np.minimum(table[k][: len(table[k]) - (1 << k)], table[k][1 << k :]))
    out = np.empty(len(low), values.dtype)
    for k, row in enumerate(table):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
    return out


def suffix_columns(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Orders of the suffixes that start in each column, from the last to the first.

    ``symbols``: a row for each column, a column for each document, under 256 rows.  Yields the column, the
    documents in the order of their suffixes, the common prefix of each with the one before, and the symbols
    inserted, in the order before the insertion (the column's segment of the transform).
    """
    count = symbols.shape[1]
    order, common = np.arange(count), np.zeros(count, np.uint8)
    for column in range(len(symbols) - 1, -1, -1):
        inserted = symbols[column][order]
        by = np.argsort(inserted, kind="stable")
        now = inserted[by]
        same = np.flatnonzero(now[1:] == now[:-1]) + 1
        fresh = np.zeros(count, np.uint8)
        fresh[same] = 1 + _range_min(common, by[same - 1] + 1, by[same])
        order, common = order[by], fresh
        yield column, order, common, inserted


def _repeats(length: int):
    """Byte ranges of the repeats among the frames of a shard."""
    span = length - GRAM + 1

    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        col = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in blobs[name]])
        ids, prints, first, repeated = col("ids", np.int64), col("prints", np.int64), col("firsts", np.int64), col("repeated", bool)
        left, starts = col("lefts", np.uint8).astype(np.int64), col("starts", np.uint8).astype(np.int64)
        data = np.frombuffer(b"".join(blobs["bytes"]), np.uint8)
        own = np.flatnonzero(~repeated)
        size = starts[own] + length - 1
        edge = np.concatenate([[0], np.cumsum(size)])
        symbols = np.zeros((span - 1 + length, len(own)), np.uint8)
        for a in range(0, len(own), 4096):  # laid out a few at a time: the places take more room than the bytes
            n = size[a : a + 4096]
            row = np.repeat(np.arange(a, a + len(n)), n)
            place = np.arange(n.sum()) + np.repeat(span - 1 - left[own[a : a + 4096]] - (edge[a : a + len(n)] - edge[a]), n)
            symbols[place, row] = data[edge[a] : edge[a + len(n)]]
        rank = np.empty(len(own), np.int64)
        anchor = first[own] + left[own]
        by = np.lexsort((anchor, ids[own]))
        tie = np.zeros(len(own), np.int64)  # repeated rows have equal ranks
        tie[1:] = (ids[own][by][1:] != ids[own][by][:-1]) | (anchor[by][1:] != anchor[by][:-1])
        rank[by] = np.cumsum(tie)
        begin = span - 1 - left[own]  # the first and last column where a string of each frame starts
        end = begin + starts[own] - 1
        hit = np.zeros((span, len(own)), bool)
        for column, order, common, _ in suffix_columns(symbols):
            if column < span:
                group = np.cumsum(common < length)
                valid = (begin[order] <= column) & (column <= end[order])
                who, group = order[valid], group[valid]
                if len(who):
                    head = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
                    earliest = np.minimum.reduceat(rank[who], head)
                    hit[column, who] = rank[who] > np.repeat(earliest, np.diff(head, append=len(who)))
        # runs of columns that hit become ranges of bytes
        flat = np.zeros((len(own), span + 2), np.int8)
        flat[:, 1:-1] = hit.T
        step = np.diff(flat, axis=1)
        who, opens = np.nonzero(step == 1)
        closes = np.nonzero(step == -1)[1]
        base = (first[own] + left[own])[who] - (span - 1)
        gone = np.flatnonzero(repeated)
        return pd.DataFrame({
            "doc_id": np.concatenate([ids[own][who], ids[gone]]), "print": np.concatenate([prints[own][who], prints[gone]]),
            "low": np.concatenate([base + opens, first[gone]]), "high": np.concatenate([base + closes - 1 + length, first[gone] + starts[gone] - 1 + length]),
        })

    return run


def _print() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` and, behind its columns, ``{doc_id, low, high}`` byte ranges that go; they may overlap, and those
    of another doc_id don't count.

    Documents are looked up by a print of doc_id and text, once for their frames and once for their ranges.  Both
    joins start from the same rows, so that these are shuffled once.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = (
        docs.where("doc_id is not null").where(F.octet_length("text") >= length).select(_print().alias("print"), "text")
        .mapInArrow(_ask(length, shards), "shard int, prints binary, counts binary, grams binary")
    )
    hits = asked.groupBy("shard").applyInPandas(_answer(shards), "target int, prints binary, grams binary")
    again = hits.groupBy("target").applyInPandas(_by_print, "print long, again binary")
    own, other, lists = fresh(docs, "_print"), fresh(docs, "_ranges"), fresh(docs, "_again")
    base = docs.withColumn(own, _print())
    place = docs.columns.index
    framed = base.join(again.select(F.col("print").alias(own), F.col("again").alias(lists)).hint("shuffle_hash"), own).select(*[f"`{c}`" for c in docs.columns], own, lists)
    found = framed.mapInArrow(_frames_of(length, shards, place("doc_id"), place("text")), FRAME).groupBy("shard").applyInPandas(_repeats(length), "doc_id long, print long, low long, high long")
    ranges = found.groupBy(F.col("print").alias(own)).agg(F.collect_list(F.struct("doc_id", "low", "high")).alias(other))
    return base.join(ranges.hint("shuffle_hash"), own, "left").select(*[f"`{c}`" for c in docs.columns], other)


def merged(ranges: list[dict] | None, doc_id: int | None) -> list[tuple[int, int]]:
    """Disjoint ranges of ``doc_id`` in order; those that touch are one."""
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges or () if r["doc_id"] == doc_id):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for low, high in gone:
        parts.append(text[at:low])
        at = high
    return b"".join([*parts, text[at:]])


def dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, gone = (text or "").encode(), merged(ranges, doc_id)
                rows.append((len(raw), sum(h - low for low, h in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()))
            size, removed, spans, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield _packed(doc_id=batch.column(0), n_bytes=pa.array(size, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept_sha256=pa.array(digest, pa.string()))

    marked = _with_ranges(docs.select("doc_id", "text"), length)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes: ``text`` and ``n_chars`` (if there) change, other columns stay.

    What is left of a character that was cut goes too.  A document that loses all of its text goes.
    """
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, touched = batch.column(names.index("text")).to_pylist(), [], []
            ids = batch.column(names.index("doc_id")).to_pylist()
            for i, ranges in enumerate(batch.column(len(names)).to_pylist()):
                gone = merged(ranges, ids[i])
                if gone:
                    texts[i] = _kept(texts[i].encode(), gone).decode("utf-8", "ignore")
                touched.append(bool(gone))
                keep.append(not gone or texts[i] != "")
            columns = list(batch.columns[: len(names)])
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                at = names.index("n_chars")
                size = pa.array([len(t) if t is not None else None for t in texts])
                columns[at] = pa.compute.if_else(pa.array(touched), size.cast(columns[at].type), columns[at])
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return _with_ranges(docs, length).mapInArrow(run, docs.schema)
