"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is a set of shingles (five words, lower-cased) weighted by how often they occur.  Similarity is
probability Jaccard, which is plain Jaccard where no shingle repeats.  Each shingle sends arrivals of an
exponential process with its weight as rate to random registers; a register keeps the shingle that arrives
first, and a document's arrivals end once none can be earlier than the latest register (early termination).
Two documents agree on a register with the probability of their similarity.

Texts with the same words are one vertex.  Vertices that agree on ``ROWS`` registers of a band meet; in each
such group a few members, least by different hashes, are paired with all (no pairs within the group).  Pairs
whose registers agree often enough are verified on the whole shingle sets and linked.  Groups that still
hold several classes are then compared in tiles of ``TILE`` members, where pairs of different classes that agree
often enough are verified; only links leave a tile.  A class is a connected component of links.

Defined cases: a null text is an empty one; a text without words is in a class of its own; fewer than five
words are one shingle; a row without doc_id gets no class; rows that repeat a doc_id are one vertex; further
columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreworks.llm.words import find_words, mix, shingles, slices, text_bytes
from loreworks.operators.graph import components
from loreworks.session import save_point

REGISTERS = 100
ROWS = 4
CENTRES = 2
SIMILARITY = 0.8
#: Standard deviations by which the registers may understate the similarity of a pair that is verified.
SLACK = 5.0
TILE = 4096
SLICE = 1 << 19
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def weighted_shingles(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, 48-bit hash and count of each distinct shingle, by owner and hash."""
    h, owner = shingles(words)
    key, weight = np.unique((owner.astype(np.uint64) << _U(48)) | (h >> _U(16)), return_counts=True)
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), weight


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (uint32, ``sets`` x ``registers``) of weighted sets given as arrays of their elements."""
    first = np.full(sets * registers, np.inf)
    kept = np.zeros(sets * registers, np.uint32)
    name = mix(element * _GOLDEN)
    live, now, step = np.arange(len(owner)), np.zeros(len(owner)), 0
    while len(live):
        block = int(np.clip(8192 // len(live), 1, 64))  # arrivals of each element at once
        seed = mix(name[live, None] + _GOLDEN * np.arange(step + 1, step + block + 1, dtype=np.uint64))
        step += block
        gap = -np.log(((seed >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weight[live, None]
        at = now[live, None] + np.cumsum(gap, axis=1)
        slot = owner[live, None] * registers + (((mix(seed) >> _U(32)) * _U(registers)) >> _U(32)).astype(np.int64)
        early = at < first[slot]
        when, where = at[early], slot[early]
        who = np.broadcast_to(live[:, None], at.shape)[early]
        np.minimum.at(first, where, when)
        won = first[where] == when
        kept[where[won]] = name[who[won]].astype(np.uint32)
        now[live] = at[:, -1]
        owners = np.unique(owner[live])
        latest = np.zeros(sets)
        latest[owners] = first.reshape(sets, registers)[owners].max(axis=1)
        live = live[now[live] < latest[owner[live]]]
    return kept.reshape(sets, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, each (sorted elements, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    order = np.argsort(wa / wb, kind="stable")
    wa, wb = wa[order], wb[order]
    # the sum over j of max(a_j / a_i, b_j / b_i): those of ratio a_j / b_j from i's on count by a, the others by b
    from_i = np.cumsum(wa[::-1])[::-1] + only_a
    before = np.concatenate([[0.0], np.cumsum(wb)[:-1]]) + only_b
    return float((1.0 / (from_i / wa + before / wb)).sum())


def _sketch(registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, SLICE):
                words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sig = prob_minhash(*weighted_shingles(words), b - a, registers)
                raw, edge = words.hash.tobytes(), 8 * words.first
                same = [hashlib.blake2b(raw[s:e], digest_size=16).digest() if e > s else None for s, e in zip(edge, edge[1:])]
                signature = [sig[i].tobytes() if d else None for i, d in enumerate(same)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(same, pa.binary()), pa.array(signature, pa.binary())], ["doc_id", "digest", "signature"]
                )

    return run


def _bands(registers: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bands = batch.num_rows, registers // rows
            sig = _matrix(batch.column(1).to_pylist(), registers)
            key = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
            for r in range(rows):
                key = mix(key * _GOLDEN + sig[:, r : bands * rows : rows].astype(np.uint64))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), bands)))
            nth = pa.array(np.tile(np.arange(bands, dtype=np.int32), n))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), nth, ids], ["band", "nth", "doc_id"])

    return run


def _matrix(signatures: list[bytes], registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(len(signatures), registers)


def _agreeing(registers: int, least: float):
    """Of rows (a, b, signature of a, of b) those that agree on a share ``least`` of the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = _matrix(batch.column(2).to_pylist(), registers) == _matrix(batch.column(3).to_pylist(), registers)
            near = pa.array(same.mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets as bytes: 32-bit elements, then 32-bit weights."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets, SLICE):
            words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            owner, element, weight = weighted_shingles(words)
            key, at = np.unique((owner.astype(np.uint64) << _U(32)) | (element & _U(0xFFFFFFFF)), return_inverse=True)
            total = np.bincount(at, weight, len(key)).astype(np.uint32)
            small = key.astype(np.uint32)
            edge = np.searchsorted(key >> _U(32), np.arange(b - a + 1))
            packed = [small[s:e].tobytes() + total[s:e].tobytes() for s, e in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(packed, pa.large_binary()).cast(pa.binary())], ["doc_id", "shingles"])


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(_unpack(x.as_py()), _unpack(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
            value = pa.array(found, pa.float64())
            near = pa.array(np.asarray(found, float) >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in (batch.column(0), batch.column(1), value)], ["a", "b", "similarity"])

    return run


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``a, b`` and ``column`` of both of them."""
    left = table.select(F.col("doc_id").alias("a"), F.col(column).alias("_of_a"))
    right = table.select(F.col("doc_id").alias("b"), F.col(column).alias("_of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_of_a", "_of_b")


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, np.uint32)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _tiles(registers: int, rows: int, agree: float, least: float):
    """Rows come by (band, tile); of each tile, the verified links between different classes.

    A pair that shares several bands is looked at in the first of them only, and a link is left out if
    links of the same tile join its classes already.
    """

    def links(tile: pd.DataFrame) -> list[tuple]:
        sig = _matrix(tile.signature.tolist(), registers)
        ids, labels, side = tile.doc_id.to_numpy(), tile.label.to_numpy(), tile.side.to_numpy()
        raw, nth = tile.shingles.tolist(), int(tile.nth.iloc[0])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: the tile of a block with itself
        root = {x: x for x in labels}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i in left:
            same = sig[right] == sig[i]
            close = right[(same.mean(axis=1) >= agree) & (labels[right] != labels[i])]
            if not len(close):
                continue
            bands = (sig[close] == sig[i])[:, : nth * rows].reshape(len(close), nth, rows).all(axis=2)
            for j in close[~bands.any(axis=1)]:
                a, b = find(labels[i]), find(labels[j])
                if a != b and (value := similarity(_unpack(raw[i]), _unpack(raw[j]))) >= least - 1e-9:
                    root[max(a, b)] = min(a, b)
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j]), value))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            band, tile = held.band.to_numpy(), held.tile.to_numpy()
            edges = np.flatnonzero((band[1:] != band[:-1]) | (tile[1:] != tile[:-1])) + 1
            found = [x for s, e in zip(np.concatenate([[0], edges[:-1]]), edges) for x in links(held.iloc[s:e])]
            held = held.iloc[edges[-1] :] if len(edges) else held
            yield pd.DataFrame(found, columns=["a", "b", "similarity"])
        if held is not None and len(held):
            yield pd.DataFrame(links(held), columns=["a", "b", "similarity"])

    return run


def near_duplicates(
    docs: DataFrame, least: float = SIMILARITY, registers: int = REGISTERS, rows: int = ROWS, centres: int = CENTRES
) -> DataFrame:
    """``doc_id, class_id, links`` for every row of ``docs``.

    ``class_id`` is the least doc_id of the class; ``links``: verified links of the row's vertex to others.
    """
    band_rows = save_point(
        docs.select("doc_id", "text").mapInArrow(_sketch(registers), "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", digest binary, signature binary")
    )
    named = band_rows.where("doc_id is not null")
    vertex = named.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("vertex"))
    member = save_point(named.select("doc_id", "digest").distinct().join(vertex, "digest", "left").select("doc_id", F.coalesce("vertex", "doc_id").alias("vertex")))
    sketches = save_point(
        vertex.select(F.col("vertex").alias("doc_id"), "digest").join(named, ["doc_id", "digest"]).dropDuplicates(["doc_id"]).select("doc_id", "signature")
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bands = sketches.mapInArrow(_bands(registers, rows), f"band long, nth int, doc_id {id_type}")
    least_by = [F.min(F.struct(F.xxhash64(F.lit(k), "band", "doc_id").alias("h"), F.col("doc_id").alias("id"))).alias(f"c{k}") for k in range(centres)]
    met = bands.groupBy("band").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *least_by).where("lo < hi")
    grouped = save_point(bands.join(met.select("band", F.array(*[f"c{k}.id" for k in range(centres)]).alias("centre")), "band"))
    slack = SLACK * (least * (1 - least) / registers) ** 0.5

    # only documents that meet another are read again, for their whole sets
    needed = grouped.select("doc_id").distinct()
    sets = save_point(docs.select("doc_id", "text").join(needed.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets, f"doc_id {id_type}, shingles binary").dropDuplicates(["doc_id"]))

    def verify(near: DataFrame) -> DataFrame:
        return save_point(
            _beside(near, sets, "shingles").repartition("a", "b").mapInArrow(_verified(least), f"a {id_type}, b {id_type}, similarity double")
        )

    stars = (
        grouped.select("doc_id", F.explode("centre").alias("centre")).where("doc_id <> centre")
        .select(F.greatest("doc_id", "centre").alias("a"), F.least("doc_id", "centre").alias("b")).distinct()
    )
    links = verify(_beside(stars, sketches, "signature").mapInArrow(_agreeing(registers, least - slack), f"a {id_type}, b {id_type}"))
    nodes = needed.select(F.col("doc_id").alias("id"))
    label = save_point(components(nodes, links.select("a", "b")).select(F.col("id").alias("doc_id"), F.col("component").alias("label")))

    # groups in which several classes meet
    labelled = grouped.select("band", "nth", "doc_id").join(label, "doc_id")
    mixed = labelled.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    blocks = F.ceil(F.col("n") / TILE)
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    tiled = (
        labelled.join(mixed.select("band", "n"), "band").select("band", "nth", "doc_id", "label", blocks.alias("blocks"), block.alias("own"), other.alias("other"))
        .select("band", "nth", "doc_id", "label", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("tile"),
                F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        .join(sketches, "doc_id").join(sets, "doc_id").repartition("band", "tile").sortWithinPartitions("band", "tile")
    )
    more = save_point(tiled.mapInPandas(_tiles(registers, rows, least - slack, least), f"a {id_type}, b {id_type}, similarity double"))
    links = links.unionByName(more)
    classes = components(nodes, links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    labels = classes.join(degree, "id", "left").select(F.col("id").alias("vertex"), "component", F.coalesce("links", F.lit(0)).alias("links"))
    found = member.join(labels, "vertex", "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("component", "vertex").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )
    # a doc_id given to different texts is in the least of their classes
    found = found.groupBy("_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, with all columns; rows without doc_id stay.

    Rows that repeat a doc_id are copies: one of them stays.
    """
    classes = save_point(near_duplicates(docs, **options))
    # one row for each id that isn't simply kept, so that texts are shuffled once at most
    fate = classes.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("class_id") < F.col("doc_id")), F.lit(False)).alias("later"), F.count("*").alias("n"))
    fate = save_point(fate.where("later or n > 1").select(F.col("doc_id").alias("_id"), "later"))
    again = fate.where("not later")
    if again.isEmpty():
        return docs.join(fate.select("_id"), docs["doc_id"] == F.col("_id"), "left_anti")
    once = docs.join(fate.select("_id"), docs["doc_id"] == F.col("_id"), "left_anti")
    return once.unionByName(docs.join(again.select("_id"), docs["doc_id"] == F.col("_id"), "left_semi").dropDuplicates(["doc_id"]))
