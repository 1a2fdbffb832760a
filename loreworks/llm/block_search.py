"""Nearest neighbours by inner product as a block matrix join.

Vectors are packed into blocks, and blocks dealt to a grid of cells, queries by row and candidates by column;
a cell holds at most about ``GROUP`` vectors of either side.  In a cell, both are quantised to int8 with a scale
for each vector, and tiles of products are taken in whole numbers.  As x = s q + e, a product differs from its
quantised value by at most |e_x| |y| + |s q_x| |e_y|, so a candidate whose upper bound is under a query's k-th
best lower bound is out.  The others are computed again from the vectors as they are, in double precision, added
in the order of the components, and merged into the query's best k; the cells' lists are merged by query.
The result is exact.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components take no part;
candidates of another dimension than the query's don't count; a query without candidates has no rows; equal
scores go to the smaller id; rows with the query's own id are no candidates; a query id that recurs is asked
once, with its least vector, and a candidate row that recurs counts each time; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreworks.session import save_point

BLOCK = 2048
GROUP = 8192
#: Queries of a tile; a tile is this times BLOCK numbers.
TILE = 512
#: Components whose int8 products add up exactly in float32.
EXACT = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, width, ids, data) of (vec_id, embedding)."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, lists = np.asarray(batch.column(0)), batch.column(1)
        widths, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
        ends = np.cumsum(widths)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            for a in range(0, len(rows), BLOCK):
                part = rows[a : a + BLOCK]
                data = flat[(ends[part] - width)[:, None] + np.arange(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([int(width)], pa.int32()), pa.array([ids[part].tobytes()]), pa.array([data.tobytes()], pa.large_binary()).cast(pa.binary())],
                    ["block", "width", "ids", "data"],
                )
                block += 1


class Quantised:
    """Vectors in int8 with what is needed for bounds."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.scale = np.abs(data).max(axis=1) / 127
        self.small = np.rint(data / self.scale[:, None]).astype(np.int8)
        rough = self.small * self.scale[:, None]
        self.norm = np.linalg.norm(data, axis=1) * (1 + 1e-12)
        self.rough_norm = np.linalg.norm(rough, axis=1) * (1 + 1e-12)
        self.error = np.linalg.norm(data - rough, axis=1) * (1 + 1e-12) + 1e-300

    def part(self, a: int, b: int) -> Quantised:
        out = object.__new__(Quantised)
        out.__dict__ = {k: v[a:b] for k, v in self.__dict__.items()}
        return out


def bounds(x: Quantised, y: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Quantised products of all pairs, and how far the true ones may be off."""
    total = np.zeros((len(x.ids), len(y.ids)))
    for a in range(0, x.small.shape[1], EXACT):  # whole numbers under 2**24: float32 adds them exactly
        total += x.small[:, a : a + EXACT].astype(np.float32) @ y.small[:, a : a + EXACT].astype(np.float32).T
    total *= x.scale[:, None] * y.scale
    off = x.error[:, None] * y.norm + x.rough_norm[:, None] * y.error
    return total, off + 1e-12 * x.norm[:, None] * y.norm


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


class Best:
    """The best k of each query so far."""

    def __init__(self, queries: Quantised, k: int):
        self.queries, self.k = queries, k
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(queries.ids), -np.inf)  # k-th best score, or less

    def see(self, block: Quantised) -> None:
        found = []
        for a in range(0, len(self.queries.ids), TILE):
            x = self.queries.part(a, a + TILE)
            value, off = bounds(x, block)
            low, high = value - off, value + off
            own = x.ids[:, None] == block.ids
            low[own], high[own] = -np.inf, -np.inf
            if low.shape[1] >= self.k:
                kth = np.partition(low, low.shape[1] - self.k, axis=1)[:, -self.k]
                self.least[a : a + TILE] = np.maximum(self.least[a : a + TILE], kth)
            row, at = np.nonzero((high >= self.least[a : a + TILE, None]) & ~own)
            found.append((row + a, block.ids[at], _product(x.data[row], block.data[at])))
        row, ids, score = (np.concatenate(c) for c in zip((self.row, self.id, self.score), *found))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        head = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(head, np.diff(head, append=len(row)))
        keep = order[nth < self.k]
        self.row, self.id, self.score = (np.concatenate(c)[keep] for c in zip((self.row, self.id, self.score), *found))
        full = order[nth == self.k - 1]
        at = np.concatenate([self.row[:0], row[nth == self.k - 1]])
        self.least[at] = np.maximum(self.least[at], score[full])


def _search(k: int):
    """Rows come by cell, queries (side 0) before candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best = None, [], None

        def close():
            if best is not None:
                return pa.RecordBatch.from_arrays([pa.array(best.queries.ids[best.row]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"])
            return None

        for batch in batches:
            for r in batch.to_pylist():
                key = r["width"], r["i"], r["j"]
                if key != cell:
                    if (out := close()) is not None:
                        yield out
                    cell, asked, best = key, [], None
                ids = np.frombuffer(r["ids"], np.int64)
                data = np.frombuffer(r["data"]).reshape(len(ids), -1)
                if r["side"] == 0:
                    asked.append((ids, data))
                elif asked:
                    if best is None:
                        best = Best(Quantised(*(np.concatenate(c) for c in zip(*asked))), k)
                    best.see(Quantised(ids, data))
        if (out := close()) is not None:
            yield out

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each query among ``vectors``, nearest first."""
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    kinds = "block long, width int, ids binary, data binary"
    q = save_point(asked.mapInArrow(_pack, kinds))
    # of equal vectors only the k + 1 least ids can be among the k nearest of a query, which may be one of them
    nth = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = usable(vectors).withColumn("nth", nth).where(F.col("nth") <= k + 1).select("vec_id", "embedding")
    c = save_point(least.mapInArrow(_pack, kinds))
    rows, columns = (max(1, -(-(t.agg(F.sum(F.length("ids"))).first()[0] or 0) // (8 * GROUP))) for t in (q, c))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = q.select("width", own(rows).alias("i"), every(columns).alias("j"), F.lit(0).alias("side"), "ids", "data")
    right = c.select("width", every(rows).alias("i"), own(columns).alias("j"), F.lit(1).alias("side"), "ids", "data")
    cells = left.unionByName(right).repartition("width", "i", "j").sortWithinPartitions("width", "i", "j", "side")
    found = cells.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by SQL, for the queries whose vec_id is divisible by 20 and k = 20.
TWIN = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
