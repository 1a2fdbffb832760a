"""Exact nearest neighbours over unit (or any) vectors.

Two exact plans:

* a query set proven small is shipped once and every partition of the vectors is scanned with
  one matrix product per batch, giving at most ``k`` rows per query and partition;
* otherwise both sides are assigned to pivot cells, cell pairs that cannot hold a neighbour are
  ruled out with the triangle inequality, and the remaining pairs are compared in bounded
  blocks (the k-nearest-neighbour join of Lu et al., PVLDB 2012).  A block is one packed row, and
  blocks meet in a Cartesian product of few partitions: nothing is copied by block pair, so what is
  written grows with the rows; only the products grow with their square.  Products of vectors of any
  length are ranked by lifting them to distances first, so both plans give the same rows.

Similarity is rounded to six digits before ranking and ties are broken by id, so the result does
not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreworks.operators.scale import first_rows
from loreworks.session import save_point

SMALL_QUERIES = 4096
SMALL_BYTES = 64 << 20
BLOCK_ROWS = 2048
MAX_PIVOTS = 256
TILE_ROWS = 4096
SEED_COLUMNS = 256
PRODUCTS = 1 << 20
#: Unit roundoff of single precision, taken twice as the factors are rounded too; products beyond SAFE stay in double.
ERROR, SAFE = 2.0**-23, 1e30
RIGHT_PARTS, RIGHT_BYTES = 4, 64 << 20
DIGITS = 6


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _top(sims: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) indexes of each row's best ``k``; columns must already be in id order."""
    n = sims.shape[1]
    scaled = np.round(sims * 10**DIGITS)
    scaled[~np.isfinite(scaled)] = -(2.0**52)
    # One number orders by similarity and then by column, so ties need no second pass.
    rank = scaled.astype(np.int64) * (n + 1) - np.arange(n)
    take = min(k, n)
    cols = np.argpartition(-rank, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(rank), 1))
    rows = np.repeat(np.arange(len(rank)), take)
    cols = cols.ravel()
    good = np.isfinite(sims[rows, cols])
    if floor is not None:
        good &= scaled[rows, cols] >= np.round(floor * 10**DIGITS)
    return rows[good], cols[good]


def _measure(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return q @ v.T
    d2 = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)
    return -np.sqrt(np.maximum(d2, 0.0))


def _schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("sim", T.DoubleType()),
        ]
    )


def _scan(queries: list, vectors: DataFrame, k: int, skip_self: bool, floor, metric: str, schema) -> DataFrame:
    spark = vectors.sparkSession
    qids = [r[0] for r in queries]
    qmat = np.array([r[1] for r in queries], dtype=np.float64)
    shared = spark.sparkContext.broadcast((np.array(qids), qmat))

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat = shared.value
        # only the best of the whole partition leave it, and products are made in tiles, however many the queries are
        best = _Best(_plain(ids), mat, k, skip_self, floor, metric)
        for pdf in it:
            if pdf.empty:
                continue
            pdf = pdf.sort_values("id", kind="stable")
            best.meet(_plain(pdf["id"].to_numpy()), _matrix(pdf["vec"]))
        if best.id is not None:
            yield pd.DataFrame({"qid": ids[best.row], "id": best.id, "sim": best.sim / 10**DIGITS})

    return vectors.select("id", "vec").mapInPandas(scan, schema)


def _assign(df: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(
        [df.schema[key], df.schema["vec"], T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]
    )

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if pdf.empty:
                continue
            d = -_measure(_matrix(pdf["vec"]), shared.value, "distance")
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype(np.int32), far=d[np.arange(len(d)), cell])

    return df.select(key, "vec").mapInPandas(assign, schema)


def _cell_pairs(q_stats: list, v_stats: list, pivots: np.ndarray, need: int, radius: float, slack: float) -> list[tuple]:
    """Cell pairs that may hold one of the ``need`` nearest, from cell statistics alone."""
    gap = -_measure(pivots, pivots, "distance")
    out = []
    v = sorted(v_stats, key=lambda s: s["cell"])
    cells = np.array([s["cell"] for s in v])
    lo, hi = np.array([s["lo"] for s in v]), np.array([s["hi"] for s in v])
    count = np.array([s["n"] for s in v])
    for q in q_stats:
        d = gap[q["cell"], cells]
        worst = d + q["hi"] + hi
        order = np.argsort(worst)
        enough = np.searchsorted(np.cumsum(count[order]), need)
        reach = worst[order[enough]] if enough < len(order) else np.inf
        reach = min(reach, radius) + slack
        nearest = np.maximum.reduce([d - q["hi"] - hi, lo - d - q["hi"], q["lo"] - d - hi, np.zeros_like(d)])
        for j in np.nonzero(nearest <= reach)[0]:
            out.append((int(q["cell"]), int(cells[j])))
    return out


def _lifted(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """Both sides with one more component, so that the order by distance is the order by product.

    With M the greatest length, a vector v gets sqrt(M^2 - |v|^2) and a query q gets 0: products stay as
    they are, and the squared distance is |q|^2 + M^2 - 2 q.v.  For unit vectors the component is 0.  Also
    gives the greatest squared lengths.
    """
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    q2, v2 = (df.agg(F.coalesce(F.max(square(F.col("vec"))), F.lit(0.0))).first()[0] for df in (queries, vectors))
    more = lambda extra: F.concat(F.col("vec").cast("array<double>"), F.array(extra)).alias("vec")
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(v2) - square(F.col("vec"))))
    return queries.select("qid", more(F.lit(0.0))), save_point(vectors.select("id", more(rest))), (q2, v2)


def _tiled(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool, floor, metric: str, schema, block: int) -> DataFrame:
    spark = vectors.sparkSession
    if metric == "cosine":
        queries, vectors, longest = _lifted(queries, vectors)
    # At most MAX_PIVOTS rows reach the driver, chosen by hash so that a rerun picks the same,
    # and no more than it takes for a cell to fill a block.  Copies of one vector are one pivot.
    total = vectors.count()
    wanted = int(min(MAX_PIVOTS, max(1, -(-total // block))))
    picked = vectors.select("id", "vec").orderBy(F.md5(F.col("id").cast("string"))).limit(wanted).collect()
    pivots = np.unique(np.array([r["vec"] for r in picked], dtype=np.float64), axis=0)
    qa, va = _assign(queries, "qid", pivots), _assign(vectors, "id", pivots)
    stat = lambda df: df.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")
    ).collect()  # at most one row per pivot
    q_stats, v_stats = stat(qa), stat(va)
    # A floor of the product is a ceiling of the lifted distance.
    radius, slack = np.inf, 1e-4
    if metric == "cosine":
        q2, v2 = longest
        slack *= max(1.0, q2 + v2)
        if floor is not None:
            radius = float(np.sqrt(max(0.0, q2 + v2 - 2 * (floor - 1e-5))))
    pairs = _cell_pairs(q_stats, v_stats, pivots, k + int(skip_self), radius, slack)

    # Blocks grow with the table up to a bound, so that their number, and with it what is sent about, does not.
    size = max(block, min(TILE_ROWS, -(-total // MAX_PIVOTS)))
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    plan = F.broadcast(spark.createDataFrame(sorted(near.items()), "cell int, reach array<int>"))
    width = 8 * pivots.shape[1]
    rights = min(len(v_stats) + total // size, max(RIGHT_PARTS, -(-total * width // RIGHT_BYTES)))
    lefts = min(len(q_stats) + sum(s["n"] for s in q_stats) // size, 2 * spark.sparkContext.defaultParallelism)
    left = _packed(qa, "qid", q_stats, size).join(plan, "cell").select(
        F.col("tile").alias("qtile"), F.col("ids").alias("qids"), F.col("mat").alias("qmat"), "reach"
    ).repartition(lefts, "qtile")
    right = _packed(va, "id", v_stats, size).repartition(rights, "tile")
    met = left.hint("shuffle_replicate_nl").join(right, F.array_contains("reach", F.col("cell"))).select("qtile", "qids", "qmat", "ids", "mat")
    return met.mapInArrow(_compare(k, skip_self, floor, metric, pivots.shape[1]), schema)


def _packed(df: DataFrame, key: str, stats: list, size: int) -> DataFrame:
    """{cell, tile, ids, mat}: the rows of a cell in blocks of about ``size``, each one row with its ids in order."""
    counts = {s["cell"]: max(1, -(-s["n"] // size)) for s in stats}
    count = F.try_element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("cell"))
    dealt = df.select(F.col(key).alias("id"), "vec", "cell", F.pmod(F.xxhash64(F.col(key)), count).cast("long").alias("_b"))
    schema = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("tile", T.StringType()), T.StructField("ids", T.ArrayType(df.schema[key].dataType)), T.StructField("mat", T.BinaryType())]
    )

    def pack(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        return pd.DataFrame({"cell": [group[0]], "tile": [f"{group[0]}-{group[1]}"], "ids": [pdf["id"].tolist()], "mat": [_matrix(pdf["vec"]).tobytes()]})

    return dealt.groupBy("cell", "_b").applyInPandas(pack, schema)


class _Best:
    """The best ``k`` so far of each query of a block: pairs that can't be among them are dropped by one comparison."""

    def __init__(self, qids: np.ndarray, mat: np.ndarray, k: int, skip_self: bool, floor: float | None, metric: str):
        self.qids, self.mat, self.k, self.skip_self, self.floor, self.metric = qids, mat, k, skip_self, floor, metric
        self.bound = np.full(len(qids), -np.inf if floor is None else np.round(floor * 10**DIGITS))
        self.single, self.length = mat.astype(np.float32), np.sqrt((mat * mat).sum(1))
        self.row, self.id, self.sim, self.fresh = np.zeros(0, dtype=np.int64), None, np.zeros(0), True

    def meet(self, ids: np.ndarray, mat: np.ndarray) -> None:
        step = SEED_COLUMNS if self.fresh else max(SEED_COLUMNS, PRODUCTS // max(1, len(self.qids)))
        at = 0
        while at < len(ids):
            self._meet(ids[at : at + step], mat[at : at + step])
            at, step = at + step, max(SEED_COLUMNS, PRODUCTS // max(1, len(self.qids)))

    def _meet(self, ids: np.ndarray, mat: np.ndarray) -> None:
        found = None if self.fresh else self._above(ids, mat)
        r, c, sims = self._all(ids, mat) if found is None else found  # no bounds yet, or many ties, as copies make
        self.fresh = False
        s = np.round(sims * 10**DIGITS)
        good = s >= self.bound[r]
        if good.any():
            self._add(r[good], ids[c[good]], s[good])

    def _above(self, ids: np.ndarray, mat: np.ndarray) -> tuple | None:
        """Pairs that reach the bounds: products in single precision less their greatest error, then in double."""
        reach = (self.bound - 0.51) / 10**DIGITS
        if self.metric == "cosine":
            far = np.sqrt((mat * mat).sum(1).max(initial=0.0))
            if not self.length.max(initial=0.0) * far < SAFE:
                return None
            rough = self.single @ mat.astype(np.float32).T
            # to single precision downwards
            low = np.nextafter((reach - ERROR * (mat.shape[1] + 4) * self.length * far).astype(np.float32), np.float32(-np.inf))
        else:
            rough, low = _measure(self.mat, mat, self.metric), reach
        hit = np.flatnonzero(rough >= low[:, None])
        if len(hit) > 4 * self.k * len(self.qids):
            return None
        r, c = np.divmod(hit, len(ids))
        if self.skip_self:
            other = self.qids[r] != ids[c]
            r, c, hit = r[other], c[other], hit[other]
        sims = np.einsum("ij,ij->i", self.mat[r], mat[c]) if self.metric == "cosine" else rough.ravel()[hit]
        good = np.isfinite(sims)
        return r[good], c[good], sims[good]

    def _all(self, ids: np.ndarray, mat: np.ndarray) -> tuple:
        sims = _measure(self.mat, mat, self.metric)
        if self.skip_self:
            lo, hi = np.searchsorted(ids, self.qids, "left"), np.searchsorted(ids, self.qids, "right")
            for extra in range(int((hi - lo).max(initial=0))):
                own = np.nonzero(hi - lo > extra)[0]
                sims[own, lo[own] + extra] = -np.inf
        r, c = _top(sims, self.k, self.floor)
        return r, c, sims[r, c]

    def _add(self, row: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        if self.id is not None:
            row, ids, sim = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.sim, sim])
        order = np.lexsort((ids, -sim, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = nth < self.k
        self.row, self.id, self.sim = row[keep], ids[order][keep], sim[order][keep]
        last = nth[keep] == self.k - 1
        self.bound[self.row[last]] = self.sim[last]

    def rows(self) -> tuple:
        return self.qids[self.row], self.id, self.sim / 10**DIGITS


def _plain(ids) -> np.ndarray:
    ids = np.asarray(ids)
    return ids.astype(str) if ids.dtype == object else ids


def _compare(k: int, skip_self: bool, floor: float | None, metric: str, dim: int):
    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(best: _Best) -> Iterator[pa.RecordBatch]:
            if best.id is not None:
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in best.rows()], names=["qid", "id", "sim"])

        def block(batch: pa.RecordBatch, i: int, ids: str, mat: str) -> tuple:
            flat = np.frombuffer(batch.column(mat)[i].as_buffer(), dtype=np.float64)
            return _plain(batch.column(ids)[i].values.to_numpy(zero_copy_only=False)), flat.reshape(-1, dim)

        # the blocks that a block of queries meets follow each other
        tile, best = None, None
        for batch in it:
            for i in range(batch.num_rows):
                if batch.column("qtile")[i].as_py() != tile:
                    if best is not None:
                        yield from out(best)
                    tile = batch.column("qtile")[i].as_py()
                    qids, qmat = block(batch, i, "qids", "qmat")
                    best = _Best(qids.copy(), qmat.copy(), k, skip_self, floor, metric)
                best.meet(*block(batch, i, "ids", "mat"))
        if best is not None:
            yield from out(best)

    return compare


def knn_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    skip_self: bool = False,
    floor: float | None = None,
    metric: str = "cosine",
    small: int = SMALL_QUERIES,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """{qid, id, sim, rank} of the ``k`` best vectors {id, vec} per query {qid, vec}.

    ``metric`` is ``cosine`` (a dot product, for unit vectors) or ``distance`` (``sim`` is the
    negated distance).  ``floor`` keeps only pairs at least that similar.  ``skip_self`` leaves
    out the pair of equal ids.  Scope filters belong on ``vectors`` before the call.
    """
    schema = _schema(queries, vectors)
    # Row count and width are both proven before anything is shipped to the executors.
    head = queries.select("qid", "vec").limit(small + 1).persist()
    n, dim = head.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if n <= small and dim * 8 * n <= SMALL_BYTES:
        hits = _scan(head.collect(), vectors, k, skip_self, floor, metric, schema) if dim > 0 else None
        head.unpersist()
    else:
        head.unpersist()
        # read several times below, and perhaps dear to make
        hits = _tiled(save_point(queries.select("qid", "vec")), vectors, k, skip_self, floor, metric, schema, block)
    if hits is None:
        hits = vectors.sparkSession.createDataFrame([], schema)
    return first_rows(hits, ["qid"], [F.col("sim").desc(), F.col("id")], k, "rank")


def similarity_from_distance(distance):
    """Cosine of two unit vectors at a Euclidean distance."""
    return 1 - distance * distance / 2
