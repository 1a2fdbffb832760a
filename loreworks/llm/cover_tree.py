"""Hard negatives by cover trees over norm-augmented vectors.

Candidates are dealt by a hash of their id into shards of about ``SHARD`` rows.  Every shard gets one more
coordinate, sqrt(M^2 - |x|^2) with M its largest norm, so that all its points have norm M and, for a query q with 0
there, |q - x|^2 = M^2 + |q|^2 - 2 qx.  On these points a cover tree is built level by level: a node covers its
points within a radius, its children are points of it that lie apart and cover half that radius.  Radius and
distance of a node bound the inner products of all its points from both sides.

A search opens the node with the largest upper bound first, leaves out nodes (and points) outside every open window,
and computes points exactly in integers, so points come out by descending score and a window closes at its
k-th.  Trees are kept as a table; each anchor visits the tree of every shard, and the results of shards are merged.

Vectors are integers: floor(256 x), x as double.  Scores are exact: products of larger integers than 2**53 would not
be, so a component of 2**22 or more (x beyond 16,384) raises an error.

Defined cases: a row with a null id, label or vector, or with a null, NaN or infinite component takes no part; rows
that repeat a vec_id count once (least label, then least vector); vectors of different length never meet; an empty
vector has score 0 with other empty ones; equal scores are ordered by vec_id; an anchor without positives or a
positive without negatives gives no rows; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreworks.operators.scale import first_rows
from loreworks.session import save_point

SHARD = 8192
#: A node of at most so many points isn't split further.
LEAF = 16
#: Points whose distances to the uncovered ones are computed at once.
BATCH = 64
SCALE = 256
LARGEST = float(1 << 22)


class CoverTree:
    """Nodes in level order with their radii; the points of a node lie together in ``order``."""

    FIELDS = ("ids", "labels", "points", "order", "centre", "radius", "first", "last", "child", "children")

    def __init__(self, **parts):
        self.__dict__.update(parts)
        self.floats = self.points.astype(float)
        self.heads = self.floats[self.centre]
        norms = (self.floats**2).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> CoverTree:
        floats = points.astype(float)
        norms = (floats**2).sum(axis=1)
        top = norms.max()
        wide = np.hstack([floats, np.sqrt(np.maximum(top - norms, 0))[:, None]])

        def apart(some: np.ndarray, others: np.ndarray) -> np.ndarray:
            square = 2 * top - 2 * (wide[some] @ wide[others].T)
            return np.sqrt(np.where(square < 0.5, 0, square))  # different integer vectors are at least 1 apart

        everyone = np.argsort(ids, kind="stable")
        level = [(everyone[0], everyone, apart(everyone[:1], everyone)[0], 0)]  # centre, points, distances from it, place in the order
        order, nodes = np.zeros(len(ids), np.int64), []
        while level:
            below, known = [], len(nodes) + len(level)
            for centre, members, away, place in level:
                radius, at = float(away.max()), known + len(below)
                order[place : place + len(members)] = members
                nodes.append((centre, radius, place, place + len(members), at))
                if radius == 0 or len(members) <= LEAF:
                    continue
                free = np.ones(len(members), bool)

                def adopt(child: int, near: np.ndarray, distance: np.ndarray, place: int) -> int:
                    below.append((child, members[near], distance, place))
                    free[near] = False
                    return place + len(near)

                near = np.flatnonzero(away <= radius / 2)
                place = adopt(centre, near, away[near], place)
                while free.any():
                    left = np.flatnonzero(free)
                    some = left[:BATCH]
                    for i, distance in zip(some, apart(members[some], members[left])):
                        if free[i]:
                            near = np.flatnonzero((distance <= radius / 2) & free[left])
                            place = adopt(members[i], left[near], distance[near], place)
            level = below
        centre, radius, first, last, child = (np.array(c) for c in zip(*nodes))
        split = (radius > 0) & (last - first > LEAF)
        children = np.where(split, np.append(child[1:], len(nodes)) - child, 0)
        return cls(ids=ids, labels=labels, points=points, order=order, centre=centre, radius=radius, first=first, last=last, child=child, children=children)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> CoverTree:
        with np.load(io.BytesIO(raw)) as parts:
            return cls(**{f: parts[f] for f in cls.FIELDS})

    def bounds(self, products: np.ndarray, radius: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product with a query that points within ``radius`` of centres can have.

        ``products``: those of the centres; ``norm``: the query's squared norm.
        """
        both = self.top + norm
        gap = np.sqrt(np.maximum(both - 2 * products, 0))
        slack = 1e-9 * (both + 1)
        return (both - (gap + radius) ** 2) / 2 - slack, (both - np.maximum(gap - radius, 0) ** 2) / 2 + slack

    def descend(self, query: np.ndarray, fits, low: np.ndarray, high: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each window from ``low`` to ``high`` its first k points ``(score, id)``, largest first, of those that fit."""
        q = query.astype(float)
        norm = float((q**2).sum())
        found: list[list[tuple[int, int]]] = [[] for _ in low]
        open_ = np.ones(len(low), bool)
        heap: list[tuple] = []  # (-bound, id or -1, number, node or None, block of points)
        number = 0

        def within(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            out = np.zeros(len(least), bool)
            for w in np.flatnonzero(open_):
                out |= (most >= low[w]) & (least <= high[w])
            return out

        def push_points(rows: np.ndarray, score: np.ndarray) -> None:
            nonlocal number
            use = within(score, score) & fits(self.ids[rows], self.labels[rows])
            rows, score = rows[use], score[use].astype(np.int64)
            if not len(rows):
                return
            if len(rows) > 4 * k and len(low) == 1:  # one window: no more than its k best can count
                best = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[best], score[best]
            nth = np.lexsort((self.ids[rows], -score))
            number += 1
            block = (score[nth].tolist(), self.ids[rows[nth]].tolist())
            heapq.heappush(heap, (-block[0][0], block[1][0], number, None, (block, 0)))

        def push_nodes(a: int, b: int) -> None:
            nonlocal number
            products, radius, places = self.heads[a:b] @ q, self.radius[a:b], self.first[a:b]
            single = (radius == 0) & (self.last[a:b] - places == 1)
            push_points(self.order[places[single]], products[single])
            if single.all():
                return
            least, most = self.bounds(products, radius, norm)
            for at in np.flatnonzero(within(least, most) & ~single).tolist():
                number += 1
                heapq.heappush(heap, (-most[at], -1, number, a + at, None))

        if len(self.ids):
            push_nodes(0, 1)
        while heap and open_.any():
            bound, _, _, node, rest = heapq.heappop(heap)
            if -bound < low[open_].min():
                break
            if node is not None:
                if self.children[node]:
                    push_nodes(self.child[node], self.child[node] + self.children[node])
                else:
                    rows = self.order[self.first[node] : self.last[node]]
                    push_points(rows, self.floats[rows] @ q)
                continue
            (scores, ids), at = rest
            score, who = scores[at], ids[at]
            for w in np.flatnonzero(open_ & (low <= score) & (score <= high)):
                found[w].append((score, who))
                open_[w] = len(found[w]) < k
            if at + 1 < len(scores):
                number += 1
                heapq.heappush(heap, (-scores[at + 1], ids[at + 1], number, None, ((scores, ids), at + 1)))
        return found


def whole_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, label, point``: rows that take part, components as integers."""
    x = F.col("embedding")
    plain = table.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    )
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    point = F.transform(scaled, lambda v: F.when((v < int(LARGEST)) & (v > -int(LARGEST)), v).otherwise(F.raise_error(F.lit("component out of range"))).cast("int"))
    return (
        plain.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), point.alias("point"))
        .groupBy("vec_id").agg(F.min(F.struct("label", "point")).alias("own")).select("vec_id", "own.label", "own.point")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(flat), width)


def _grown(key: tuple, table: pa.Table) -> pa.Table:
    shard, width = key[0].as_py(), key[1].as_py()
    tree = CoverTree.build(table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["point"], width))
    return pa.table({"shard": pa.array([shard], pa.int64()), "width": pa.array([width], pa.int32()), "tree": pa.array([tree.pack()], pa.binary())})


def forest(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """``shard, width, tree``: the cover tree of each shard of ``rows``, saved."""
    n = rows.count()
    shards = max(1, -(-n // size))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("width", F.size("point"))
    return save_point(dealt.groupBy("shard", "width").applyInArrow(_grown, "shard long, width int, tree binary"))


def _visit(search):
    """Rows come by (shard, width), the tree before the anchors; ``search(tree, anchor)`` gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            out = []
            raw = batch.column("tree")
            for i, row in enumerate(batch.drop_columns(["tree"]).to_pylist()):
                key = row["shard"], row["width"]
                if raw[i].is_valid:
                    at, tree = key, CoverTree.unpack(raw[i].as_py())
                elif key == at:
                    out.extend(search(tree, row))
            columns = list(zip(*out)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _visited(trees: DataFrame, anchors: DataFrame, search) -> DataFrame:
    """Every anchor at the tree of every shard of its width."""
    none = lambda kind: F.lit(None).cast(kind)
    shards = trees.select("shard", "width")
    asked = anchors.withColumn("width", F.size("point")).join(shards, "width")
    extra = [c for c in ("positives", "scores") if c in anchors.columns]
    roots = trees.select("shard", "width", none("long").alias("vec_id"), none("long").alias("label"), none("array<int>").alias("point"), *[none("array<long>").alias(c) for c in extra], "tree")
    rows = roots.unionByName(asked.select("shard", "width", "vec_id", "label", "point", *extra, none("binary").alias("tree")))
    dealt = rows.repartition("shard", "width").sortWithinPartitions("shard", "width", F.asc_nulls_first("vec_id"))
    return dealt.mapInArrow(_visit(search), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def _positives(k: int):
    everything = np.array([-np.inf]), np.array([np.inf])

    def search(tree: CoverTree, a: dict) -> list[tuple]:
        own, label = a["vec_id"], a["label"]
        fits = lambda ids, labels: (labels == label) & (ids != own)
        return [(own, who, score, None, None) for score, who in tree.descend(np.array(a["point"]), fits, *everything, k)[0]]

    return search


def _negatives(k: int, low: int, high: int):
    """Windows: low * positive <= 100 * negative <= high * positive, in integers."""

    def search(tree: CoverTree, a: dict) -> list[tuple]:
        label, scores = a["label"], np.array(a["scores"])
        fits = lambda ids, labels: labels != label
        least, most = -(-(low * scores) // 100), (high * scores) // 100
        got = tree.descend(np.array(a["point"]), fits, least, most, k)
        return [(a["vec_id"], p, ps, who, score) for p, ps, rows in zip(a["positives"], a["scores"], got) for score, who in rows]

    return search


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, size: int = SHARD) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` and ``anchors`` are ``vec_id, label, point``.  An anchor's positives are its best rows of its label,
    itself apart; for each of them, the best rows of other labels whose score is ``low`` to ``high`` percent of the
    positive's.  Anchors visit every shard, so work is anchors times shards; no list is longer than ``positives`` or
    ``negatives``.
    """
    rows = save_point(rows)
    trees = forest(rows, size)
    found = _visited(trees, anchors, _positives(positives)).select("anchor_id", "positive_id", "positive_score")
    best = first_rows(found, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives)
    best = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("best"))
    asked = save_point(
        anchors.join(best, F.col("vec_id") == F.col("anchor_id"))
        .select("vec_id", "label", "point", F.col("best.positive_id").alias("positives"), F.col("best.positive_score").alias("scores"))
    )
    mined = _visited(trees, asked, _negatives(negatives, low, high))
    ranked = first_rows(mined, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives, "rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def noisy_labels(rows: DataFrame) -> DataFrame:
    """Labels of every seventh id moved on by one, as the registered query wants them."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The same rows by SQL, for anchors whose vec_id is divisible by 100 and the default counts and windows.
TWIN = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM fine a JOIN fine c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
