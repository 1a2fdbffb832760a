"""Trie of conversation prefixes with totals of every subtree, rolled up by bands of depths.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and it is
named by the smallest of them and its depth.  A sequence is known by two sums of hashes of (position, turn), so
that prefixes of a conversation are running sums and no conversation is ever held whole.

Subtree totals: depths are cut into bands of ``BAND``.  A node adds its values only to its ancestors in its own
band.  The tops of bands form a trie ``BAND`` times lower, whose totals are found in the same way; completed, each
adds its total to the nodes between it and the top above.  So a node is exploded to at most ``BAND`` ancestors
and the number of rounds is the logarithm of the depth to the base ``BAND``.  Ancestors are looked up on the path of
the node's smallest member.

Defined cases: rows without conv_id are left out; a null role or text is empty; a null turn comes first; equal turn
numbers are ordered by role and then by a digest of the turn (repeated rows are turns of their own); a
conversation whose rebuilt form has no turn ends at the root; an empty table has no nodes; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreworks.operators.scale import running
from loreworks.session import save_point

BAND = 16
#: Ids whose decimal forms are joined in one piece before a node's ids are hashed in order.
PIECE = 65_536


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, bytes``: turns numbered from 1 in each conversation, their content as a digest.

    Ranges of (conv_id, turn) are numbered apart, so a conversation with very many turns is spread.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save_point(turns.repartitionByRange(parts, "conv_id", "turn").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (
        ranged.withColumn("nth", F.row_number().over(inside)).join(sizes, ["conv_id", "part"])
        .select("conv_id", (F.col("before") + F.col("nth")).alias("pos"), "digest", "bytes")
    )


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of all conversations, and their turns once the first h are those of conversation c - c % 5.

    h is the unsigned crc32 of the decimal id modulo 9; own turns follow from h + 1 on.
    """
    turns = save_point(turns)
    ids = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    )
    heads = turns.where("pos < 9").withColumnRenamed("conv_id", "base").join(ids, "base").where("pos <= h").select("conv_id", "pos", "digest", "bytes")
    taken = heads.groupBy("conv_id").agg(F.count("*").alias("taken"))
    place = ids.join(taken, "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    own = turns.join(place, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    return ids.select("conv_id"), heads.unionByName(own)


def paths(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, bytes, node``: the nodes each conversation passes, the root first; ``node``: smallest member."""
    piece = lambda salt: F.xxhash64(F.lit(salt), "pos", "digest").cast("decimal(20,0)")
    summed = save_point(
        running(turns.select("conv_id", "pos", "digest", "bytes"), ["conv_id"], "pos", {"s1": (piece(1), "sum"), "s2": (piece(2), "sum")})
        .select("conv_id", F.col("pos").cast("long").alias("depth"), "bytes", "s1", "s2")
    )
    least = summed.groupBy("depth", "s1", "s2").agg(F.min("conv_id").alias("node"))
    below = summed.join(least, ["depth", "s1", "s2"]).select("conv_id", "depth", "bytes", "node")
    first = ids.agg(F.min("conv_id").alias("node"))  # one row
    root = ids.join(F.broadcast(first)).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "node")
    return save_point(root.unionByName(below))


def rolled_up(values: DataFrame, path: DataFrame, sums: list[str], deepest: int, step: int = 1, height: int = BAND) -> DataFrame:
    """``node, depth`` and the sums over each node's subtree, for nodes whose depths are multiples of ``step``."""
    wide = step * height
    band = lambda d: F.floor(d / wide).cast("long")
    lines = (
        path.where(F.col("depth") % step == 0).groupBy(F.col("conv_id").alias("node"), band(F.col("depth")).alias("band"))
        .agg(F.collect_list(F.struct("depth", F.col("node").alias("conv"))).alias("line"))
    )

    def added(rows: DataFrame, where: Column, counts) -> DataFrame:
        up = rows.withColumn("band", where).join(lines, ["node", "band"])
        up = up.withColumn("to", F.explode(F.filter("line", lambda a: counts(a["depth"], F.col("depth")))))
        return up.groupBy(F.col("to.conv").alias("node"), F.col("to.depth").alias("depth")).agg(*[F.sum(c).alias(c) for c in sums])

    within = added(values, band(F.col("depth")), lambda above, own: above <= own)
    if deepest < wide:
        return within
    within = save_point(within)
    tops = rolled_up(within.where(F.col("depth") % wide == 0), path, sums, deepest, wide, height)
    tops = save_point(tops)
    passed = added(tops.where("depth > 0"), band(F.col("depth")) - 1, lambda above, own: above % wide != 0)
    between = within.where(F.col("depth") % wide != 0).unionByName(passed).groupBy("node", "depth").agg(*[F.sum(c).alias(c) for c in sums])
    return tops.unionByName(between)


def _hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (node, depth) and piece; of each node, SHA-256 of its pieces joined by commas."""
    at, running_hash = None, None

    def out(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["node", "depth", "ends"]
        )

    for batch in batches:
        done = []
        for node, depth, text in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "text"))):
            if (node, depth) != at:
                if at is not None:
                    done.append((*at, running_hash.hexdigest()))
                at, running_hash = (node, depth), hashlib.sha256(text.encode())
            else:
                running_hash.update(b"," + text.encode())
        yield out(done)
    if at is not None:
        yield out([(*at, running_hash.hexdigest())])


def ends(path: DataFrame) -> DataFrame:
    """``node, depth, ends``: SHA-256 of the ids of conversations that end at a node, ascending, joined by commas."""
    last = path.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("end")).select("end.node", "end.depth", "conv_id")
    pieces = last.groupBy("node", "depth", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text")
    )
    ordered = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece").select("node", "depth", "text")
    return ordered.mapInArrow(_hash_in_order, "node long, depth long, ends string")


def prefix_trie(ids: DataFrame, turns: DataFrame, height: int = BAND) -> DataFrame:
    """One row per node of the trie of conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``; ``turns`` are
    ``conv_id, pos, digest, bytes`` with pos from 1 without gaps.
    """
    path = paths(ids, turns)
    above = path.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = path.groupBy("node", "depth").agg(F.count("*").alias("n_convs"), F.min("bytes").alias("bytes")).join(above, ["node", "depth"], "left")
    nodes = save_point(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = save_point(nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    values = nodes.select(
        "node", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = rolled_up(values, path, ["n_leaves", "saved_tokens"], deepest, height=height)
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, ["node", "depth"]).join(ends(path), ["node", "depth"], "left")
        .select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
    )


#: The same rows by SQL, for ``prefix_trie(*with_shared_heads(numbered_turns(conversations)))``.
TWIN = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM turns),
heads AS (SELECT i.conv_id, pos, role, text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h),
taken AS (SELECT conv_id, count(*) AS taken FROM heads GROUP BY 1),
rebuilt AS (
  SELECT * FROM heads
  UNION ALL SELECT t.conv_id, t.pos - i.h + coalesce(taken, 0), role, text FROM turns t JOIN ids i USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE t.pos > i.h),
steps AS (
  SELECT conv_id, pos AS depth, strlen(text) AS bytes, list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
path AS (SELECT conv_id, depth, bytes, min(conv_id) OVER (PARTITION BY depth, key) AS node FROM steps),
nodes AS (SELECT node, depth, count(*) AS n_convs, min(bytes) AS bytes FROM path GROUP BY 1, 2),
kin AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN path p ON p.conv_id = n.node AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM kin WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM kin k LEFT JOIN kids USING (node, depth)),
totals AS (
  SELECT p.node, p.depth, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.bytes)::BIGINT AS saved_tokens
  FROM own o JOIN path p ON p.conv_id = o.node AND p.depth <= o.depth GROUP BY 1, 2),
last AS (SELECT conv_id, arg_max(node, depth) AS node, max(depth) AS depth FROM path GROUP BY 1),
ended AS (SELECT node, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY 1, 2)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN totals USING (node, depth) LEFT JOIN ended USING (node, depth)
"""
