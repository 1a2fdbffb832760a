"""Documents linked by the Jaccard similarity of their word n-gram sets: a grouped prefix join.

A document is the set of its distinct shingles (five words, A-Z lower-cased).  All sets are ordered alike: shingles
that many documents have come last.  Two sets of similarity ``percent`` or more share a shingle among their first
n - ceil(percent n / 100) + 1, the prefix.

* Documents with the same set are one vertex; vertices with the same prefix and the same size are one group.  Only
  groups are indexed, by each shingle of their prefix, and group pairs are filtered by size, by the number of shingles
  that their prefixes share and by the places of these (up to the last of them nothing else can be common).
* Group pairs are expanded to their members, which are verified on whole sets in integers.
* What counts is who is connected, so pairs that are connected already are not expanded: in a first round each group
  meets the first of every list it is in, and the first member of its own; lists that still hold several
  components get another centre; what is then still apart is paired completely, in tiles of ``TILE`` entries.
  A list of copies costs one pair for each member, and no pair of different components is left out.
  Tiles of lists with the same least member meet in one task, where what a pair shares is counted before it is sent.
* Each vertex has a bitmap of ``BITS`` bits, the parities of its shingles by hash.  Two bitmaps differ in no more bits than
  the sets in shingles, so where they differ in more than similar sets can, the pair is not made (the bitmap filter of
  Sandes et al.).

The order is only a matter of speed, any order gives the same result: shingles that ``SEEN`` or more documents of
one partition have are counted, and the ``COMMON`` most frequent of them (2 MB) are sent to all tasks.

Shingles are 64-bit hashes.  Defined cases: a null text is an empty one and, like a text without words, has no
shingles and no links; with fewer than five words the whole sequence is the one shingle; a row without doc_id has no
component; of rows that repeat a doc_id with different texts, one text (of the least digest) takes part in links;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreworks.llm.words import find_words, shingles, slices, text_bytes
from loreworks.operators.graph import components
from loreworks.session import save_point

PERCENT = 80
SEEN = 8
COMMON = 1 << 17
TILE = 2048
#: Members of a list from which the lists of one picked member go to several tasks, rows held and pairs made at once in a task.
PART, HELD_ROWS, PAIRS = 64, 1 << 17, 1 << 19
BITS = 256
#: Bytes of text whose shingles are held at once, and shingles counted before rare ones are forgotten.
SLICE, HELD = 1 << 20, 1 << 21
#: Ids (of 16-byte digests) that may be sent to every task to pick out texts where they are read.
SENT = 1_000_000


def distinct_shingles(batch: pa.RecordBatch, column: int):
    """By slice: first and last row, and owner and hash of the distinct shingles, by owner and hash."""
    data, offsets = text_bytes(batch.column(column))
    for a, b in slices(offsets, SLICE):
        h, owner = shingles(find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield a, b, owner[new], h[new]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that many documents of the partition have, and about how many."""
    token, count, fresh, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merge():
        together = np.concatenate([token, *fresh])
        weight = np.concatenate([count, np.ones(len(together) - len(token), np.int64)])
        kept, at = np.unique(together, return_inverse=True)
        total = np.bincount(at, weight, len(kept)).astype(np.int64)
        return kept[total > 1], total[total > 1]

    for batch in batches:
        for *_, h in distinct_shingles(batch, 0):
            fresh.append(h)
            n += len(h)
            if n > HELD:
                (token, count), fresh, n = merge(), [], 0
    token, count = merge()
    use = count >= SEEN
    yield pa.RecordBatch.from_arrays([pa.array(token[use].view(np.int64)), pa.array(count[use])], ["token", "n"])


def common_shingles(docs: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and ranks (from 1, the most frequent last) of at most ``most`` frequent shingles."""
    counted = docs.select("text").mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "token").limit(most).toArrow()
    token = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], (len(token) - np.arange(len(token)))[order]


def parities(owner: np.ndarray, h: np.ndarray, many: int) -> np.ndarray:
    """Whether an odd number of a set's shingles falls to each bit; ``BITS`` bits as rows of 64-bit words."""
    odd = np.bincount(owner * BITS + (h >> np.uint64(56)).astype(np.int64) % BITS, minlength=many * BITS) & 1
    return np.ascontiguousarray(np.packbits(odd.astype(np.uint8).reshape(many, BITS), axis=1).view(np.int64).T)


#: Columns of the bitmap.
PARITIES = [f"b{i}" for i in range(BITS // 64)]


def _sketch(common: tuple[np.ndarray, np.ndarray], percent: int):
    """Size, digest of the set, digest of (size, prefix), prefix and bitmap of each document."""
    token, rank = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, owner, h in distinct_shingles(batch, 1):
                place = np.zeros(len(h), np.int64)
                if len(token):
                    at = np.minimum(np.searchsorted(token, h), len(token) - 1)
                    place = np.where(token[at] == h, rank[at], 0)
                ordered = h[np.lexsort((h, place, owner))]
                edge = np.searchsorted(owner, np.arange(b - a + 1))
                size = np.diff(edge)
                first = edge[:-1] + size + (-percent * size) // 100 + 1  # behind the prefix
                digest, group, prefix = [], [], []
                for s, m, e in zip(edge[:-1].tolist(), first.tolist(), edge[1:].tolist()):
                    if s == e:
                        digest.append(None), group.append(None), prefix.append(None)
                        continue
                    head = ordered[s:m].tobytes()
                    digest.append(hashlib.blake2b(h[s:e].tobytes(), digest_size=16).digest())
                    group.append(hashlib.blake2b(b"%d:" % (e - s) + head, digest_size=16).digest())
                    prefix.append(head)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(size.astype(np.int64)), *(pa.array(c, pa.binary()) for c in (digest, group, prefix)), *map(pa.array, parities(owner, h, b - a))],
                    ["doc_id", "n", "digest", "grp", "prefix", *PARITIES],
                )

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a group's prefix: ``token, gid, n, pos``."""
    for batch in batches:
        raw = batch.column(2).to_pylist()
        many = np.array([len(x) // 8 for x in raw], np.int64)
        at = np.repeat(np.arange(len(raw)), many)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        token = np.frombuffer(b"".join(raw), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(token), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(pos.astype(np.int32))], ["token", "gid", "n", "pos"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted 64-bit shingles of the rows ``id, text, digest`` whose text has that digest, once for each id."""
    seen: set = set()
    for batch in batches:
        ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for a, b, owner, h in distinct_shingles(batch, 1):
            edge = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
            rows = []
            for i, (s, e) in enumerate(zip(edge, edge[1:]), a):
                raw = h[s:e].tobytes()
                if ids[i] not in seen and hashlib.blake2b(raw, digest_size=16).digest() == wanted[i]:
                    seen.add(ids[i])
                    rows.append((i, raw))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([x for _, x in rows], pa.binary())], ["id", "shingles"])


def _linked(percent: int):
    """Of rows (a, b, set of a, set of b) the similar ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                near[i] = (100 + percent) * int((both[1:] == both[:-1]).sum()) >= percent * (len(x) + len(y))
            near = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return run


def _may(percent: int, n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether a shared shingle at these places can belong to similar sets of n and m shingles."""
    return (100 + percent) * (F.least(pos, at) + F.least(n - pos, m - at)) >= percent * (n + m)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _candidates(percent: int, met: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs ``a, b`` that can be similar, of rows for each shingle that two prefixes share.

    ``met`` has n, pos of ``x`` and m, at of ``y``.  Shared shingles stand in the same order in both sets, so up to the
    last of them nothing else is common.  The prefix that ends first in the order has nothing more in common with
    the other either, so of its set only what follows the prefix can be.  Members of a group (place -1) share their
    prefix.
    """
    pair = met.where(_may(percent, F.col("n"), F.col("pos"), F.col("m"), F.col("at"))).groupBy(x, y, "n", "m")
    return _similar(percent, pair.agg(F.count("*").alias("shared"), F.max("pos").alias("pos"), F.max("at").alias("at"), F.min("pos").alias("least")), x, y)


def _similar(percent: int, seen: DataFrame, x: str, y: str) -> DataFrame:
    """Those pairs that can be similar by the number of shingles that their prefixes share and the last places of these."""
    behind = lambda size: F.floor((F.lit(percent) * size + 99) / 100).cast("long") - 1  # noqa: E731 - shingles that follow the prefix
    rest = F.greatest(F.least(behind(F.col("n")), F.col("m") - F.col("at") - 1), F.least(F.col("n") - F.col("pos") - 1, behind(F.col("m"))))
    similar = (100 + percent) * (F.col("shared") + rest) >= percent * (F.col("n") + F.col("m"))
    return seen.where(similar | (F.col("least") < 0)).select(*_ordered(x, y))


def _other_centres(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """Pairs of the picked member of each list and those of other components."""
    centre = rows.where(F.xxhash64("vertex") == F.col("pick")).select(
        "token", F.col("vertex").alias("centre"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("clabel")
    )
    return _candidates(percent, rows.join(centre, "token").where(F.col("label") != F.col("clabel")), "vertex", "centre")


def _met(percent: int, most_rows: int = HELD_ROWS, most_pairs: int = PAIRS):
    """Of rows ``token, tile, vertex, n, pos, label, side`` and bitmap, where a list's tile stands together: the pairs of different
    components that share shingles, and how many, with the last places; a pair may come several times, with a part of these."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        col = lambda name: rows[name].to_numpy()
        ids, vertex = np.unique(col("vertex"), return_inverse=True)
        token, tile, n, pos, label, side = (col(c) for c in ("token", "tile", "n", "pos", "label", "side"))
        bits = [col(b).view(np.uint64) for b in PARITIES]  # of signed numbers numpy counts the bits of the absolute value
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])
        end = np.append(np.flatnonzero(new)[1:], len(token))[np.cumsum(new) - 1]
        later = end - np.arange(len(token)) - 1  # each row meets those behind it in its tile
        edge = np.concatenate([[0], np.cumsum(later)])
        found, at = [], 0
        while at < len(later):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + most_pairs, "right")) - 1)
            i = np.repeat(np.arange(at, to), later[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(edge[at:to] - edge[at], later[at:to])
            at = to
            use = (label[i] != label[j]) & ((side[i] == 2) | (side[i] != side[j]))
            i, j = i[use], j[use]
            both = percent * (n[i] + n[j])
            use = (100 + percent) * (np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])) >= both
            # parities that differ stand for shingles that only one of both sets has
            differing = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits)
            use &= (100 + percent) * differing <= (100 - percent) * (n[i] + n[j])
            i, j = i[use], j[use]
            i, j = np.where(vertex[i] < vertex[j], i, j), np.where(vertex[i] < vertex[j], j, i)
            found.append(np.stack([vertex[i] * len(ids) + vertex[j], n[i], n[j], np.ones(len(i), np.int64), pos[i], pos[j]]))
        key, n, m, shared, pos, at = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.diff(key[order], prepend=-1))
        total = lambda f, x: f.reduceat(x[order], head) if len(head) else x[:0]
        key, n, m = key[order][head], n[order][head], m[order][head]
        name = lambda k: rows["vertex"].combine_chunks().take(pa.array(first[k]))
        first = np.zeros(len(ids), np.int64)
        first[vertex] = np.arange(len(vertex))
        return pa.RecordBatch.from_arrays(
            [name(key // max(len(ids), 1)), name(key % max(len(ids), 1)), *map(pa.array, (n, m, total(np.add, shared), total(np.maximum, pos), total(np.maximum, at), total(np.minimum, pos)))],
            ["x", "y", "n", "m", "shared", "pos", "at", "least"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < most_rows:
                continue
            rows = pa.Table.from_batches(held)
            token, tile = rows["token"].to_numpy(), rows["tile"].to_numpy()
            last = np.flatnonzero((token != token[-1]) | (tile != tile[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last list may go on
            if whole:
                yield pairs(rows.slice(0, whole))
            held, count = rows.slice(whole).to_batches(), len(rows) - whole
        if count:
            yield pairs(pa.Table.from_batches(held))

    return run


def _counted_pairs(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """All pairs of members of a list that are in different components; a long list is cut into blocks, and each two blocks meet.

    Lists with the same picked member, which mostly hold the same members, go to the same task: there the shingles that a pair
    shares are counted before it leaves, so that a pair that shares many is sent once and not once for each.
    """
    blocks = F.ceil(F.col("many") / tile)
    mine = F.pmod(F.xxhash64(F.lit("block"), "vertex"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    # long lists of one member are dealt to several tasks, by shingle
    part = F.pmod(F.xxhash64(F.lit("part"), "token"), F.ceil(F.col("many") / PART))
    tiled = rows.select("token", "pick", part.alias("part"), "vertex", "n", "pos", "label", blocks.alias("blocks"), mine.alias("mine"), other.alias("other"), *PARITIES).select(
        "token", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("tile"), "pick", "part", "vertex", "n", F.col("pos").cast("long").alias("pos"), "label",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), *PARITIES,
    )
    kind = rows.schema["vertex"].dataType.simpleString()
    dealt = tiled.repartition("pick", "part", "tile").sortWithinPartitions("pick", "part", "token", "tile")
    met = dealt.mapInArrow(_met(percent), f"x {kind}, y {kind}, n long, m long, shared long, pos long, at long, least long")
    seen = met.groupBy("x", "y", "n", "m").agg(F.sum("shared").alias("shared"), F.max("pos").alias("pos"), F.max("at").alias("at"), F.min("least").alias("least"))
    return _similar(percent, seen, "x", "y")


def _tiled_pairs(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """What ``_counted_pairs`` gives, by a plain join with a row for each shared shingle: the tests hold the two against each other."""
    blocks = F.ceil(F.col("many") / tile)
    mine = F.pmod(F.xxhash64(F.lit("block"), "vertex"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    tiled = rows.select("token", "vertex", "n", "pos", "label", blocks.alias("blocks"), mine.alias("mine"), other.alias("other"), *PARITIES).select(
        "token", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("tile"), "vertex", "n", "pos", "label", "mine", "other", *PARITIES
    )
    x = tiled.where("mine <= other").select(
        "token", "tile", F.col("vertex").alias("x"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("xlabel"), F.col("mine").alias("xmine"),
        *[F.col(b).alias(f"x{b}") for b in PARITIES],
    )
    y = tiled.where("mine >= other")
    # parities that differ stand for shingles that only one of both sets has
    differing = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"x{b}"))) for b in PARITIES[1:]), F.bit_count(F.col(PARITIES[0]).bitwiseXOR(F.col(f"x{PARITIES[0]}"))))
    close = (100 + percent) * differing <= (100 - percent) * (F.col("n") + F.col("m"))
    apart = (F.col("label") != F.col("xlabel")) & ((F.col("mine") != F.col("xmine")) | (F.col("x") < F.col("vertex")))
    # a pair of one block and one of two blocks may come in either order, so the smaller id is put first
    both = x.join(y, ["token", "tile"]).where(apart & close)
    turned = F.col("x") > F.col("vertex")
    swap = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    met = both.select(swap("x", "vertex").alias("x"), swap("m", "n").alias("m"), swap("at", "pos").alias("at"), swap("vertex", "x").alias("vertex"), swap("n", "m").alias("n"), swap("pos", "at").alias("pos"))
    return _candidates(percent, met, "vertex", "x")


def linked_components(docs: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketch = save_point(
        docs.select("doc_id", "text").mapInArrow(_sketch(common_shingles(docs), percent), f"doc_id {id_type}, n long, digest binary, grp binary, prefix binary, " + ", ".join(f"{b} long" for b in PARITIES))
    )
    named = sketch.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(F.struct("digest", "grp", "n", *PARITIES)).alias("own")).select("doc_id", "own.*")
    vertex = save_point(named.groupBy("digest", "grp", "n").agg(F.min("doc_id").alias("vertex"), *[F.first(b).alias(b) for b in PARITIES]))
    heads = vertex.groupBy("grp").agg(F.min("vertex").alias("gid"), F.count("*").alias("members"))
    member = save_point(vertex.join(heads, "grp").select("vertex", "digest", "n", "gid", "members", *PARITIES))
    prefix = sketch.where("n > 0").join(heads.select("grp", F.col("gid").alias("doc_id")), ["grp", "doc_id"], "left_semi")
    entries = (
        prefix.groupBy("doc_id", "grp", "n").agg(F.first("prefix").alias("prefix")).select("doc_id", "n", "prefix")
        .mapInArrow(_entries, f"token long, gid {id_type}, n long, pos int")
    )
    shared = entries.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo < hi")
    lists = save_point(entries.join(shared.select("token", "lo"), "token"))

    crowd = member.where("members > 1")
    digest = member.select(F.col("vertex").alias("doc_id"), "digest")

    def verified(pairs: DataFrame) -> DataFrame:
        """The similar ones of ``pairs``; only texts that are in a pair are read again."""
        pairs = save_point(pairs)
        needed = save_point(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(digest, "doc_id"))
        if needed.count() <= SENT:  # else the texts are shuffled to them
            needed = F.broadcast(needed)
        sets = save_point(docs.select("doc_id", "text").join(needed, "doc_id").select("doc_id", "text", "digest").mapInArrow(_sets, f"id {id_type}, shingles binary"))
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
        return save_point(both.mapInArrow(_linked(percent), f"a {id_type}, b {id_type}").distinct())

    # first round: the first group of each list, the first member of each group
    centre = lists.where("gid = lo").select("token", F.col("gid").alias("centre"), F.col("n").alias("m"), F.col("pos").alias("at"))
    stars = _candidates(percent, lists.where("gid <> lo").join(centre, "token"), "gid", "centre")
    links = verified(stars.unionByName(crowd.where("vertex <> gid").select(*_ordered("vertex", "gid"))))

    # lists of members, and a list for each group
    rows = lists.join(member.select("vertex", "gid"), "gid").select("token", "vertex", "n", "pos")
    own = crowd.select(F.xxhash64(F.lit("group"), "gid").alias("token"), "vertex", "n", F.lit(-1).alias("pos"))
    rows = rows.unionByName(own)
    nodes = member.select(F.col("vertex").alias("id"))

    def labels() -> DataFrame:
        return save_point(components(nodes, links).select(F.col("id").alias("vertex"), F.col("component").alias("label")))

    def apart(rows: DataFrame, label: DataFrame) -> DataFrame:
        """Entries of the lists that hold several components, with these and the length of the list."""
        labelled = rows.select("token", "vertex", "n", "pos").join(label, "vertex")
        mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.xxhash64("vertex")).alias("pick"), F.count("*").alias("many")).where("lo < hi")
        return save_point(labelled.join(mixed.select("token", "pick", "many"), "token"))

    for pairs in (_other_centres, _counted_pairs):
        label = labels()
        rows = apart(rows, label)
        if rows.isEmpty():
            break
        if pairs is _counted_pairs:
            rows = rows.join(member.select("vertex", *PARITIES), "vertex")
        links = links.unionByName(verified(pairs(rows, percent, tile)))
    else:
        label = labels()

    found = (
        named.join(vertex.select("digest", "vertex"), "digest").join(label, "vertex", "left")
        .select(F.col("doc_id").alias("_id"), F.coalesce("label", "vertex").alias("component_id"))
    )
    return (
        sketch.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("_id"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


#: The same rows by SQL.
TWIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
side AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM side UNION SELECT r.doc_id, s.b FROM reach r JOIN side s ON s.a = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id
FROM documents LEFT JOIN sized USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1) USING (doc_id)
"""
