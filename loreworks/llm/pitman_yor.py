"""Hierarchical Pitman-Yor language model over words, and scores of documents under it.

Restaurants: one for each preceding word and one for the start of a text; all share one parent, the root, whose
base is even over the training vocabulary and one unknown token.  A customer is an occurrence of a token; each
table of a context's restaurant is a customer of the root.

Seating is sampled by blocked Gibbs: the number of tables t of a dish with c customers is drawn anew given all
others, p(t) ~ S(c, t) * prod_{i<t} (theta + d (T + i)) * P(w)^t, where S are generalised Stirling numbers of the
restaurant's discount, T the other tables of the restaurant and P(w) the parent's probability; beyond ``DIRECT``
customers the rest are seated in blocks.  Within a round, T and P come from the round before (synchronous, as the
data are spread), but T of a rare context, which is in one cell, from the sweep before; concentrations are drawn after each round given the seating.  The scores average the predictive
probabilities of the last round's samples.

Spread of the work: the (token, context, document) counts are made in one pass and dealt to cells, those of
rare contexts by context, the others of frequent tokens by token and context together, so that no token or
context gathers in a cell, the others by token.  What all cells get are numbers for the ``CONTEXTS`` most
frequent tokens only: arrays of that size at any input size.  Customers of the root that are rare tokens come
from several cells: after each round the cells send theirs to the token's owner, a range of hashes, which adds
them up, seats them and answers the cells that asked.  The cells are saved once, bucketed, and read by each round.
Samples are replayed from their seeds when scoring.

Defined cases: a null text is an empty one: its end is its only token; a null doc_id counts as empty text when
held-out rows are told apart; rows that repeat are scored each and count each; if there is nothing to learn
from, every token has the base probability; further columns are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreworks.llm.words import find_words, mix, slices, text_bytes
from loreworks.session import save_point, shared_dir

#: Tokens whose numbers all cells get; those of others travel (a matter of speed, the model is the same).
CONTEXTS = 65_000
#: Contexts below ``NEAR`` have the same number in all cells; from there on rare ones are numbered by cell.
START, FAR, NEAR = 65_534, 65_535, 65_536
ROUNDS = 2
SAMPLES = 3
DIRECT = 48
SLICE = 1 << 21
#: Cells for each shuffle partition of the session.
CELLS = 8
#: Entries of an array of sums that travel in a row.
SEGMENT = 4096
#: Shuffle partitions for each owner of rare tokens.  Every cell sends every owner a row.
SHARE = 4
#: Sums of documents that a task holds before it sends them, combined over its cells.
PARCEL = 1 << 20
_U = np.uint64
_END = _U(0x5E1D0E1D0E1D0E1D)
_LAST = _END & ~_U(1)
_RARE = _U(1 << 63)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of each token, its end after each text; and whether it is the first of a text."""
    words = find_words(data, offsets)
    count = np.diff(words.first) + 1
    total = int(count.sum())
    last = np.cumsum(count) - 1
    out = np.full(total, _END)
    inner = np.ones(total, bool)
    inner[last] = False
    out[inner] = words.hash | _U(1)  # odd, so that none is the end
    out[last] = _LAST
    first = np.zeros(total, bool)
    first[last - count + 1] = True
    return out, np.repeat(np.arange(len(count)), count), first


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens and how often they occur, by batch."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        seen = []
        for a, b in slices(offsets, SLICE):
            token, *_ = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            seen.append(np.unique(token, return_counts=True))
        if seen:
            token, at = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
            n = np.bincount(at, np.concatenate([s[1] for s in seen])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])


@dataclass
class Root:
    """What is known of the whole model between rounds; of bounded size."""

    frequent: np.ndarray  # sorted hashes of the frequent tokens; their places are their ids
    count: np.ndarray  # occurrences of each in the training texts
    tokens: int  # N
    types: int  # V
    as_context: np.ndarray  # training customers of each near context's restaurant, by id
    d: float = 0.75
    theta: float = 10.0
    root_d: float = 0.5
    root_theta: float = 10.0
    tables: np.ndarray | None = None  # of each near context's restaurant: samples x 65,536
    dish: np.ndarray | None = None  # customers of the root by frequent token: samples x ids
    dish_tables: np.ndarray | None = None  # and their tables
    customers: np.ndarray | None = None  # of the root, of all tokens: samples
    root_tables: np.ndarray | None = None
    before: Root | None = field(default=None, repr=False)  # the round that the samples were drawn from


def _cells_of(root, labels: np.ndarray):
    cells = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = root.value.frequent
        base, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            held = np.asarray(batch.column(1))
            for a, b in slices(offsets, SLICE):
                token, doc, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n_docs = b - a
                own = base + done + np.arange(n_docs)
                home = labels[_range_of(mix(own.astype(np.uint64)), cells)]
                done += n_docs
                size = np.bincount(doc, minlength=n_docs)
                none = pa.nulls(n_docs, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home), pa.array(own), batch.column(0).slice(a, n_docs), pa.array(held[a:b]), pa.array(size), *[none] * 6],
                    NAMES,
                )
                kind, which = np.unique(token, return_inverse=True)
                at = np.minimum(np.searchsorted(frequent, kind), len(frequent) - 1)
                known = frequent[at] == kind
                name = np.where(known, at, FAR).astype(np.int64)
                # behind a rare word the context is its place among the slice's kinds
                context = np.where(known, at, NEAR + np.arange(len(kind)))[np.concatenate([[0], which[:-1]])]
                context[first] = START
                span = NEAR + len(kind)
                key, n = np.unique((doc * len(kind) + which) * span + context, return_counts=True)
                context, key = key % span, key // span
                which, doc = key % len(kind), key // len(kind)
                far = context >= NEAR
                behind = kind[np.where(far, context - NEAR, 0)] | _RARE
                context = np.where(far, FAR, context).astype(np.uint16)
                word = np.where(known[which], name[which].astype(np.uint64), kind[which] | _RARE)
                spread = np.where(far, behind, np.where(known[which], word * _U(65_536) + context, word))
                cell = _range_of(mix(spread), cells)
                order = np.argsort(cell.astype(np.uint16) if cells < 65_536 else cell, kind="stable")
                edge = np.searchsorted(cell[order], np.arange(cells + 1))
                some, blobs = np.flatnonzero(np.diff(edge)), []
                for k in some:
                    part = order[edge[k] : edge[k + 1]]
                    common = known[which[part]]
                    part = np.concatenate([part[common], part[~common]])
                    m = int(common.sum())
                    mark = (doc[part] * 2 + held[a + doc[part]]).astype(np.uint32)
                    blobs.append([mark.tobytes(), n[part].astype(np.uint32).tobytes(), context[part].tobytes(), behind[part[far[part]]].tobytes(), word[part[:m]].astype(np.uint16).tobytes(), word[part[m:]].tobytes()])
                same = pa.array(np.zeros(len(some), np.int64))
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(labels[some]), pa.array(np.full(len(some), own[0])), batch.column(0).slice(a, 1).take(same), pa.array(np.zeros(len(some), bool)), same,
                         *[pa.array(x, pa.binary()) for x in zip(*blobs)]],
                        NAMES,
                    )

    return run


NAMES = ["cell", "uid", "doc_id", "held", "size", "marks", "counts", "contexts", "behind", "common", "rare"]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes that each is in; rises with the hash."""
    return ((h >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _labels(spark, buckets: int) -> np.ndarray:
    """Numbers for the cells, ``CELLS`` of them in each bucket."""
    tried = spark.range(buckets * (4 * CELLS + 40)).select(F.col("id").cast("int").alias("label"))
    place = Window.partitionBy(F.pmod(F.hash("label"), F.lit(buckets))).orderBy("label")
    even = tried.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= CELLS)
    return np.array(sorted(r.label for r in even.collect()), np.int32)


def _owner(rare: np.ndarray, owners: int) -> np.ndarray:
    return _range_of(rare << _U(1), owners)  # all rare tokens have the upper bit


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest needs, which the first byte tells."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1).astype(np.int64)


def _build(blobs: pd.DataFrame) -> pd.DataFrame:
    """One row for a cell: its tokens, its (token, context) pairs in order, and the occurrences by document."""
    size = [len(x) // 4 for x in blobs.marks]
    mark = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs.marks]).astype(np.int64)
    uid = np.repeat(blobs.uid.to_numpy(np.int64), size) + mark // 2
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs.counts])
    context = np.concatenate([np.frombuffer(x, np.uint16) for x in blobs.contexts]).astype(np.int64)
    rare, local = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs.behind]), return_inverse=True)
    context[context == FAR] = NEAR + local
    word = np.concatenate([np.concatenate([np.frombuffer(c, np.uint16).astype(np.uint64), np.frombuffer(r, np.uint64)]) for c, r in zip(blobs.common, blobs.rare, strict=True)])
    words, which = np.unique(word, return_inverse=True)
    span = NEAR + len(rare)
    pair, at = np.unique(which * span + context, return_inverse=True)
    train = np.bincount(at, np.where(mark % 2 == 0, n, 0), len(pair)).astype(np.int64)
    order = np.argsort(uid, kind="stable")
    docs, per_doc = np.unique(uid, return_counts=True)
    return pd.DataFrame({
        "cell": [blobs.cell.iloc[0]], "words": [words.tobytes()], "fan": [np.bincount(pair // span).astype(np.uint32).tobytes()], "contexts": [(pair % span).astype(np.uint32).tobytes()], "train": [train.astype(np.uint32).tobytes()],
        "docs": [docs.tobytes()], "per_doc": [per_doc.astype(np.uint32).tobytes()], "event": [at[order].astype(np.uint32).tobytes()], "times": [n[order].tobytes()],
    })


CELL = "cell int, words binary, fan binary, contexts binary, train binary, docs binary, per_doc binary, event binary, times binary"


def stirling(d: float, most: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) with discount ``d``, for c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        stay = np.log(np.maximum(c - t * d, 1e-300)) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def seat(rng: np.random.Generator, c: np.ndarray, theta: float, d: float, others: np.ndarray, parent: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A draw of the number of tables of each dish with ``c`` customers, given the ``others`` tables of its restaurant."""
    t = np.minimum(c, 1)
    direct = np.minimum(c, DIRECT)
    for k in np.unique(direct[direct > 1]):
        at = np.flatnonzero(direct == k)
        for a in range(0, len(at), 1 << 16):
            x = at[a : a + (1 << 16)]
            grow = np.cumsum(np.log(theta + d * (others[x, None] + np.arange(k))) + np.log(parent[x, None]), axis=1)
            chance = table[k, 1 : k + 1] + grow
            chance = np.exp(chance - chance.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[x] = 1 + (chance < rng.random(len(x))[:, None] * chance[:, -1:]).sum(axis=1)
    at, seated = np.flatnonzero(c > DIRECT), DIRECT
    while len(at):  # further customers in blocks of an eighth of those seated
        block = np.minimum(max(1, seated // 8), c[at] - seated)
        new = (theta + d * (others[at] + t[at])) * parent[at]
        t[at] += rng.binomial(block, new / (new + seated - d * t[at]))
        seated += max(1, seated // 8)
        at = at[c[at] > seated]
    return t


class Cell:
    """A cell's arrays, unpacked."""

    def __init__(self, row, root: Root):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.words, self.context = get("words", np.uint64), get("contexts", np.uint32).astype(np.int64)
        self.of = np.repeat(np.arange(len(self.words)), get("fan", np.uint32))
        self.train = get("train", np.uint32).astype(np.int64)
        self.common = self.words < _RARE  # frequent tokens
        self.rare = ~self.common
        self.id = self.words[self.common].astype(np.int64)
        self.own = np.bincount(self.of, self.train, len(self.words)).astype(np.int64)  # training customers in this cell
        self.near = self.context < NEAR
        # rare contexts have all their customers here
        self.customers = np.concatenate([root.as_context, self.by_far(self.train)])

    def by_far(self, values: np.ndarray) -> np.ndarray:
        """Sums by rare context."""
        return np.bincount(self.context, values, NEAR)[NEAR:]

    def counts(self, root: Root, rare: np.ndarray) -> np.ndarray:
        """Training occurrences of each word, those of rare ones given."""
        count = np.zeros(len(self.words))
        count[self.common], count[self.rare] = root.count[self.id], rare
        return count

    def parents(self, root: Root, k: int, state: np.ndarray | None) -> np.ndarray:
        """The root's probability of each word under sample ``k``; ``state``: what the owners of rare words answered."""
        even = 1.0 / (root.types + 1)
        if root.dish is None:  # before the first round: smoothed counts
            return (self.counts(root, self.own[self.rare]) + 0.5) / (root.tokens + 0.5 * (root.types + 1))
        n, t = np.zeros(len(self.words)), np.zeros(len(self.words))
        n[self.common], n[self.rare] = root.dish[k][self.id], state[1 + k]
        t[self.common], t[self.rare] = root.dish_tables[k][self.id], state[1 + SAMPLES + k]
        total, all_tables = root.customers[k], root.root_tables[k]
        return (np.maximum(n - root.root_d * t, 0) + (root.root_theta + root.root_d * all_tables) * even) / (root.root_theta + total)

    def samples(self, root: Root, seed: int, state: np.ndarray | None) -> Iterator[np.ndarray]:
        """Sweeps given ``root``: tables of each pair."""
        rng = np.random.Generator(np.random.Philox(seed))
        table = stirling(root.d, DIRECT)
        t = np.minimum(self.train, 1)
        last = 0 if root.tables is None else len(root.tables) - 1
        tables = 0.5 * root.as_context if root.tables is None else root.tables[last]
        live = np.flatnonzero(self.train > 1)
        p = self.parents(root, last, state)[self.of[live]]
        for _ in range(SAMPLES):
            others = np.maximum(np.concatenate([tables, self.by_far(t)])[self.context[live]] - t[live], 0)
            t = t.copy()
            t[live] = seat(rng, self.train[live], root.theta, root.d, others, p, table)
            yield t


def _most(root: Root) -> int:
    """No rare token, so no rare context, has more training customers."""
    return int(root.count.min())


def _state(row, column: str) -> np.ndarray | None:
    """What owners answered on the rare words of a cell: occurrences, customers of the root and tables, by word."""
    parts = row.get(column)
    if parts is None:
        return None
    return np.concatenate([np.zeros((ANSWER, 0), np.int64), *[_unpack(x).reshape(ANSWER, -1) for x in parts]], axis=1)


#: Numbers that an owner answers for a word: its count, and by sample its customers and tables in the root.
ANSWER = 1 + 2 * SAMPLES
SENT = "target int, cell int, words binary, numbers binary"
SETTLED = "target int, cell int, numbers binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one after the other, so that one cell at a time is copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _batch(columns: pd.DataFrame, kinds: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pandas(columns, pa.schema([(c.split()[0], types[c.split()[1]]) for c in kinds.split(", ")]), preserve_index=False)


def _sums(sent, owners: int):
    """Customers of the root by rare token, for their owners; and totals over the cells of a task, in segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: Root = sent.value
        tables, dish = np.zeros((SAMPLES, NEAR), np.int64), np.zeros((SAMPLES, NEAR), np.int64)
        customers, pairs = np.zeros(SAMPLES, np.int64), np.zeros(3, np.int64)
        sizes, seated = np.zeros(_most(root) + 1, np.int64), np.zeros(_most(root) + 1, np.int64)
        for row in _rows(batches):
            cell = Cell(row, root)
            pairs += np.bincount(np.minimum(cell.train, 3), minlength=4)[:3]
            rare = cell.words[cell.rare]
            numbers = np.zeros((1 + SAMPLES, len(rare)), np.int64)
            numbers[0] = cell.own[cell.rare]
            for k, t in enumerate(cell.samples(root, row["cell"], _state(row, "before"))):
                n = np.bincount(cell.of, t, len(cell.words)).astype(np.int64)
                tables[k] += np.bincount(cell.context[cell.near], t[cell.near], NEAR).astype(np.int64)
                dish[k] += np.bincount(cell.id, n[cell.common], NEAR).astype(np.int64)
                customers[k] += n.sum()
                numbers[1 + k] = n[cell.rare]
            many = cell.customers[NEAR:] > 1
            sizes += np.bincount(cell.customers[NEAR:][many].astype(np.int64), minlength=len(sizes))
            seated += np.bincount(cell.by_far(t)[many].astype(np.int64), minlength=len(seated))
            edge = np.searchsorted(_owner(rare, owners), np.arange(owners + 1))
            some = np.flatnonzero(np.diff(edge))
            if not len(some):
                continue
            yield _batch(pd.DataFrame({
                "target": some, "cell": row["cell"], "words": [rare[edge[o] : edge[o + 1]].tobytes() for o in some],
                "numbers": [_pack(numbers[:, edge[o] : edge[o + 1]]) for o in some],
            }), SENT)
        whole = np.concatenate([tables.ravel(), dish.ravel(), customers, pairs, sizes, seated])
        starts = [a for a in range(0, len(whole), SEGMENT) if whole[a : a + SEGMENT].any()]
        if not starts:
            return
        yield _batch(pd.DataFrame({
            "target": [-1 - a // SEGMENT for a in starts], "cell": -1, "words": None, "numbers": [_pack(whole[a : a + SEGMENT]) for a in starts],
        }), SENT)

    return run


def _settle(sent):
    """Adds up a segment; or, for an owner, the customers of its rare tokens, seats them and answers each cell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        root: Root = sent.value
        target = int(rows.target.iloc[0])
        if target < 0:
            total = sum(_unpack(x) for x in rows.numbers)
            return pd.DataFrame({"target": [target], "cell": -1, "numbers": [_pack(total)]})
        words = [np.frombuffer(x, np.uint64) for x in rows.words]
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        sent_numbers = np.concatenate([_unpack(x).reshape(1 + SAMPLES, -1) for x in rows.numbers], axis=1)
        total = np.stack([np.bincount(at, x, len(every)) for x in sent_numbers]).astype(np.int64)
        rng = np.random.Generator(np.random.Philox(2_000_003 + target))
        above = 0.5 * root.types if root.root_tables is None else root.root_tables[-1]
        others, even = np.full(len(every), max(above - 1, 0)), np.full(len(every), 1.0 / (root.types + 1))
        table = stirling(root.root_d, DIRECT)
        tables = [seat(rng, total[1 + k], root.root_theta, root.root_d, others, even, table) for k in range(SAMPLES)]
        answer = np.concatenate([total, tables])
        edge = np.cumsum([0, *map(len, words)])
        sums = np.concatenate([answer[1 + SAMPLES :].sum(axis=1), np.bincount(np.minimum(total[-1], 3), minlength=4)[:3]])
        return pd.DataFrame({
            "target": target, "cell": [*rows.cell, -1], "numbers": [*[_pack(answer[:, at[a:b]]) for a, b in zip(edge, edge[1:])], _pack(sums)],
        })

    return run


def _beside(cells: DataFrame, **answers: DataFrame | None) -> DataFrame:
    """Cells with the answers that they got, by owner, in a column for each table of ``answers``."""
    for name, settled in answers.items():
        if settled is None:
            continue
        got = settled.where("cell >= 0").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("target", "numbers"))).alias("got"))
        got = got.select("cell", F.transform("got", lambda x: x["numbers"]).alias(name))
        cells = cells.join(got.hint("shuffle_hash"), "cell", "left")  # the cells needn't be sorted
        cells = cells.withColumn(name, F.coalesce(name, F.array().cast("array<binary>")))
    return cells


def _round(cells: DataFrame, settled: DataFrame | None, root: Root, nth: int, owners: int) -> tuple[DataFrame, Root]:
    """Samples of a round over all cells, answers of the owners, and concentrations drawn given the last sample."""
    spark = cells.sparkSession
    sent = spark.sparkContext.broadcast(root)
    given = _beside(cells.select("cell", "words", "fan", "contexts", "train"), before=settled)
    settled = _packed_point(given.mapInArrow(_sums(sent, owners), SENT).groupBy("target").applyInPandas(_settle(sent), SETTLED))
    size, most = len(root.frequent), _most(root)
    edges = np.cumsum([SAMPLES * NEAR, SAMPLES * NEAR, SAMPLES, 3, most + 1])
    whole = np.zeros(edges[-1] + most + 1)
    rare = np.zeros(SAMPLES + 3)
    # the segments of that array and a row for each owner
    for r in settled.where("cell < 0").collect():
        if r.target < 0:
            a = (-1 - r.target) * SEGMENT
            whole[a : a + SEGMENT] = _unpack(r.numbers)
        else:
            rare += _unpack(r.numbers)
    tables, dish, customers, pair_counts, sizes, seated = np.split(whole, edges)
    tables, dish = tables.reshape(SAMPLES, NEAR), dish.reshape(SAMPLES, NEAR)[:, :size]
    rng = np.random.Generator(np.random.Philox(1_000_003 + nth))
    one, two = pair_counts[1], pair_counts[2]
    d = float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))
    counts = rare[SAMPLES:] + np.bincount(np.minimum(dish[-1], 3).astype(int), minlength=4)[:3]
    root_d = float(np.clip(counts[1] / max(counts[1] + 2 * counts[2], 1), 0.05, 0.95))
    root_table = stirling(root.root_d, DIRECT)
    dish_tables = np.zeros((SAMPLES, size))
    for k in range(SAMPLES):
        others = np.full(size, rare[k])
        dish_tables[k] = seat(rng, dish[k].astype(np.int64), root.root_theta, root.root_d, others, np.full(size, 1.0 / (root.types + 1)), root_table)
    root_tables = rare[:SAMPLES] + dish_tables.sum(axis=1)
    return settled, Root(
        root.frequent, root.count, root.tokens, root.types, root.as_context, d, concentration(rng, root.theta, d, root.as_context, tables[-1], sizes, seated), root_d,
        concentration(rng, root.root_theta, root_d, customers[-1:], root_tables[-1:]), tables, dish, dish_tables, customers, root_tables, root,
    )


def concentration(
    rng: np.random.Generator, theta: float, d: float, customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray | None = None, seated: np.ndarray | None = None
) -> float:
    """A draw of the concentration given all restaurants that share it, by auxiliary variables; its prior is Gamma(1, 1).

    ``sizes`` and ``seated``: how many further restaurants, with two customers at least, have so many customers, and tables.
    """
    some = customers > 1
    # the sum over i < tables of Bernoulli(theta / (theta + d i)), by its mean
    draws = lambda t: theta / d * np.log1p(np.maximum(t - 1, 0) * d / (theta + d / 2))
    logs, ones = np.log(rng.beta(theta + 1, customers[some] - 1)).sum(), draws(tables[some]).sum()
    if sizes is not None and sizes.any():
        # the mean of the logarithm of Beta(theta + 1, c - 1): the sum over 0 < i < c of -1 / (theta + i)
        logs -= (sizes[2:] * np.cumsum(1 / (theta + np.arange(1, len(sizes) - 1)))).sum()
        ones += (seated * draws(np.arange(len(seated)))).sum()
    elif not some.any():
        return theta
    return float(rng.gamma(1.0 + rng.poisson(ones), 1.0 / (1.0 - logs)))


def _combined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Documents and the sums of their known tokens and scores."""
    uid, *values = (np.concatenate(x) for x in zip(*parts))
    uid, at = np.unique(uid, return_inverse=True)
    known, base, score = (np.bincount(at, v, len(uid)) for v in values)
    return uid, known.astype(np.int64), base, score


PARCELS = "target int, uids binary, known binary, base binary, scores binary"


def _parcels(parts: list[tuple[np.ndarray, ...]], targets: int) -> pd.DataFrame:
    """Combined sums, one row for each range of hashed documents."""
    columns = _combined(parts)
    target = (mix(columns[0].astype(np.uint64)) % _U(targets)).astype(np.int32)
    order = np.argsort(target, kind="stable")
    some, head = np.unique(target[order], return_index=True)
    cut = lambda v: pd.Series([x.tobytes() for x in np.split(v[order], head[1:])], dtype=object)
    return pd.DataFrame({"target": some} | dict(zip(("uids", "known", "base", "scores"), map(cut, columns))))


def _totals(parcels: pd.DataFrame) -> pd.DataFrame:
    kinds = {"uids": np.int64, "known": np.int64, "base": np.float64, "scores": np.float64}
    columns = _combined([tuple(np.frombuffer(row[c], k) for c, k in kinds.items()) for _, row in parcels.iterrows()])
    return pd.DataFrame(dict(zip(("uid", "n_known", "base_score", "score"), columns)))


def _score(sent, targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: Root = sent.value
        before = root.before
        # replayed with the settings they were drawn with; predicted with the same
        now = Root(**{**root.__dict__, "d": before.d, "theta": before.theta, "root_d": before.root_d, "root_theta": before.root_theta})
        held, size = [], 0  # sums by document, and how many came after the last merge
        for row in _rows(batches):
            cell, state = Cell(row, root), _state(row, "answers")
            count = cell.counts(root, state[0])
            base = np.log10((count + 0.5) / (root.tokens + 0.5 * (root.types + 1)))[cell.of]
            chance = np.zeros(len(cell.of))
            own = cell.customers[cell.context]
            for k, t in enumerate(cell.samples(before, row["cell"], _state(row, "before"))):
                p = cell.parents(now, k, state)[cell.of]
                back = np.concatenate([root.tables[k], cell.by_far(t)])[cell.context]
                chance += (np.maximum(cell.train - now.d * t, 0) + (now.theta + now.d * back) * p) / (now.theta + own) / SAMPLES
            model = np.log10(chance)
            docs, per_doc = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["per_doc"], np.uint32)
            at, times = np.frombuffer(row["event"], np.uint32), np.frombuffer(row["times"], np.uint32)
            head = (np.cumsum(per_doc) - per_doc).astype(np.int64)
            add = lambda v: np.add.reduceat(v[at] * times, head) if len(head) else np.zeros(0)
            known = (count > 0)[cell.of].astype(np.int64)
            if len(docs):
                held.append((docs, add(known), add(base), add(model)))
                size += len(docs)
            if size >= PARCEL // 2:
                held, size = [_combined(held)], 0
                if len(held[0][0]) >= PARCEL:
                    yield _batch(_parcels(held, targets), PARCELS)
                    held = []
        if held:
            yield _batch(_parcels(held, targets), PARCELS)

    return run


def score_documents(docs: DataFrame, held: Column | None = None, contexts: int = CONTEXTS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``held``: which rows are not learnt from; by default those whose id's crc32 leaves 1 when divided by 5.
    ``score`` and ``base_score`` are log10 probabilities of the whole text, its end included.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out(F.col("doc_id")) if held is None else held, F.lit(False))
    marked = docs.select("doc_id", held.alias("held"), "text")
    counts = save_point(
        marked.where("not held").select("text").mapInArrow(_count_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    )
    ends = F.sum(F.when(F.col("token") == int(_LAST), F.col("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(ends, F.lit(0)).alias("ends")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(contexts).collect()
    # no token hashes to 0: the entry stands for none where there is nothing to learn from
    frequent = np.array([r.token for r in top] or [0], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, count = frequent[order], np.array([r.n for r in top] or [0], np.float64)[order]
    # every word is followed by a token, an end by none, and every text begins once
    as_context = np.zeros(NEAR)
    as_context[: len(count)] = np.where(frequent == _LAST, 0, count)
    as_context[START] = total.ends
    root = Root(frequent, count, total.n, total.v, as_context)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = -(-buckets // SHARE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(root)
    schema = f"cell int, uid long, doc_id {kind}, held boolean, size long, marks binary, counts binary, contexts binary, behind binary, common binary, rare binary"
    dealt = marked.mapInArrow(_cells_of(sent, _labels(spark, buckets)), schema)
    made = dealt.repartition(buckets, "cell").mapInPandas(_gather(kind), f"{CELL}, uid long, doc_id {kind}, held boolean, size long")
    name = f"pitman_yor_{uuid.uuid4().hex}"
    # bucketed, so that answers can meet the cells without moving these
    made.write.bucketBy(buckets, "cell").option("compression", "zstd").option("path", f"{shared_dir(spark)}/pitman_yor/{name}").saveAsTable(name, format="parquet")
    built = spark.table(name)
    seen = built.where("words is not null").select(*[c.split()[0] for c in CELL.split(", ")])
    before, settled = None, None
    for nth in range(rounds):
        before, (settled, root) = settled, _round(seen, settled, root, nth, owners)
        if root.before:
            root.before.before = None
    # what a document gets from the cells of a task goes to its target in one row with that of others
    parcels = _beside(seen, before=before, answers=settled).mapInArrow(_score(spark.sparkContext.broadcast(root), buckets), PARCELS)
    sums = parcels.groupBy("target").applyInPandas(_totals, "uid long, n_known long, base_score double, score double")
    rows = built.where("uid is not null").select("uid", "doc_id", F.col("held").alias("held_out"), F.col("size").alias("n_tokens"))
    return rows.join(sums, "uid").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")


def _packed_point(df: DataFrame) -> DataFrame:
    """As ``save_point``, with a codec that packs numbers of few bits better."""
    path = f"{shared_dir(df.sparkSession)}/pitman_yor/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gather(kind: str):
    """Builds the cells of a partition; the rows of documents go through."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for frame in frames:
            docs = frame[frame.marks.isna()]
            if len(docs):
                yield docs.reindex(columns=OUT)
            for cell, part in frame[frame.marks.notna()].groupby("cell"):
                held.setdefault(cell, []).append(part)
        while held:
            yield _build(pd.concat(held.popitem()[1])).reindex(columns=OUT)

    return run


OUT = [c.split()[0] for c in CELL.split(", ")] + ["uid", "doc_id", "held", "size"]
