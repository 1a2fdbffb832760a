"""Building blocks that keep work spread out when one key holds a large share of the rows.

* :func:`running` computes running aggregates with two short windows instead of one long one.
* :func:`dense_number` numbers a whole table without a single-task global window.
* :func:`contains_join` finds which needles occur in which texts without a cross join.
* :func:`first_rows` keeps a bounded number of rows per key, pruned before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreworks.session import save_point

SEGMENT_ROWS = 65_536
NEEDLE_LIMIT = 256
SHIP_NEEDLES, SHIP_CHARS = 65_536, 4 << 20
GRAM = 5


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    exprs: dict[str, tuple[Column, str]],
    segment: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add running values over ``order`` within ``keys`` where a key may be arbitrarily hot.

    ``order`` is a unique integer, so ``order div segment`` cuts every key into pieces of at
    most ``segment`` rows.  Each piece is scanned on its own, the piece totals (one row per
    piece) are scanned to get what happened before it, and both are combined.  ``exprs`` maps
    an output name to ``(column, kind)`` with kind one of

    ``sum``, ``min``, ``max``  inclusive running aggregate,
    ``last``                   last non-null value so far, inclusive,
    ``prev``                   value of the previous row (a lag of one).
    """
    seg = "_segment"
    tmp = {name: f"_in_{i}" for i, name in enumerate(exprs)}
    base = df.withColumn(seg, F.floor(F.col(order) / F.lit(segment)))
    for name, (expr, _) in exprs.items():
        base = base.withColumn(tmp[name], expr)

    local_order = Window.partitionBy(*keys, seg).orderBy(order)
    upto = local_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_seg = Window.partitionBy(*keys).orderBy(seg)
    earlier = before_seg.rowsBetween(Window.unboundedPreceding, -1)

    locals_, totals, carries = [], [], []
    for name, (_, kind) in exprs.items():
        c = F.col(tmp[name])
        here, total, carry = f"_l_{name}", f"_t_{name}", f"_c_{name}"
        if kind in ("sum", "min", "max"):
            fn = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
            locals_.append(fn(c).over(upto).alias(here))
            totals.append(fn(c).alias(total))
            carries.append(fn(total).over(earlier).alias(carry))
        elif kind == "last":
            locals_.append(F.last(c, ignorenulls=True).over(upto).alias(here))
            totals.append(F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(earlier).alias(carry))
        elif kind == "prev":
            locals_.append(F.lag(c).over(local_order).alias(here))
            totals.append(F.max_by(c, F.col(order)).alias(total))
            carries.append(F.lag(total).over(before_seg).alias(carry))
        else:
            raise ValueError(f"unknown running kind {kind!r}")

    scanned = base.select(
        "*", *locals_, F.row_number().over(local_order).alias("_pos")
    )
    names = [*keys, seg]
    carried = (
        base.groupBy(*names)
        .agg(*totals)
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], *carries)
    )
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = scanned.join(carried, same, "left")

    out = [F.col(c) for c in df.columns]
    for name, (_, kind) in exprs.items():
        here, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            value = F.coalesce(here + carry, here, carry)
        elif kind == "min":
            value = F.least(here, carry)
        elif kind == "max":
            value = F.greatest(here, carry)
        elif kind == "last":
            value = F.coalesce(here, carry)
        else:
            value = F.when(F.col("_pos") == 1, carry).otherwise(here)
        out.append(value.alias(name))
    return joined.select(*out)


def dense_number(df: DataFrame, order: Sequence[str], name: str = "seq", start: int = 0) -> DataFrame:
    """Gap-free numbering of a whole table in ``order`` (must be unique), from ``start + 1``.

    Range partitioning sorts the table across tasks; only the per-partition counts are scanned
    in one place.  The ranges are saved first, so a lost executor cannot shift them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save_point(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, "_part")
        .select(*df.columns, (F.col("_before") + F.col("_pos") + F.lit(start)).alias(name))
    )


def _grams(chars: Column, size: int) -> Column:
    """Hashes of the distinct pieces of ``size`` characters; none of a shorter text."""
    last = F.size(chars) - size + 1
    pieces = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(chars, i, size), "")))
    return F.when(last > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<long>"))


def _by_rarest_gram(texts: DataFrame, needles: DataFrame, size: int) -> DataFrame:
    """{_digest, _needle}: texts {_digest, _text} that have the rarest piece of a needle {_needle}.

    A text gives a row for each of its pieces that some needle has, and a needle meets only the texts that share
    its rarest piece, so rows follow the hits of rare pieces.  Needles of fewer than ``size`` characters are
    pieces themselves.
    """
    width = F.least(F.char_length("_needle"), F.lit(size))
    named = needles.select("_needle", F.col("_needle").alias("_text")).withColumn("_chars", F.split("_text", "")).withColumn("_w", width)
    own = F.lit(None).cast("array<long>")
    for w in range(1, size + 1):
        own = F.when(F.col("_w") == w, _grams(F.col("_chars"), w)).otherwise(own)
    wanted = save_point(named.select("_needle", "_w", F.explode(own).alias("_gram")))
    widths = [r[0] for r in wanted.select("_w").distinct().collect()]  # at most ``size`` numbers
    chars = F.split("_text", "")
    pieces = F.array_distinct(F.concat(*[_grams(F.col("_chars"), w) for w in sorted(widths)])) if widths else F.array().cast("array<long>")
    held = texts.select("_digest", chars.alias("_chars")).select("_digest", F.explode(pieces).alias("_gram"))
    held = save_point(held.join(wanted.select("_gram").distinct(), "_gram", "left_semi"))
    counted = wanted.join(held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df")), "_gram", "left")
    # a piece that no text has rules its needle out
    rarest = counted.groupBy("_needle").agg(F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram"), F.min(F.coalesce("_df", F.lit(0))).alias("_df"))
    return held.join(rarest.where("_df > 0").select("_needle", "_gram"), "_gram").select("_digest", "_needle").distinct()


def contains_join(
    texts: DataFrame,
    needles: DataFrame,
    text: str,
    needle: str,
    limit: int = NEEDLE_LIMIT,
    ship: int | None = None,
) -> DataFrame:
    """Rows of ``texts`` paired with the rows of ``needles`` whose ``needle`` occurs in ``text``.

    Literal, case-sensitive matching (callers lower-case both sides).  A needle set proven to
    have at most ``limit`` values is tested in a single narrow pass over the texts, and so is one of at most
    ``ship`` values and ``SHIP_CHARS`` characters in all, by one automaton.  In a larger one each needle is looked up by the rarest of its pieces of ``GRAM`` characters, and the texts that
    have this piece are verified.  Equal texts are searched once.  Empty needles match nothing.
    """
    if ship is None:
        ship = SHIP_NEEDLES if limit >= NEEDLE_LIMIT else limit
    distinct = needles.select(F.col(needle).alias("_needle")).where(F.length("_needle") > 0).distinct()
    head = [r[0] for r in distinct.limit(limit + 1).collect()]
    if len(head) <= limit:
        if not head:
            hits = texts.limit(0).withColumn("_needle", F.lit(None).cast("string"))
        else:
            found = F.filter(
                F.array(*[F.lit(v) for v in sorted(head)]), lambda n: F.contains(F.col(text), n)
            )
            hits = texts.withColumn("_needle", F.explode(found))
    elif len(known := _shippable(distinct, ship)) > 0:
        hits = texts.withColumn("_needle", F.explode(_occurring(known)(F.col(text))))
        if needles.columns == [needle] and needles.count() <= ship:
            needles = F.broadcast(needles)
    else:
        keyed = texts.withColumn("_digest", F.sha2(F.col(text), 256))
        seen = keyed.select("_digest", F.col(text).alias("_text")).where(F.col("_text") != "").dropDuplicates(["_digest"])
        found = _by_rarest_gram(seen, distinct, GRAM)
        hits = keyed.join(found, "_digest").where(F.contains(F.col(text), F.col("_needle"))).drop("_digest")
    return hits.join(needles, F.col("_needle") == needles[needle]).drop("_needle")


def _shippable(distinct: DataFrame, ship: int) -> list[str]:
    """All needles if they are proven few and short in all, else none."""
    few = distinct.limit(ship + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_needle")), F.lit(0))).first()
    return [r[0] for r in distinct.collect()] if few[0] <= ship and few[1] <= SHIP_CHARS else []


def _occurring(known: list[str]):
    """UDF: the needles that occur in a text, each once."""

    @F.pandas_udf("array<string>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            from ahocorasick import Automaton
        except ImportError:  # slower, but the same
            search = lambda text: [n for n in known if n in text]
        else:
            machine = Automaton()
            for n in known:
                machine.add_word(n, n)
            machine.make_automaton()
            search = lambda text: list({n for _, n in machine.iter(text)})
        for part in parts:
            yield pd.Series([None if t is None else search(t) for t in part], dtype=object)

    return find


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str | None = None) -> DataFrame:
    """The first ``n`` rows per key.  Spark prunes to ``n`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    col = name or "_rn"
    out = df.withColumn(col, F.row_number().over(w).cast("long")).where(F.col(col) <= n)
    return out if name else out.drop(col)


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of ``one`` to every row of ``df``.

    ``one`` must be a global aggregate: it has exactly one row, which is what makes shipping it
    to every task safe.
    """
    return df.join(F.broadcast(one))



def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[list[tuple]], list[tuple]],
    columns: Sequence[str],
    schema: T.StructType,
) -> DataFrame:
    """``fn(rows of one key, in order) -> rows``, without the cost of one Python call per key.

    Rows are partitioned by key and sorted inside their partition, and each partition is walked
    batch by batch; only the rows of the key at hand are held.  Meant for keys whose groups are
    bounded (a segment, a small graph).  ``columns`` names the values handed to ``fn``; its
    results follow the key columns in ``schema``.
    """
    n = len(keys)
    names = [f.name for f in schema]

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = None
        for pdf in it:
            out: list[tuple] = []
            cols = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in (*keys, *columns)]
            for row in zip(*cols, strict=True):
                key = row[:n]
                if key != at:
                    if held:
                        out.extend((*at, *r) for r in fn(held))
                    at, held = key, []
                held.append(row[n:])
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
        last = [(*at, *r) for r in fn(held)] if held else []
        if last:
            yield pd.DataFrame(last, columns=names, dtype=object)

    sorted_ = df.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInPandas(walk, schema)
