"""Packing context items into the token budget of a request."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreworks.functions import text as tx
from loreworks.operators.scale import running

# Bands in filling order, the bands that may not be evicted, budgets and allowances.
BANDS = {1: "system", 2: "tools", 3: "task", 4: "signals", 5: "memory", 6: "retrieval", 7: "history"}
NEVER_EVICT = (1, 2, 3)
BUDGETS = {"route": 2000, "select": 1200, "answer": 2400, "reason": 8000, "summarize": 16000}
ALLOWANCES = {
    "route": (1600, 200, 150, 50, 0, 0, 0),
    "select": (500, 500, 150, 50, 0, 0, 0),
    "answer": (300, 400, 300, 400, 300, 500, 200),
    "reason": (400, 600, 300, 800, 700, 3500, 1200),
    "summarize": (300, 0, 300, 400, 300, 8000, 6000),
}
MIN_ROOM, MARK = 40, " […]"
UNTRUSTED = ("local_foreign", "external")
LEAST_COST = tx.MESSAGE_OVERHEAD

# Code points of each script, as first and last, with its characters per token.
SCRIPTS = (
    (((0x0400, 0x04FF), (0x0500, 0x052F)), tx.CYRILLIC_CPT),
    (((0x4E00, 0x9FFF), (0x3040, 0x30FF)), tx.CJK_CPT),
    (((0x41, 0x5A), (0x61, 0x7A)), tx.LATIN_CPT),
)


def prefix_costs(text: str) -> np.ndarray:
    """Tokens of every prefix of ``text``, from the empty one on: the estimate of
    :func:`loreworks.functions.text.estimate_tokens`, for use inside a task."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    rest, estimate = np.ones(len(code), bool), np.zeros(len(code))
    for spans, per in SCRIPTS:
        mine = np.logical_or.reduce([(code >= low) & (code <= high) for low, high in spans])
        rest &= ~mine
        estimate += np.cumsum(mine) / per
    estimate += np.cumsum(rest) / tx.OTHER_CPT
    blank = np.array([c.isspace() for c in text], bool)
    words = np.cumsum(~blank & np.concatenate([[True], blank[:-1]])) if len(code) else code
    return np.concatenate([[0], np.maximum(estimate.astype(np.int64) + 1, words)]).astype(np.int64)


def count_tokens(text: str) -> int:
    return int(prefix_costs(text)[-1])


def longest_prefix(text: str, tokens: int) -> str:
    """The longest head of ``text`` within ``tokens`` (overhead included), marked when cut."""
    room = tokens - tx.MESSAGE_OVERHEAD
    most = int(np.searchsorted(prefix_costs(text), room, "right")) - 1 if room > 0 else 0
    head = text[:most].rstrip()
    return head + MARK if head and most < len(text) else head


def _take(call: str, bands: list[tuple[int, list]]) -> list[tuple]:
    """(item_no, band, text, cost, how) of what goes into a request; ``bands`` in filling order, items as
    (item_no, text, cost, truncatable).

    In each band the items that fit one after the other are a prefix of the running sum of costs; behind it
    stands one that doesn't fit, which is cut, left out or ends the filling.
    """
    taken, left = [], BUDGETS[call]
    for band, items in bands:
        room, firm = min(ALLOWANCES[call][band - 1], left), band in NEVER_EVICT
        cost = np.array([i[2] for i in items], dtype=np.int64)
        at = 0
        while at < len(items):
            fits = int(np.searchsorted(np.cumsum(cost[at:]), room, "right"))
            taken += [(no, band, text, c, "kept") for no, text, c, _ in items[at : at + fits]]
            spent = int(cost[at : at + fits].sum())
            at += fits
            room, left = room - spent, left - spent
            if at == len(items):
                break
            no, text, _, may_cut = items[at]
            head = longest_prefix(text, room) if may_cut and (firm or room > MIN_ROOM) else ""
            if firm and not head:
                return [*taken, (no, band, None, 0, "over budget")]
            if may_cut and room > MIN_ROOM or head:
                spent = count_tokens(head) + tx.MESSAGE_OVERHEAD
                taken.append((no, band, head, spent, "truncated"))
                room, left = room - spent, left - spent
            at += 1
    return taken


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["band", "item_no"], kind="stable")
    bands = [
        (int(band), list(zip(g["item_no"], g["text"], g["cost"], g["truncatable"], strict=True))) for band, g in pdf.groupby("band", sort=True)
    ]
    rows = [(pdf["request"].iloc[0], *r) for r in _take(pdf["call_type"].iloc[0], bands)]
    return pd.DataFrame(rows, columns=["request", "item_no", "band", "text", "cost", "how"])


def _candidates(items: DataFrame) -> DataFrame:
    """Items that may still be taken: bounded per request, and nothing that could fit is lost.

    Room only shrinks, so when an item fits, every earlier one of its band and cost fitted too:
    of one cost, no more than allowance / cost items can be taken.  Cutting an item to fit
    spends at least ``LEAST_COST``, so of the items that may be cut (those above the smallest
    room worth filling) no more than allowance / LEAST_COST can be.  A band that may not be
    evicted ends in an error once its items outnumber that, so its first ones decide.
    """
    costed = items.withColumn("cost", tx.item_cost(F.col("text"))).withColumn("band", F.col("band").cast("int"))
    caps = F.create_map(
        *[x for name, cap in ALLOWANCES.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in cap]))]
    )
    capped = costed.withColumn("_cap", F.get(F.try_element_at(caps, F.col("call_type")), F.col("band") - 1)).where("_cap > 0")
    firm = F.col("band").isin(*NEVER_EVICT)
    cuttable = F.col("truncatable") & (F.col("cost") > MIN_ROOM)
    group = F.when(firm, F.lit(-2)).when(cuttable, F.lit(-1)).otherwise(F.col("cost"))
    keyed = capped.withColumn("_group", group)
    most = max(max(c) for c in ALLOWANCES.values()) // LEAST_COST + 1
    w = Window.partitionBy("request", "band", "_group").orderBy("item_no")
    head = keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    enough = F.when(F.col("_group") < 0, F.col("_cap") / LEAST_COST + 1).otherwise(F.col("_cap") / F.col("cost"))
    return head.where(F.col("_rn") <= enough).drop("_rn", "_group", "_cap")


def pack_context(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept {request, item_no, band, text, cost, how}, report per request).

    ``items`` is {request, call_type, item_no, band, text, truncatable, provenance, source}.
    The report is {request, tokens, kept, truncated, dropped, tainted, over_budget}.
    """
    schema = T.StructType(
        [
            items.schema["request"], items.schema["item_no"], T.StructField("band", T.IntegerType()),
            T.StructField("text", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("how", T.StringType()),
        ]
    )
    kept = _candidates(items).select("request", "call_type", "item_no", "band", "text", "cost", "truncatable").groupBy(
        "request"
    ).applyInPandas(_fill, schema)
    marks = items.select("request", "item_no", "provenance").join(kept.drop("text"), ["request", "item_no"], "left")
    took = F.col("how").isin("kept", "truncated")
    report = marks.groupBy("request").agg(
        F.coalesce(F.sum(F.when(took, F.col("cost"))), F.lit(0)).alias("tokens"),
        F.count_if(took).alias("kept"),
        F.count_if(F.col("how") == "truncated").alias("truncated"),
        F.count_if(F.col("how").isNull()).alias("dropped"),
        F.coalesce(F.bool_or(took & F.col("provenance").isin(*UNTRUSTED)), F.lit(False)).alias("tainted"),
        F.coalesce(F.bool_or(F.col("how") == "over budget"), F.lit(False)).alias("over_budget"),
    )
    return kept.where(took), report


def band_spend(kept: DataFrame) -> DataFrame:
    """{request, band, tokens}."""
    return kept.groupBy("request", "band").agg(F.sum("cost").alias("tokens"))


def fit_whole_items(items: DataFrame) -> DataFrame:
    """{request, item_no, fits}: the simpler rule that never cuts and stops at the first overflow.

    Running sums only; costs are positive, so once a band is full it stays full.
    """
    costed = items.withColumn("cost", tx.item_cost(F.col("text")))
    caps = F.create_map(
        *[x for name, cap in ALLOWANCES.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in cap]))]
    )
    summed = running(costed, ["request", "band"], "item_no", {"_upto": (F.col("cost"), "sum")})
    cap = F.get(F.try_element_at(caps, F.col("call_type")), F.col("band").cast("int") - 1)
    return summed.select("request", "item_no", (F.col("_upto") <= cap).alias("fits"))
