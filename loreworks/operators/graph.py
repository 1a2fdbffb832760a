"""The knowledge graph: link resolution, semantic edges, components, reach and placement.

Edges are {a, b} with a < b and each pair once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreworks.functions import text as tx
from loreworks.operators.knn import knn_topk
from loreworks.operators.corpus import fingerprint
from loreworks.operators.evaluation import order_stats
from loreworks.operators.scale import attach_row, dense_number
from loreworks.session import save_point

DEFAULT_K, DEFAULT_THRESHOLD = 4, 0.85
HUB = 1024
UNEMBEDDABLE = ("config",)


def resolve_links(documents: DataFrame, links: DataFrame) -> DataFrame:
    """{src, to_path, dst, status} with status edge, ambiguous, dangling or self.

    A target is matched by lower-cased file stem; several candidates resolve only if exactly one
    lies in the source's collection.  Candidates are counted per stem before any join, so a stem
    that a large share of the documents carries costs one row, not one row per document.
    """
    docs = documents.select("doc_id", "collection", tx.path_stem(F.col("rel_path")).alias("stem"))
    by_stem = docs.groupBy("stem").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_only"))
    by_home = docs.groupBy("stem", "collection").agg(F.count(F.lit(1)).alias("_hn"), F.min("doc_id").alias("_honly"))
    asked = (
        links.select("src", "to_path", tx.path_stem(F.coalesce("to_path", F.lit(""))).alias("stem"))
        .join(documents.select(F.col("doc_id").alias("src"), "collection"), "src")
        .join(by_stem, "stem", "left")
        .join(by_home, ["stem", "collection"], "left")
    )
    dst = F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_hn") == 1, F.col("_honly"))
    status = (
        F.when(F.col("_n").isNull(), "dangling")
        .when(dst.isNull(), "ambiguous")
        .when(dst == F.col("src"), "self")
        .otherwise("edge")
    )
    return asked.select("src", "to_path", dst.alias("dst"), status.alias("status"))


def link_stats(resolved: DataFrame) -> DataFrame:
    """One row {exact, basename, ambiguous, dangling, self}; ``exact`` is kept and never counted."""
    n = lambda s: F.count_if(F.col("status") == s)
    return resolved.agg(
        F.lit(0).cast("long").alias("exact"), n("edge").alias("basename"), n("ambiguous").alias("ambiguous"),
        n("dangling").alias("dangling"), n("self").alias("self"),
    )


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def explicit_edges(resolved: DataFrame) -> DataFrame:
    return undirected(resolved.where("status = 'edge'"), "src", "dst")


def neighbour_table(vectors: DataFrame, k: int, threshold: float | None, **options) -> DataFrame:
    """{qid, id, sim, rank} of each vector's nearest others, at or above the threshold."""
    return knn_topk(
        vectors.select(F.col("id").alias("qid"), "vec"), vectors, k, skip_self=True, floor=threshold, **options
    )


def semantic_edges(vectors: DataFrame, k: int = DEFAULT_K, threshold: float = DEFAULT_THRESHOLD, **options) -> DataFrame:
    return undirected(neighbour_table(vectors, k, threshold, **options), "qid", "id")


def merge_edges(explicit: DataFrame, semantic: DataFrame, nodes: DataFrame) -> DataFrame:
    """{a, b, kind}: known nodes only; a pair that is linked explicitly is not also semantic."""
    ids = nodes.select("id")

    def known(edges: DataFrame) -> DataFrame:
        return (
            edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi")
            .join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
        )

    solid = known(explicit)
    inferred = known(semantic).join(solid, ["a", "b"], "left_anti")
    return solid.withColumn("kind", F.lit("explicit")).unionByName(inferred.withColumn("kind", F.lit("semantic")))


def both_ways(edges: DataFrame) -> DataFrame:
    """{u, v} in both directions; a narrow explode, no shuffle."""
    pair = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return edges.select(F.explode(pair).alias("_e")).select("_e.u", "_e.v")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def node_states(documents: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """{id, collection, kind, state, degree}; failed beats unembeddable beats placed."""
    have = vectors.select("id").distinct().withColumn("_v", F.lit(True))
    state = (
        F.when(F.col("parse_error").isNotNull(), "failed")
        .when(F.col("kind").isin(*UNEMBEDDABLE) | F.col("_v").isNull(), "unembeddable")
        .otherwise("placed")
    )
    return (
        documents.withColumnRenamed("doc_id", "id")
        .join(have, "id", "left").join(degrees(edges), "id", "left")
        .select("id", "collection", "rel_path", "kind", state.alias("state"), F.coalesce("degree", F.lit(0)).alias("degree"))
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """{documents, orphans, unplaced, explicit_edges, semantic_edges}."""
    placed = F.col("state") == "placed"
    at = positions.select("id").distinct().withColumn("_at", F.lit(True))
    n = nodes.join(at, "id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("degree") == 0) & placed).alias("orphans"),
        F.count_if(placed & F.col("_at").isNull()).alias("unplaced"),
    )
    e = edges.agg(
        F.count_if(F.col("kind") == "explicit").alias("explicit_edges"),
        F.count_if(F.col("kind") == "semantic").alias("semantic_edges"),
    )
    return attach_row(n, e)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """{id, component}: the smallest id each node is connected to.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014): every round links
    nodes to the least neighbour they know, so the number of rounds grows with the logarithm of
    the size, not with the diameter, and a hub costs one aggregated row.
    """
    pairs = save_point(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(pairs)
    while True:
        sym = both_ways(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = save_point(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        pairs = save_point(small)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    labels = pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_stats(labels: DataFrame) -> DataFrame:
    """{components, largest, largest_share}."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("largest"),
        F.round(F.coalesce(F.max("_n") / F.sum("_n"), F.lit(0.0)), 4).alias("largest_share"),
    )


def two_hop(edges: DataFrame, picks: DataFrame, hops_apart: bool = False, hub: int = HUB) -> DataFrame:
    """{id, reach}: nodes one or two steps away from each picked node; with ``hops_apart`` exactly two.

    Steps through a node of at most ``hub`` neighbours are paired as they are.  A hub's neighbours are numbered and
    kept as bitmaps of 32,768 nodes each, so a step through it costs a row for each of its bitmaps instead of
    one for each of its neighbours.  Both are exact, and nothing grows with the square of a degree.
    """
    sym = save_point(both_ways(edges).where("u <> v").distinct())
    degree = sym.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    big = degree.where(F.col("d") > hub).select("u")
    wanted = picks.select(F.col("id").alias("u")).distinct()
    one = sym.join(wanted, "u", "left_semi")
    # through nodes that are no hubs: at most ``hub`` rows for each step
    near = one.select(F.col("u").alias("id"), F.col("v").alias("u")).join(sym.join(big, "u", "left_anti"), "u").select("id", F.col("v").alias("at"))
    plain = one.select(F.col("u").alias("id"), F.col("v").alias("at")).unionByName(near).where("id <> at").distinct()
    nodes = sym.select("u").distinct()
    if big.isEmpty():
        reach = plain.groupBy("id").agg(F.count(F.lit(1)).alias("reach"))
    else:
        numbered = save_point(dense_number(nodes, ["u"], "nth"))
        hubs = (
            sym.join(big, "u", "left_semi").withColumnRenamed("u", "h").join(numbered.select(F.col("u").alias("v"), "nth"), "v")
            .groupBy("h", F.bitmap_bucket_number("nth").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("nth")).alias("bits"))
        )
        through = one.withColumnRenamed("v", "h").join(hubs, "h").groupBy(F.col("u").alias("id"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        through = save_point(through)
        place = plain.join(numbered.select(F.col("u").alias("at"), "nth"), "at").select("id", F.bitmap_bucket_number("nth").alias("bucket"), F.bitmap_bit_position("nth").alias("bit"))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        seen = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1, F.lit(False))
        rest = place.join(through, ["id", "bucket"], "left").where(~seen).groupBy("id").agg(F.count(F.lit(1)).alias("reach"))
        # a node next to a hub is itself among the hub's neighbours
        covered = through.groupBy("id").agg((F.sum(F.bitmap_count("bits")) - 1).alias("reach"))
        reach = rest.unionByName(covered).groupBy("id").agg(F.sum("reach").alias("reach"))
    steps = one.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("d")) if hops_apart else None
    out = picks.select("id").join(reach, "id", "left").select("id", F.coalesce("reach", F.lit(0)).alias("reach"))
    return out if steps is None else out.join(steps, "id", "left").select("id", (F.col("reach") - F.coalesce("d", F.lit(0))).alias("reach"))


def reach_sketch(edges: DataFrame, picks: DataFrame, lg_k: int = 12) -> DataFrame:
    """{id, reach}: about how many nodes are one or two steps away, by mergeable distinct sketches.

    A node's sketch holds itself and its neighbours; a picked node merges those of its neighbours, one row for each
    edge.  The relative standard error is 1.04 / sqrt(2^lg_k), 1.6 % by default.
    """
    sym = both_ways(edges).where("u <> v").distinct()
    own = sym.groupBy("u").agg(F.hll_sketch_agg("v", F.lit(lg_k)).alias("sketch"))
    near = sym.join(picks.select(F.col("id").alias("u")), "u", "left_semi")
    merged = near.join(own.withColumnRenamed("u", "v"), "v").unionByName(near.select("u").distinct().join(own, "u"), allowMissingColumns=True)
    reach = merged.groupBy(F.col("u").alias("id")).agg((F.hll_sketch_estimate(F.hll_union_agg("sketch")) - 1).alias("reach"))
    return picks.select("id").join(reach, "id", "left").select("id", F.coalesce("reach", F.lit(0)).alias("reach"))


def sample_nodes(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """All embeddable nodes, or a repeatable sample of ``n`` of them."""
    able = nodes.where(~F.col("kind").isin(*UNEMBEDDABLE)).select("id")
    return able if n is None else able.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n)


def reach_stats(reach: DataFrame, total: DataFrame) -> DataFrame:
    """{two_hop_median, two_hop_median_share, two_hop_p90} over {id, reach} and one row {n}."""
    spot = (F.col("n") - 1) * 0.9
    picks = {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.floor(F.col("n") / 2), "_c": F.floor(spot), "_d": F.ceil(spot)}
    got = order_stats(reach.withColumn("_all", F.lit(1)), ["_all"], "reach", picks).withColumn("_spot", spot).drop("n")
    middle = (F.col("_a") + F.col("_b")) / 2
    high = F.col("_c") + (F.col("_d") - F.col("_c")) * (F.col("_spot") - F.floor("_spot"))
    return attach_row(got, total).select(
        F.floor(middle).alias("two_hop_median"),
        F.round(middle / F.greatest(F.col("n"), F.lit(1)), 4).alias("two_hop_median_share"),
        F.floor(high).alias("two_hop_p90"),
    )


def edge_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """{edges, cross_collection_edges, orphans, orphan_share, avg_degree}."""
    home = nodes.select("id", "collection")
    tagged = edges.join(home.select(F.col("id").alias("a"), F.col("collection").alias("_ca")), "a").join(
        home.select(F.col("id").alias("b"), F.col("collection").alias("_cb")), "b"
    )
    e = tagged.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("_ca") != F.col("_cb")).alias("cross_collection_edges")
    )
    able = ~F.col("kind").isin(*UNEMBEDDABLE)
    n = nodes.join(degrees(edges).withColumnRenamed("degree", "_d"), "id", "left").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(able).alias("_able"), F.count_if(able & F.col("_d").isNull()).alias("orphans")
    )
    return attach_row(e, n).select(
        "edges", "cross_collection_edges", "orphans",
        F.round(F.col("orphans") / F.greatest(F.col("_able"), F.lit(1)), 4).alias("orphan_share"),
        F.round(2 * F.col("edges") / F.greatest(F.col("_n"), F.lit(1)), 2).alias("avg_degree"),
    )


def edge_sweep(vectors: DataFrame, ks: list[int], thresholds: list[float], **options) -> DataFrame:
    """{k, threshold, edges, nodes}: edge counts for every setting, from one neighbour search."""
    near = neighbour_table(vectors, max(ks), min(thresholds), **options)
    grid = F.array(
        *[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(t)).alias("threshold")) for k in ks for t in thresholds]
    )
    fits = F.filter(grid, lambda g: (F.col("rank") <= g["k"]) & (F.col("sim") >= g["threshold"]))
    edges = (
        near.select(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), F.explode(fits).alias("_g"))
        .select("_g.k", "_g.threshold", "a", "b").distinct()
    )
    touched = edges.select("k", "threshold", F.explode(F.array("a", "b")).alias("_n")).distinct()
    return edges.groupBy("k", "threshold").agg(F.count(F.lit(1)).alias("edges")).join(
        touched.groupBy("k", "threshold").agg(F.count(F.lit(1)).alias("nodes")), ["k", "threshold"]
    )


def corpus_census(documents: DataFrame, links: DataFrame) -> DataFrame:
    """{facet, value, n}: documents in all, by kind, by collection; unembeddable, failed, links.

    The facet ``fingerprint`` tells whether two censuses saw the same documents: a hash tree over id, kind and
    collection in the order of ids.
    """
    facets = F.array_compact(
        F.array(
            F.struct(F.lit("documents").alias("facet"), F.lit("").alias("value")),
            F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("value")),
            F.struct(F.lit("collection").alias("facet"), F.col("collection").alias("value")),
            F.when(F.col("kind").isin(*UNEMBEDDABLE), F.struct(F.lit("unembeddable").alias("facet"), F.lit("").alias("value"))),
            F.when(F.col("parse_error").isNotNull(), F.struct(F.lit("parse_error").alias("facet"), F.lit("").alias("value"))),
        )
    )
    docs = documents.select(F.explode(facets).alias("_f")).groupBy("_f.facet", "_f.value").agg(F.count(F.lit(1)).alias("n"))
    lines = documents.select("doc_id", F.concat_ws("|", "doc_id", "kind", "collection").alias("text"))
    seal = fingerprint(lines, "census", order="doc_id").select(F.lit("fingerprint").alias("facet"), F.col("digest").alias("value"), F.lit(1).cast("long").alias("n"))
    return docs.unionByName(
        links.agg(F.lit("links").alias("facet"), F.lit("").alias("value"), F.count(F.lit(1)).alias("n"))
    ).unionByName(seal)


def place_new(vectors: DataFrame, positions: DataFrame, k: int = DEFAULT_K, **options) -> DataFrame:
    """{id, x, y} for vectors without a position: the centroid of their nearest placed neighbours.

    Without placed neighbours a document goes to the origin; nothing already placed moves.
    """
    placed = vectors.join(positions.select("id"), "id", "left_semi")
    fresh = vectors.join(positions.select("id"), "id", "left_anti").select(F.col("id").alias("qid"), "vec")
    near = knn_topk(fresh, placed, k, **options)
    mid = near.join(positions, "id").groupBy("qid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return fresh.select("qid").join(mid, "qid", "left").select(
        F.col("qid").alias("id"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")
    )


def neighbour_overlap(before: DataFrame, after: DataFrame, k: int = 10, **options) -> DataFrame:
    """{id, jaccard} of each node's ``k`` nearest in two layouts {id, x, y}."""

    def near(layout: DataFrame) -> DataFrame:
        points = layout.select("id", F.array("x", "y").alias("vec"))
        return knn_topk(
            points.select(F.col("id").alias("qid"), "vec"), points, k, skip_self=True, metric="distance", **options
        ).select("qid", "id")

    one = near(before).withColumn("_a", F.lit(1))
    two = near(after).withColumn("_b", F.lit(1))
    both = one.join(two, ["qid", "id"], "full_outer")
    return both.groupBy(F.col("qid").alias("id")).agg(
        (F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count(F.lit(1))).alias("jaccard")
    )


def layout_stability(before: DataFrame, after: DataFrame, k: int = 10, **options) -> DataFrame:
    return neighbour_overlap(before, after, k, **options).agg(
        F.round(F.coalesce(F.avg("jaccard"), F.lit(0.0)), 6).alias("jaccard"), F.count(F.lit(1)).alias("nodes")
    )


def filter_nodes(nodes: DataFrame, positions: DataFrame, mode: str = "all", contains: str = "") -> DataFrame:
    """Nodes shown for a filter: orphans, failed, unplaced (incrementally placed) or all."""
    at = positions.select("id", F.col("placed").alias("_placed"))
    keep = {
        "all": F.lit(True),
        "orphans": (F.col("degree") == 0) & (F.col("state") == "placed"),
        "failed": F.col("state") == "failed",
        "unplaced": F.col("_placed") == "incremental",
    }[mode]
    needle = contains.strip().lower()
    if needle:
        keep = keep & F.contains(F.lower("rel_path"), F.lit(needle))
    return nodes.join(at, "id", "left").where(keep).drop("_placed")
