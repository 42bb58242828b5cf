"""Neighbour graphs of detected features and matching between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.session import cut

PAD_RATIO = 3.0


def significant(v: Column, digits: int) -> Column:
    """A value of 0 or more, rounded to so many digits from its first."""
    p = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(v)))
    return F.when(v > 0, F.rint(v * p) / p).otherwise(v)


def knn_edges(nodes: DataFrame, k: int, group: str = "g", key: str = "id", cell: float | None = None, digits: int | None = None) -> DataFrame:
    """Undirected edges ``group, a, b, dist, size_ratio`` of each node's k nearest nodes in its group.

    nodes: ``g, id, x, y, radius``; x and y in metres. Distance ties go to the lower id; with ``digits``
    distances are tied whose squares agree to so many digits, as scaling or turning a graph moves the last ones. Nodes are
    compared within 3 x 3 cells, which settle those whose k-th neighbour is nearer than a cell; the
    rest go on with wider cells, in the end with their whole group. The first ``cell`` holds about k nodes
    if they spread evenly, unless it is given.
    """
    a = nodes.select(group, *[F.col(c).alias(f"a_{c}") for c in (key, "x", "y", "radius")])
    b = nodes.select(group, *[F.col(c).alias(f"b_{c}") for c in (key, "x", "y", "radius")])
    ext = nodes.groupBy(group).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    size, span = ext.agg(F.percentile_approx(F.sqrt(F.greatest(F.col("w") * F.col("h"), F.lit(1e-12)) * k / F.col("n")), 0.5), F.max(F.greatest("w", "h"))).first()
    if size is None:
        size = span = 1.0
    size = cell or max(size, span / 2**20, 1e-6)
    d2 = F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2)
    order = Window.partitionBy(group, f"a_{key}").orderBy("d2" if digits is None else significant(F.col("d2"), digits), f"b_{key}")
    sure = 1.0 if digits is None else 1 - 10.0 ** (2 - digits)  # nothing beyond a cell is tied with what is nearer than that
    near, left = None, a
    while True:
        last = size >= span
        at = lambda s, i=0, j=0: F.struct((F.floor(F.col(f"{s}_x") / size) + i).alias("cx"), (F.floor(F.col(f"{s}_y") / size) + j).alias("cy"))  # noqa: B023, E731
        around = F.explode(F.array(*[at("a", i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        met = left.withColumn("cell", around).join(b.withColumn("cell", at("b")), [group, "cell"]).drop("cell").where(F.col(f"a_{key}") != F.col(f"b_{key}"))
        close = met.withColumn("d2", d2).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        if not last:
            close = cut(close)
            full = close.groupBy(group, f"a_{key}").agg(F.count("*").alias("n"), F.max("d2").alias("far")).where((F.col("n") == k) & (F.col("far") <= size * size * sure)).select(group, f"a_{key}")
            left = cut(left.join(full, [group, f"a_{key}"], "left_anti"))
            close = close.join(full, [group, f"a_{key}"], "left_semi")
            last = left.limit(1).count() == 0
        near = close if near is None else near.unionByName(close)
        if last:
            break
        size *= 4
    pair = near.select(group, F.least(f"a_{key}", f"b_{key}").alias("a"), F.greatest(f"a_{key}", f"b_{key}").alias("b"), F.sqrt("d2").alias("dist"), size_ratio(F.col("a_radius"), F.col("b_radius")).alias("size_ratio"))
    return pair.dropDuplicates([group, "a", "b"])


def size_ratio(r1: Column, r2: Column) -> Column:
    return F.when(F.greatest(r1, r2) > 0, F.least(r1, r2) / F.greatest(r1, r2)).otherwise(F.lit(0.0))


def neighborhoods(nodes: DataFrame, edges: DataFrame, k: int, group: str = "g", key: str = "id", digits: int | None = None) -> DataFrame:
    """``group, id, ids, dist, dist_ratio, size_ratio, descriptor`` of each node: its k nearest along edges, padded.

    Padding: id -1, distance infinite, distance ratio 3, size ratio 0. Ratios are to the median distance.
    The descriptor is the distance ratios followed by the size ratios. ``digits`` as for the edges.
    """
    both = edges.select(group, F.col("a").alias(key), F.col("b").alias("nb"), "dist", "size_ratio").unionByName(edges.select(group, F.col("b").alias(key), F.col("a").alias("nb"), "dist", "size_ratio"))
    far = F.col("dist") if digits is None else significant(F.pow("dist", F.lit(2)), digits)
    nth = F.row_number().over(Window.partitionBy(group, key).orderBy(far, "nb"))
    near = both.withColumn("nth", nth).where(F.col("nth") <= k).groupBy(group, key).agg(F.array_sort(F.collect_list(F.struct("nth", "nb", "dist", "size_ratio"))).alias("s"), F.median("dist").alias("med"))
    n = nodes.select(group, key).join(near, [group, key], "left")
    have = F.coalesce(F.size(F.when(F.col("s").isNotNull(), F.col("s"))), F.lit(0))
    pad = lambda col, value: F.concat(F.coalesce(col, F.slice(F.array(value), 1, 0)), F.array_repeat(value, F.lit(k) - have))
    ratio = F.transform("s", lambda e: F.when(F.col("med") > 0, e["dist"] / F.col("med")).otherwise(F.lit(1.0)))
    out = n.select(
        group, key, pad(F.transform("s", lambda e: e["nb"].cast("long")), F.lit(-1).cast("long")).alias("ids"), pad(F.transform("s", lambda e: e["dist"]), F.lit(float("inf"))).alias("dist"),
        pad(ratio, F.lit(PAD_RATIO)).alias("dist_ratio"), pad(F.transform("s", lambda e: e["size_ratio"]), F.lit(0.0)).alias("size_ratio"),
    )
    return out.withColumn("descriptor", F.concat("dist_ratio", "size_ratio"))


def gaussian_similarity(a: Column, b: Column, sigma: float) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.exp(-F.pow((y - x) / sigma, 2) / 2)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def top_matches(a: DataFrame, b: DataFrame, cost: Column, n: int, group: str = "g") -> DataFrame:
    """The n cheapest b of each a in the same group, ties to the lower b_id: ``a_id, b_id, cost, nth``.

    The window keeps n rows for each a before the final sort (a group limit in each task).
    """
    pairs = a.join(b, group).select(group, "a_id", "b_id", cost.alias("cost"))
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy(group, "a_id").orderBy("cost", "b_id"))).where(F.col("nth") <= n)


def lowe_matches(a: DataFrame, b: DataFrame, cost: Column, ratio: float, group: str = "g") -> DataFrame:
    """Matches whose best cost is below ``ratio`` times the second best: ``a_id, b_id, cost, ratio``.

    A second best of 0 is no rival; with one candidate the second best costs 1 for similarities
    (their complement) and the match stands.
    """
    top = top_matches(a, b, cost, 2, group)
    both = top.groupBy(group, "a_id").agg(F.min_by("b_id", "nth").alias("b_id"), F.min("cost").alias("cost"), F.max(F.when(F.col("nth") == 2, F.col("cost"))).alias("second"))
    second = F.coalesce("second", F.lit(1.0))
    return both.where((second <= 0) | (F.col("cost") < ratio * second)).select(group, "a_id", "b_id", "cost", F.coalesce(F.try_divide("cost", second), F.lit(0.0)).alias("ratio"))


def consistent_matches(matches: DataFrame, hood_a: DataFrame, hood_b: DataFrame, tolerance: float = 0.5, group: str = "g") -> DataFrame:
    """Matches of which at least 1 - tolerance of A's k slots map onto neighbours of the B node; padding slots count as misses."""
    na = hood_a.select(group, F.col("id").alias("a_id"), F.col("ids").alias("na"))
    nb = hood_b.select(group, F.col("id").alias("b_id"), F.col("ids").alias("nb"))
    m = matches.join(na, [group, "a_id"]).join(nb, [group, "b_id"])
    mapped = matches.select(group, F.col("a_id").alias("n"), F.col("b_id").alias("n_b"))
    hits = m.select(group, "a_id", "b_id", F.size("na").alias("k"), "nb", F.explode("na").alias("n")).join(mapped, [group, "n"], "left")
    share = hits.groupBy(group, "a_id", "b_id").agg((F.count_if(F.coalesce(F.array_contains("nb", F.col("n_b")), F.lit(False)) & (F.col("n") != -1)) / F.max("k")).alias("share"))
    return matches.join(share.where(F.col("share") >= 1 - tolerance).drop("share"), [group, "a_id", "b_id"], "left_semi")


def mutual_matches(hood_a: DataFrame, hood_b: DataFrame, n_candidates: int = 8, sigma: float = 0.5, min_similarity: float = 0.1, d_tol: float = 0.6, s_tol: float = 0.6, min_fraction: float = 0.5, ratio: float | None = 0.6, physical: bool = False, group: str = "g") -> DataFrame:
    """Two passes: the most similar descriptors, then how many of A's neighbours find a partner of their own among B's.

    Partners are taken nearest first, each the cheapest unused one within the tolerances of log
    distance and size ratio; this order matters, so an Arrow UDF does it for the shortlisted pairs.

    Nodes of a side that agree in all that is compared cannot be told apart. They are compared once, and
    when they match such nodes of the other side they are dealt out to these one to one in the order of
    ids (from the first again where B has fewer). For the ratio test they are each other's rivals.
    """
    import pandas as pd

    def side(hood: DataFrame, s: str) -> DataFrame:
        d = "dist" if physical else "dist_ratio"
        have = F.size(F.filter("ids", lambda i: i != -1))
        alike = Window.partitionBy(group, F.transform(F.concat("descriptor", d), lambda v: F.round(v, 9) + 0.0), have)
        return hood.select(
            group, F.col("id").alias(f"{s}_node"), F.col("descriptor").alias(f"{s}_d"), F.struct("ids", F.col(d).alias("d"), F.col("size_ratio").alias("s")).alias(f"{s}_n"),
            F.min("id").over(alike).alias(f"{s}_id"), F.row_number().over(alike.orderBy("id")).alias(f"{s}_place"), F.count("*").over(alike).alias(f"{s}_size"),
        )

    a_nodes, b_nodes = cut(side(hood_a, "a")), cut(side(hood_b, "b"))
    a, b = a_nodes.where("a_place = 1"), b_nodes.where("b_place = 1")
    dissimilar = 1 - gaussian_similarity(F.col("a_d"), F.col("b_d"), sigma)
    short = top_matches(a.select(group, "a_id", "a_d"), b.select(group, "b_id", "b_d"), dissimilar, n_candidates, group).where(F.col("cost") <= 1 - min_similarity)

    def count(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        return pd.Series([greedy_partners(p["ids"], p["d"], p["s"], q["ids"], q["d"], q["s"], d_tol, s_tol) for p, q in zip(x.to_dict("records"), y.to_dict("records"), strict=True)])

    count.__annotations__ = {"x": pd.DataFrame, "y": pd.DataFrame, "return": pd.Series}
    partners = F.pandas_udf(count, "long")
    hits = short.join(a.select(group, "a_id", "a_n"), [group, "a_id"]).join(b.select(group, "b_id", "b_n", "b_size"), [group, "b_id"])
    have = F.size(F.filter("a_n.ids", lambda i: i != -1))
    scored = hits.select(group, "a_id", "b_id", "b_size", "nth", partners("a_n", "b_n").alias("count"), have.alias("have")).withColumn("fraction", F.coalesce(F.try_divide("count", "have"), F.lit(0.0)))
    w = Window.partitionBy(group, "a_id").orderBy(F.desc("fraction"), "nth")
    rival = F.when(F.lit(n_candidates > 1) & (F.col("b_size") > 1), F.col("fraction")).otherwise(F.lead("fraction").over(w))
    best = scored.withColumn("r", F.row_number().over(w)).withColumn("second", rival).where("r = 1").where(F.col("fraction") >= min_fraction)
    if ratio is not None:
        rival = 1 - F.col("second")
        best = best.where(F.col("second").isNull() | (rival <= 0) | (1 - F.col("fraction") < ratio * rival))
    dealt = a_nodes.select(group, "a_id", "a_node", "a_place").join(best, [group, "a_id"]).withColumn("b_place", (F.col("a_place") - 1) % F.col("b_size") + 1)
    met = dealt.join(b_nodes.select(group, "b_id", "b_place", "b_node"), [group, "b_id", "b_place"])
    return met.select(group, F.col("a_node").alias("a_id"), F.col("b_node").alias("b_id"), F.col("fraction").alias("similarity"), F.col("count").alias("mutual_count"))


def greedy_partners(ids_a, d_a, s_a, ids_b, d_b, s_b, d_tol: float, s_tol: float) -> int:  # noqa: ANN001
    """Neighbours of A, nearest first, that get a distinct partner in B."""
    import numpy as np

    ka, kb = np.asarray(ids_a) != -1, np.asarray(ids_b) != -1
    la, lb = np.log(np.asarray(d_a, float)[ka] + 1e-9), np.log(np.asarray(d_b, float)[kb] + 1e-9)
    sa, sb = np.asarray(s_a, float)[ka], np.asarray(s_b, float)[kb]
    free, n = np.ones(len(lb), bool), 0
    for i in np.argsort(la, kind="stable"):
        dl, ds = np.abs(lb - la[i]), np.abs(sb - sa[i])
        ok = free & (dl <= d_tol) & (ds <= s_tol)
        if ok.any():
            free[np.argmin(np.where(ok, dl + ds, np.inf))] = False
            n += 1
    return n


def match_points(matches: DataFrame, points_a: DataFrame, points_b: DataFrame, group: str = "g") -> DataFrame:
    """``a_id, b_id, ax, ay, bx, by`` of matches."""
    side = lambda p, s: p.select(group, F.col("id").alias(f"{s}_id"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    return matches.join(side(points_a, "a"), [group, "a_id"]).join(side(points_b, "b"), [group, "b_id"])
