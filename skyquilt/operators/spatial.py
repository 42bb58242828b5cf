"""Spatial joins on grid cells.

Bounding boxes become rows of integer cells and meet in an equi-join, which hash-partitions and
splits under skew; a pair is kept only in the cell of its common lower corner, so nothing has to be
deduplicated afterwards. The exact test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.session import cut


def cells(box: Column, size: float) -> Column:
    """Cells a box touches, as an array of structs."""
    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(box[lo] / size).cast("int"), F.floor(box[hi] / size).cast("int"))

    return F.flatten(F.transform(span("x0", "x1"), lambda cx: F.transform(span("y0", "y1"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def box_candidates(a: DataFrame, b: DataFrame, box_a: str = "a_box", box_b: str = "b_box", cell: float = 10.0) -> DataFrame:
    """Rows of a and b whose boxes meet, each pair once. Column names of a and b must differ."""
    left = a.where(F.col(box_a)["x0"].isNotNull()).withColumn("cell", F.explode(cells(F.col(box_a), cell)))
    right = b.where(F.col(box_b)["x0"].isNotNull()).withColumn("cell", F.explode(cells(F.col(box_b), cell)))
    common = G.intersect_bounds(F.col(box_a), F.col(box_b))
    home = (F.floor(common["x0"] / cell) == F.col("cell.cx")) & (F.floor(common["y0"] / cell) == F.col("cell.cy"))
    return left.join(right, "cell").where(G.bounds_meet(F.col(box_a), F.col(box_b)) & home).drop("cell")


def overlap_join(a: DataFrame, b: DataFrame, ring_a: str = "a_ring", ring_b: str = "b_ring", cell: float = 10.0, min_pct: float = 0.0) -> DataFrame:
    """Pairs with common area and ``overlap`` (ring, inter, pct_a, pct_b, pct_smaller) at ``min_pct`` at least. Rings are convex; null rings go."""
    left = a.where(F.size(ring_a) >= 3).withColumn("a_box", G.bounds(F.col(ring_a)))
    right = b.where(F.size(ring_b) >= 3).withColumn("b_box", G.bounds(F.col(ring_b)))
    # the generator evaluates the clip once, whatever is taken from it later
    kept = F.filter(F.array(G.overlap(F.col(ring_a), F.col(ring_b))), lambda o: o.isNotNull() & (o["pct_smaller"] >= min_pct))
    met = box_candidates(left, right, cell=cell).drop("a_box", "b_box")
    # clips are dear: few rows go to all cores too
    return met.repartition(a.sparkSession.sparkContext.defaultParallelism, ring_a, ring_b).withColumn("overlap", F.explode(kept))


def shapes(rows: DataFrame, side: str) -> DataFrame:
    """The different boxes and rings of one side's rows, each once; ``a_shape`` (or ``b_shape``) tells them apart."""
    return rows.select(F.col(f"{side}_box").alias(f"{side}_shape"), f"{side}_box", f"{side}_ring").distinct()


def of_shapes(met: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Outcomes of pairs of shapes (``a_shape, b_shape, ...``) as those of all pairs of rows that have them, with ids as texts.

    Each pair of shapes is computed once, however many rows have it. Merge joins deal the rows out by shape,
    where a broadcast would leave very many pairs to the tasks of a few small files; hashes sort faster than boxes.
    """
    for s, rows in (("a", a), ("b", b)):
        have = rows.select(F.col(f"{s}_box").alias(f"{s}_shape"), F.col(f"{s}_id").cast("string").alias(f"{s}_id"))
        hashed = [df.withColumn("hash", F.xxhash64(f"{s}_shape")) for df in (met, have)]
        met = hashed[0].join(hashed[1].hint("merge"), ["hash", f"{s}_shape"]).drop("hash", f"{s}_shape")
    return met


def count_points(polygons: DataFrame, points: DataFrame, key: str, ring: str = "ring", x: str = "x", y: str = "y", cell: float = 10.0) -> DataFrame:
    """polygons with ``n_points`` strictly inside, 0 where there are none or the ring is null.

    Counts are summed by key before they meet the polygons again, so a hot polygon costs one row a task.
    """
    boxed = polygons.where(F.size(ring) >= 3).select(key, ring, F.explode(cells(G.bounds(F.col(ring)), cell)).alias("cell"))
    located = points.select(F.col(x).alias("px"), F.col(y).alias("py")).where(F.col("px").isNotNull() & F.col("py").isNotNull() & ~F.isnan("px") & ~F.isnan("py"))
    located = located.withColumn("cell", F.struct(F.floor(F.col("px") / cell).cast("int").alias("cx"), F.floor(F.col("py") / cell).cast("int").alias("cy")))
    inside = located.join(boxed, "cell").where(G.contains(F.col(ring), F.col("px"), F.col("py")))
    counts = inside.groupBy(key).agg(F.count("*").alias("n_points"))
    return polygons.join(counts, key, "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def nearest(probes: DataFrame, grid: DataFrame, probe_key: str, cell: float, limit: float | None = None) -> DataFrame:
    """Nearest grid row of each probe: ``probe_key, grid_id, d2``; ties take the lowest grid_id.

    probes have ``px, py``, grid has ``grid_id, gx, gy``. The 3 x 3 cells around a probe settle it if
    their best is nearer than one cell; the rest look at rings of cells twice as wide until the
    grid's extent is covered (or ``limit``, beyond which probes stay without a match).
    """
    ext = grid.agg(F.min("gx").alias("a"), F.max("gx").alias("b"), F.min("gy").alias("c"), F.max("gy").alias("d")).first()
    if ext.a is None:
        return probes.select(probe_key, F.lit(None).cast("long").alias("grid_id"), F.lit(None).cast("double").alias("d2")).limit(0)
    reach = probes.agg(F.min("px").alias("a"), F.max("px").alias("b"), F.min("py").alias("c"), F.max("py").alias("d")).first()
    if reach.a is None:
        return probes.select(probe_key, F.lit(None).cast("long").alias("grid_id"), F.lit(None).cast("double").alias("d2")).limit(0)
    span = max(ext.b, reach.b) - min(ext.a, reach.a) + max(ext.d, reach.d) - min(ext.c, reach.c)
    out, left, size = None, probes, cell
    while True:
        last = size > span or (limit is not None and size > limit)
        around = F.explode(F.array(*[F.struct((F.floor(F.col("px") / size) + i).alias("cx"), (F.floor(F.col("py") / size) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        celled = grid.select("grid_id", "gx", "gy", F.struct(F.floor(F.col("gx") / size).alias("cx"), F.floor(F.col("gy") / size).alias("cy")).alias("cell"))
        d2 = F.pow(F.col("px") - F.col("gx"), 2) + F.pow(F.col("py") - F.col("gy"), 2)
        best = left.withColumn("cell", around).join(celled, "cell").groupBy(probe_key).agg(F.min(F.struct(d2.alias("d2"), F.col("grid_id").alias("grid_id"))).alias("m"))
        found = best.select(probe_key, F.col("m.grid_id").alias("grid_id"), F.col("m.d2").alias("d2"))
        settled = found if last else cut(found.where(F.col("d2") <= size * size))
        out = settled if out is None else out.union(settled)
        if last:
            return out
        left = cut(left.join(settled.select(probe_key), probe_key, "left_anti"))
        if left.limit(1).count() == 0:
            return out
        size *= 4 if size * 64 < span else max(4.0, span / size + 1)
