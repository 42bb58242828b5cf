"""Label tree to overlap manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.functions import text as X
from skyquilt.functions import transforms as T
from skyquilt.operators import spatial
from skyquilt.sources import labels, manifest


def overlap_pairs(products: DataFrame, min_pct: float = 0.0, cell: float = 5.0) -> DataFrame:
    """``pair_id, a_id, b_id, pct_smaller, pct_a, pct_b, corners, centroid, forward, backward, method`` of OHRC x TMC2 products with common ground."""
    def side(kind: str, s: str) -> DataFrame:
        p = products.where(F.col("instrument") == kind)
        ring = G.ring_from_footprint(F.col("footprint"))
        return p.select(F.col("product_id").alias(f"{s}_id"), ring.alias(f"{s}_ring"), F.col("lines").alias(f"{s}_lines"), F.col("samples").alias(f"{s}_samples")).where(G.is_convex(F.col(f"{s}_ring")))

    joined = spatial.overlap_join(side("OHRC", "a"), side("TMC2", "b"), cell=cell, min_pct=min_pct)
    pairs = joined.withColumn("pair_id", X.pair_id(F.col("a_id"), F.col("b_id"))).persist()
    flat = lambda c: F.flatten(F.transform(c, lambda p: F.array(p["x"], p["y"])))
    fitted = T.corner_transform(pairs.select("pair_id", "a_lines", "a_samples", "b_lines", "b_samples", flat("a_ring").alias("a_foot"), flat("b_ring").alias("b_foot")))
    shape = pairs.select("pair_id", "a_id", "b_id", *[F.round(f"overlap.{c}", 4).alias(c) for c in ("pct_smaller", "pct_a", "pct_b")], F.col("overlap.ring").alias("corners"), G.centroid(F.col("overlap.ring")).alias("centroid"))
    return shape.join(fitted, "pair_id").select(*shape.columns, "forward", "backward", F.when(F.col("error").isNull(), "corner_homography").otherwise("unavailable").alias("method"))


def build(spark: SparkSession, root: str, min_pct: float = 0.0) -> DataFrame:
    """The manifest of a label tree as one row. Products without a footprint are listed and also reported as skipped."""
    found, skipped = labels.discover(spark, root)
    products = labels.parse(found).persist()  # read by each part of the document; lost blocks are parsed again
    unparsed = found.join(products.select(F.col("label_path").alias("path")), "path", "left_anti").select("path", F.lit("not a usable label").alias("reason"))
    bare = products.where(F.size("footprint") == 0).select(F.col("label_path").alias("path"), F.lit("no footprint").alias("reason"))
    return manifest.manifest(products, overlap_pairs(products, min_pct), skipped.union(unparsed).union(bare))
