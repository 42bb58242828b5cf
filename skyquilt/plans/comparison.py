"""Feature graphs of two images to matches, a robust transform and a scored report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions import transforms as T
from skyquilt.operators import graph, registration, scoring


def match_graphs(a: DataFrame, b: DataFrame, k: int = 4, min_radius: float = 0.0, **limits: object) -> DataFrame:
    """Matched points ``g, a_id, b_id, ax, ay, bx, by`` of two node tables (``g, id, x, y, radius``)."""
    big = [n.where(F.col("radius") >= min_radius) for n in (a, b)]
    hoods = [graph.neighborhoods(n, graph.knn_edges(n, k, digits=10), k, digits=10) for n in big]
    return graph.match_points(graph.mutual_matches(*hoods, **limits), *big)


def report(points: DataFrame, truth: list[float], tolerance: float = 75.0, limit: float = 15.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(robust transform, scores of all matches, error bands) against a known homography."""
    fitted = registration.ransac_pairs(points, "g", limit)
    want = T.apply_homography(F.array(*map(F.lit, map(float, truth))), F.col("ax"), F.col("ay"))
    rows = points.withColumn("w", want).select("g", F.col("w.x").alias("expected_x"), F.col("w.y").alias("expected_y"), F.col("bx").alias("predicted_x"), F.col("by").alias("predicted_y"))
    return fitted, scoring.score(rows, tolerance, "g"), scoring.error_bands(scoring.with_errors(rows))
