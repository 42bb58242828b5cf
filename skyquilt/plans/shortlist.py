"""Catalogs, craters and labels to a ranked shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.functions import text as X
from skyquilt.operators import ranking, spatial


def score(a: DataFrame, b: DataFrame, craters: DataFrame, angles: DataFrame, min_overlap: float = 90.0, min_craters: int = 5, min_elevation: float = 20.0, enforce_azimuth: bool = False) -> DataFrame:
    """Scored pairs of two product tables (``product_id, footprint``); craters: ``longitude_deg, latitude_deg``; angles: ``product_id, elev, azim``."""
    side = lambda p, s: p.select(F.col("product_id").alias(f"{s}_id"), G.ring_from_footprint(F.col("footprint")).alias(f"{s}_ring")).where(G.is_convex(F.col(f"{s}_ring")))
    pairs = spatial.overlap_join(side(a, "a"), side(b, "b")).select("a_id", "b_id", F.col("overlap.ring").alias("ring"), F.col("overlap.pct_smaller").alias("pct_smaller")).withColumn("pair_id", X.pair_id(F.col("a_id"), F.col("b_id")))
    counted = spatial.count_points(pairs, craters.select(F.col("longitude_deg").alias("x"), F.col("latitude_deg").alias("y")), "pair_id")
    lit = ranking.with_angles(counted, angles, "a_id", "b_id")
    return ranking.score_candidates(lit, min_overlap=min_overlap, min_craters=min_craters, min_elevation=min_elevation, enforce_azimuth=enforce_azimuth)


def shortlist(scored: DataFrame, top: int = 10) -> DataFrame:
    """Passing pairs first, then those with known sun angles, then by density; all pairs where none passes."""
    return ranking.shortlist(scored, "passes", top, ~F.col("sun_available"), F.desc("density"), "a_id", "b_id")
