"""Geolocation grids (longitude, latitude, pixel, scan) and fits on windows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.functions import transforms as T


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """``path, lon, lat, pixel, scan`` by position, whatever the header says; rows with fewer than four numbers go."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", ",").alias("c"))
    number = lambda i: F.get("c", F.lit(i))
    cols = [F.trim(number(i)).try_cast("double").alias(n) for i, n in enumerate(("lon", "lat", "pixel", "scan"))]
    return raw.select("path", *cols).where("lon IS NOT NULL AND lat IS NOT NULL AND pixel IS NOT NULL AND scan IS NOT NULL")


def locate(grid: DataFrame, ring: Column, boundary: bool = False) -> DataFrame:
    """One row ``scan0, scan1, pixel0, pixel1, n`` of the grid points in a ring, truncated; an error where there are none."""
    inside = grid.where(G.contains(ring, F.col("lon"), F.col("lat"), boundary))
    none = F.raise_error(F.lit("no grid point in the region")).cast("long")
    ends = [(F.min("scan"), "scan0"), (F.max("scan"), "scan1"), (F.min("pixel"), "pixel0"), (F.max("pixel"), "pixel1")]
    return inside.agg(*[F.when(F.count("*") == 0, none).otherwise(f.cast("long")).alias(n) for f, n in ends], F.count("*").alias("n"))


def in_window(scan0: float, scan1: float, pixel0: float, pixel1: float) -> Column:
    return F.col("scan").between(scan0, scan1) & F.col("pixel").between(pixel0, pixel1)


def fit_windows(grid: DataFrame, key: str = "path", min_points: int = 50) -> DataFrame:
    """``key, n, to_lonlat, to_pixel, error``: homographies from pixel, scan to lon, lat and back for each window.

    Windows below ``min_points`` points get nulls and an error text. grid is filtered to windows beforehand,
    so a group is one window, not a whole product.
    """
    import pandas as pd

    kind = dict(grid.dtypes)[key]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            if len(pdf) < min_points:
                raise ValueError(f"{len(pdf)} points; {min_points} are needed")
            px, ll = pdf[["pixel", "scan"]].to_numpy(), pdf[["lon", "lat"]].to_numpy()
            row = (T.solve_homography(px, ll).ravel().tolist(), T.solve_homography(ll, px).ravel().tolist(), None)
        except ValueError as e:
            row = (None, None, str(e))
        return pd.DataFrame([(pdf[key].iloc[0], len(pdf), *row)], columns=[key, "n", "to_lonlat", "to_pixel", "error"])

    return grid.groupBy(key).applyInPandas(fit, f"{key} {kind}, n long, to_lonlat array<double>, to_pixel array<double>, error string")
