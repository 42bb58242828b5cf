"""Crater catalogs in CSV and Parquet, and synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions import text as X
from skyquilt.functions import transforms as T

#: Accepted header names after normalisation, first match wins.
ALIASES = {
    "latitude_deg": ("latitude", "lat", "lat_deg", "latitude_deg", "lat_circ_img", "y"),
    "longitude_deg": ("longitude", "lon", "long", "lon_deg", "longitude_deg", "lon_circ_img", "x"),
    "diameter_km": ("diameter_km", "diameter", "diam_km", "diam", "diam_circ_img", "d_km"),
    "depth_km": ("depth_km", "depth", "d_depth"),
    "name": ("name", "crater_name", "crater_id", "id", "feature_name"),
}
REQUIRED = ("latitude_deg", "longitude_deg", "diameter_km")


def resolve(columns: list[str], strict: bool = False) -> dict[str, str]:
    """Which column plays which part; ValueError where a required one is missing. ``strict`` also takes gazetteer headers (center_latitude ...)."""
    found = {}
    for part, names in ALIASES.items():
        wanted = (*names, f"center_{names[0]}") if strict else names
        by = {X.header_text(c): c for c in reversed(columns)}
        if match := next((by[n] for n in wanted if n in by), None):
            found[part] = match
    if missing := [p for p in REQUIRED if p not in found]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return found


def tidy(df: DataFrame, min_km: float | None, max_km: float | None, strict: bool = False) -> DataFrame:
    part = resolve(df.columns, strict)
    num = lambda p: X.to_double(F.col(f"`{part[p]}`").cast("string")) if p in part else F.lit(None).cast("double")
    name = F.col(f"`{part['name']}`").cast("string") if "name" in part else F.lit(None).cast("string")
    rows = df.select(*[num(p).alias(p) for p in ("latitude_deg", "longitude_deg", "diameter_km", "depth_km")], name.alias("name"), *[c for c in ("row_id",) if c in df.columns])
    rows = rows.where("latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL AND diameter_km IS NOT NULL")
    if min_km is not None:
        rows = rows.where(F.col("diameter_km") >= min_km)
    return rows if max_km is None else rows.where(F.col("diameter_km") <= max_km)


def read_csv(spark: SparkSession, path: str, min_km: float | None = None, max_km: float | None = None, strict: bool = False) -> DataFrame:
    """Rows with coordinates and a diameter within the inclusive limits."""
    return tidy(spark.read.option("header", "true").csv(path), min_km, max_km, strict)


def read_parquet(spark: SparkSession, path: str, min_km: float | None = None, max_km: float | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    col = resolve(df.columns)["diameter_km"]
    if dict(df.dtypes)[col] in ("double", "float", "int", "bigint"):  # on the stored column, so that it reaches the scan
        for limit, keep in ((min_km, lambda v: F.col(col) >= v), (max_km, lambda v: F.col(col) <= v)):
            df = df if limit is None else df.where(keep(limit))
    return tidy(df, min_km, max_km)


def synthetic(spark: SparkSession, n: int, lat: tuple[float, float], lon: tuple[float, float], min_km: float = 1.0, max_km: float = 100.0, exponent: float = 1.8, seed: int = 42) -> DataFrame:
    """n craters whose cumulative number falls as a power of the diameter, clipped, largest first by row_id."""
    u = 1 - F.rand(seed)
    d = F.least(F.lit(max_km), F.lit(min_km) * F.pow(u, F.lit(-1 / exponent)))
    rows = spark.range(n).select((lat[0] + F.rand(seed + 1) * (lat[1] - lat[0])).alias("latitude_deg"), (lon[0] + F.rand(seed + 2) * (lon[1] - lon[0])).alias("longitude_deg"), d.alias("diameter_km"))
    return rows.orderBy(F.desc("diameter_km"))


def to_pixels(craters: DataFrame, to_pixel: list[float], metres_per_px: float, lines: int, samples: int, row0: int = 0, col0: int = 0) -> DataFrame:
    """``x, y, radius_px`` of craters whose centre falls on the image (or crop, from row0 and col0)."""
    p = T.apply_homography(F.array(*map(F.lit, map(float, to_pixel))), F.col("longitude_deg"), F.col("latitude_deg"))
    out = craters.withColumn("p", p).select(*craters.columns, (F.col("p.x") - col0).alias("x"), (F.col("p.y") - row0).alias("y"), T.crater_radius_px(F.col("diameter_km"), F.lit(metres_per_px)).alias("radius_px"))
    return out.where(F.col("x").between(0, samples - 1) & F.col("y").between(0, lines - 1))


def on_crop(craters: DataFrame, local: str, corner: str, metres_per_px: float, row0: int, col0: int) -> DataFrame:
    """craters with ``x, y, radius_px, is_local``: in pixels of a crop by the crop's own matrix, or of the whole image by the corners' where there is none.

    ``local`` and ``corner`` name matrix columns from longitude and latitude to column and row. Craters off the image stay.
    """
    own = T.apply_homography(F.col(local), F.col("longitude_deg"), F.col("latitude_deg"))
    whole = T.apply_homography(F.col(corner), F.col("longitude_deg"), F.col("latitude_deg"))
    there = F.col(local).isNotNull()
    return craters.select(
        *craters.columns, F.when(there, own["x"] - col0).otherwise(whole["x"]).alias("x"), F.when(there, own["y"] - row0).otherwise(whole["y"]).alias("y"),
        T.crater_radius_px(F.col("diameter_km"), F.lit(metres_per_px)).alias("radius_px"), there.alias("is_local"),
    )
