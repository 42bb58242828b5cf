"""Footprint catalogs: validation, footprints, dedup, unions with counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.functions import text as X

CORNERS = ("ul", "ur", "br", "bl")


def corner_footprint(row: dict[str, Column]) -> Column:
    """UL, UR, LR, LL from columns like ul_lat; null unless all eight are valid."""
    pairs = [(row[f"{c}_lat"].cast("double"), row[f"{c}_lon"].cast("double")) for c in CORNERS]
    good = reduce(lambda a, b: a & b, [G.valid_lat(la) & G.valid_lon(lo) for la, lo in pairs])
    return F.when(good, F.array(*[F.struct(la.alias("lat"), lo.alias("lon")) for la, lo in pairs]))


def bounds_footprint(box: Column) -> Column:
    """UL, UR, LR, LL of a bounding box; null unless all values are valid."""
    good = G.valid_lat(box["y0"]) & G.valid_lat(box["y1"]) & G.valid_lon(box["x0"]) & G.valid_lon(box["x1"])
    corner = lambda lat, lon: F.struct(box[lat].alias("lat"), box[lon].alias("lon"))
    return F.when(good, F.array(corner("y1", "x0"), corner("y1", "x1"), corner("y0", "x1"), corner("y0", "x0")))


def rows_to_products(catalog: DataFrame, instrument: str) -> DataFrame:
    """Catalog rows as products: rows without an id or a usable footprint go.

    Footprints come from the corner columns, else from ``geometry_bounds`` where there is one.
    Missing columns count as null; names are matched without regard to case.
    """
    if instrument not in ("OHRC", "TMC2", "IIRS"):
        raise ValueError(f"unsupported instrument: {instrument}")
    by_name = {c.lower(): F.col(c) for c in catalog.columns}
    get = lambda name: by_name.get(name, F.lit(None))
    txt = lambda *names: X.first_text(*[get(n).cast("string") for n in names])
    num = lambda n: X.to_double(get(n).cast("string"))
    corners = corner_footprint({f"{c}_{a}": num(f"{c}_{a}") for c in CORNERS for a in ("lat", "lon")})
    bounds = bounds_footprint(by_name["geometry_bounds"]) if "geometry_bounds" in by_name else F.lit(None)
    rows = catalog.select(
        txt("product_id").alias("product_id"), F.lit(instrument).alias("instrument"), F.coalesce(corners, bounds).alias("footprint"),
        txt("obs_st_time", "obs_st_tim").alias("start_time"), txt("obs_ed_time", "obs_ed_tim").alias("stop_time"), txt("download").alias("download_filename"), txt("browse").alias("browse_filename"),
        num("inc_angle").alias("incidence_angle_deg"), num("emi_angle").alias("emission_angle_deg"), num("pha_angle").alias("phase_angle_deg"),
        X.to_long(get("im_orb_num").cast("string")).alias("imaging_orbit_number"), X.to_long(get("dm_orb_num").cast("string")).alias("dumping_orbit_number"),
        get("row_index").cast("long").alias("row_index"),
    )
    return rows.where(F.col("product_id").isNotNull() & F.col("footprint").isNotNull())


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines before the shuffle."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in names]).select(*rows.columns)


def union_catalogs(parts: list[tuple[str, DataFrame]], key: str = "product_id", order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """(unique rows, kept count by file); earlier files win, files that keep nothing report 0."""
    tagged = [df.withColumn("file_ord", F.lit(i)).withColumn("file", F.lit(name)) for i, (name, df) in enumerate(parts)]
    unique = first_wins(reduce(DataFrame.unionByName, tagged), key, "file_ord", order)
    spark = parts[0][1].sparkSession
    files = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(parts)], "file_ord int, file string")
    kept = unique.groupBy("file_ord").agg(F.count("*").alias("kept"))
    return unique, files.join(kept, "file_ord", "left").select("file", F.coalesce("kept", F.lit(0)).alias("kept"))


def in_region(lat: Column, lon: Column, lat_range: tuple[float, float], lon_range: tuple[float, float]) -> Column:
    """Inclusive box test; does not wrap at the antimeridian."""
    return lat.between(*lat_range) & lon.between(*lon_range)


def has_angles(*angles: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(0.0)) != 0 for x in angles])


def counts_by_instrument(products: DataFrame) -> DataFrame:
    return products.agg(*[F.count_if(F.col("instrument") == i).alias(i.lower()) for i in ("OHRC", "TMC2", "IIRS")], F.count_if(~F.col("instrument").isin("OHRC", "TMC2", "IIRS")).alias("other"))


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    return first_wins(rows, key, order).orderBy(order)


def chain_gradient(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean slope of the group means along group (central differences, one-sided at the ends): ``mean_gradient, n``."""
    means = rows.groupBy(group).agg(F.avg(value).alias("m"))
    w = Window.orderBy(group)  # one row for each scan line
    slope = means.select("m", F.lag("m").over(w).alias("p"), F.lead("m").over(w).alias("q"))
    each = F.when(F.col("p").isNull(), F.col("q") - F.col("m")).when(F.col("q").isNull(), F.col("m") - F.col("p")).otherwise((F.col("q") - F.col("p")) / 2)
    return slope.agg(F.avg(each).alias("mean_gradient"), F.count("*").alias("n"))
