"""Candidate ranking: reason arrays, illumination checks, shortlists with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.functions import text as X
from skyquilt.functions.angles import angle_diff

MAX_ELEVATION_DIFF = 30.0
MAX_AZIMUTH_DIFF = 30.0


def reasons(*parts: tuple[Column, Column]) -> Column:
    """Texts of the conditions that hold, in order; null conditions do not hold."""
    return F.filter(F.array(*[F.when(cond, text) for cond, text in parts]), lambda x: x.isNotNull())


def number(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def candidate_reasons(overlap_pct: Column, craters: Column, elev_a: Column, azim_a: Column, elev_b: Column, azim_b: Column, min_overlap: float = 90.0, min_craters: int = 5, min_elevation: float = 20.0, enforce_azimuth: bool = False) -> Column:
    """Why a candidate fails; empty when it passes. Elevations fail strictly below the minimum.

    The azimuth difference is not tested unless ``enforce_azimuth``.
    """
    known = elev_a.isNotNull() & azim_a.isNotNull() & elev_b.isNotNull() & azim_b.isNotNull()
    diff = F.abs(elev_a - elev_b)
    parts = [
        (overlap_pct < min_overlap, F.concat(F.lit("overlap "), number(overlap_pct), F.lit(f"% < {min_overlap}%"))),
        (craters < min_craters, F.concat(F.lit("only "), craters.cast("string"), F.lit(f" craters in footprint (< {min_craters})"))),
        (known & (elev_a < min_elevation), F.concat(F.lit("OHRC sun elevation "), number(elev_a), F.lit(f" < {min_elevation}"))),
        (known & (elev_b < min_elevation), F.concat(F.lit("TMC2 sun elevation "), number(elev_b), F.lit(f" < {min_elevation}"))),
        (known & (diff > MAX_ELEVATION_DIFF), F.concat(F.lit("sun elevation diff "), number(diff), F.lit(" deg"))),
        (~known, F.lit("sun angles unavailable - labels not downloaded")),
    ]
    if enforce_azimuth:
        az = angle_diff(azim_a, azim_b)
        parts.insert(5, (known & (az > MAX_AZIMUTH_DIFF), F.concat(F.lit("sun azimuth diff "), number(az), F.lit(" deg"))))
    return reasons(*parts)


def match_reasons(id_a: Column, elev_a: Column, azim_a: Column, id_b: Column, elev_b: Column, azim_b: Column, min_elevation: float = 20.0, max_azimuth: float = MAX_AZIMUTH_DIFF, strict_boundary: bool = True) -> Column:
    """Why two products are not lit alike; empty when they are. An elevation of exactly the minimum fails (unless ``strict_boundary`` is off)."""
    ok_a, ok_b = elev_a.isNotNull() & azim_a.isNotNull(), elev_b.isNotNull() & azim_b.isNotNull()
    known, az = ok_a & ok_b, angle_diff(azim_a, azim_b)
    low = (lambda e: e <= min_elevation) if strict_boundary else (lambda e: e < min_elevation)
    return reasons(
        (~known, F.concat(F.lit("label needed: "), F.when(~ok_a, id_a).otherwise(id_b), F.lit(" (sun angles not all present)"))),
        (known & low(elev_a), F.concat(F.lit("OHRC elevation "), number(elev_a), F.lit(f" < {min_elevation}"))),
        (known & low(elev_b), F.concat(F.lit("TMC-2 elevation "), number(elev_b), F.lit(f" < {min_elevation}"))),
        (known & (az > max_azimuth), F.concat(F.lit("azimuth diff "), number(az), F.lit(f" > {max_azimuth}"))),
    )


def with_angles(pairs: DataFrame, angles: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """pairs with ``elev_a, azim_a, elev_b, azim_b, labels_needed`` from angles (``product_id, elev, azim``); missing ones stay null."""
    side = lambda s, key: angles.select(F.col("product_id").alias(key), F.col("elev").alias(f"elev_{s}"), F.col("azim").alias(f"azim_{s}"))
    out = pairs.join(side("a", id_a), id_a, "left").join(side("b", id_b), id_b, "left")
    need = lambda s, key: (F.col(f"elev_{s}").isNull() | F.col(f"azim_{s}").isNull(), F.col(key).cast("string"))
    return out.withColumn("labels_needed", reasons(need("a", id_a), need("b", id_b)))


def density(count: Column, area: Column) -> Column:
    return F.when(area > 0, count / area).otherwise(F.lit(0.0))


def rank_overlaps(pairs: DataFrame, max_abs_lat: float, *ties: str) -> DataFrame:
    """pairs (``cy, pct, nadir``) with 1-based ``rank``: away from the poles first, then larger overlap, then nadir views."""
    return ranked(pairs, F.abs("cy") > max_abs_lat, F.desc("pct"), ~F.col("nadir"), *ties)


def ranked(rows: DataFrame, *order: Column | str, top: int | None = None) -> DataFrame:
    """rows in order with ``rank``. With ``top`` only that many leave each task; the window sees them alone."""
    if top is not None:
        rows = rows.orderBy(*order).limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def shortlist(rows: DataFrame, passes: str, top: int, *order: Column | str) -> DataFrame:
    """The first ``top`` rows that pass, or of all rows where none passes."""
    any_pass = rows.agg(F.coalesce(F.bool_or(passes), F.lit(False)).alias("any_pass"))
    kept = rows.crossJoin(F.broadcast(any_pass)).where(F.col(passes) | ~F.col("any_pass")).drop("any_pass")  # one row
    return ranked(kept, *order, top=top)


def score_candidates(pairs: DataFrame, **limits: float) -> DataFrame:
    """pairs (``ring, pct_smaller, n_points`` and angles) with centroid, density, differences, reasons and pass flag."""
    a = [F.col(c) for c in ("elev_a", "azim_a", "elev_b", "azim_b")]
    out = pairs.withColumn("centroid", G.centroid(F.col("ring"))).withColumn("density", density(F.col("n_points"), G.area(F.col("ring"))))
    out = out.withColumn("elev_diff", F.abs(a[0] - a[2])).withColumn("azim_diff", angle_diff(a[1], a[3])).withColumn("reasons", candidate_reasons(F.col("pct_smaller"), F.col("n_points"), *a, **limits))
    return out.withColumn("sun_available", F.col("azim_diff").isNotNull() & F.col("elev_diff").isNotNull()).withColumn("passes", F.size("reasons") == 0)


def diagnostics(scored: DataFrame, id_a: str, id_b: str) -> DataFrame:
    note = F.when(F.size("reasons") == 0, "passes all filters").otherwise(F.array_join("reasons", "; "))
    return scored.select(X.pair_id(F.col(id_a), F.col(id_b)).alias("pair_id"), note.alias("note"))


#: Pairs that a list of near-simultaneous ones shows.
LISTED = 40


def same_pass(rows: DataFrame, seconds: str = "dt_sec") -> DataFrame:
    """Pairs taken within an hour."""
    return rows.where(F.col(seconds) < 3600)


def near_pass(rows: DataFrame, *ties: str, seconds: str = "dt_sec", craters: str = "craters", top: int = LISTED) -> DataFrame:
    """Pairs taken within six hours with three craters or more, most craters first, then by ``ties``: the first ``top``."""
    return rows.where((F.col(seconds) < 21600) & (F.col(craters) >= 3)).orderBy(F.desc(craters), *ties).limit(top)


def containment_verdict(inside: Column, fraction: Column, strip_fraction: Column, width_ratio: Column, length_ratio: Column) -> Column:
    """VERIFIED if a product lies on the other's raster, 95 % of it in either footprint, and its sides agree within 5 %."""
    good = inside & (fraction >= 0.95) & (strip_fraction >= 0.95) & width_ratio.between(0.95, 1.05) & length_ratio.between(0.95, 1.05)
    return F.when(F.coalesce(good, F.lit(False)), "VERIFIED").otherwise("UNVERIFIED")


def strip_verdict(length_ratio: Column, width_ratio: Column, fraction_a: Column, fraction_b: Column) -> Column:
    """Struct ``reasons, verdict``: sides within 10 % of the strip's, and common ground with both others; only a's decides the verdict."""
    fits = F.coalesce(length_ratio.between(0.9, 1.1) & width_ratio.between(0.9, 1.1), F.lit(False))
    texts = F.array(
        F.when(~fits, "corner-quad extent inconsistent with strip dimensions"), F.when(fraction_a <= 0, "no intersection with TMC raster"), F.when(fraction_b <= 0, "corner quad does not intersect the OHRC footprint")
    )
    return F.struct(F.array_compact(texts).alias("reasons"), F.when(fits & (fraction_a > 0), "VERIFIED").otherwise("UNVERIFIED").alias("verdict"))
