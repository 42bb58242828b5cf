"""Angles, times and illumination as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest difference, 0 to 180 degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360))
    return F.least(d, 360 - d)


def fold_angle(a: Column) -> Column:
    """Into (-180, 180]."""
    d = F.pmod(a, F.lit(360))
    return F.when(d > 180, d - 360).otherwise(d)


def signed_error(d: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(d + 180, F.lit(360)) - 180


def circular_seconds(a: Column, b: Column) -> Column:
    """Difference of times of day, given as fractions of a day, in seconds."""
    d = F.abs(F.pmod(a, F.lit(1.0)) - F.pmod(b, F.lit(1.0)))
    return F.least(d, 1 - d) * 86400


def micros(ts: Column) -> Column:
    """Microseconds since 1970 by the clock a timestamp shows."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def day_fraction(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(86_400_000_000)) / 86_400_000_000


def days_between(a: Column, b: Column) -> Column:
    """Absolute difference of two ISO-8601 texts in days, two digits; null where either does not parse."""
    return F.round(F.abs(F.unix_micros(F.try_to_timestamp(a)) - F.unix_micros(F.try_to_timestamp(b))) / 86_400_000_000, 2)


def julian_date(ts: Column) -> Column:
    return micros(ts) / 86_400_000_000 + 2440587.5


def sun_elevation(lat: Column, lon: Column, sub_lat: Column, sub_lon: Column) -> Column:
    """Elevation of the Sun above the horizon at a place, from the subsolar point."""
    s = F.sin(F.radians(lat)) * F.sin(F.radians(sub_lat)) + F.cos(F.radians(lat)) * F.cos(F.radians(sub_lat)) * F.cos(F.radians(lon - sub_lon))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def elevation_band(elevation: Column) -> Column:
    return F.when(elevation > 75, "TOO-HIGH").when(elevation > 20, "HIGH-SUN").otherwise("LOW-SUN")


def orbital_speed(mu: float, radius_m: Column) -> Column:
    return F.sqrt(mu / radius_m)


SYNODIC_DAYS = 29.530588853


def subsolar_longitude(jd: Column, ref_jd: Column, ref_lon: Column) -> Column:
    """East longitude under the Sun, 0 to 360, from a calibrated instant; it advances once around in a synodic month."""
    return F.pmod(ref_lon + (jd - ref_jd) * (360.0 / SYNODIC_DAYS), F.lit(360.0))


def mirror_verdict(*same: Column) -> Column:
    """NONE if all comparisons of orientation agree, else MIRRORED."""
    agreed = F.lit(True)
    for s in same:
        agreed = agreed & F.coalesce(s, F.lit(False))
    return F.when(agreed, "NONE").otherwise("MIRRORED")


def mirror_prediction(limb_a: Column, limb_b: Column) -> Column:
    """The same from two orbit limb directions, whatever their case and blanks."""
    return mirror_verdict(F.lower(F.trim(limb_a)) == F.lower(F.trim(limb_b)))
