"""Planar and spherical geometry as Column expressions.

A ring is ``array<struct<x:double,y:double>>`` without a closing vertex; a footprint is
``array<struct<lat:double,lon:double>>``. Null or short rings give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOON_RADIUS_KM = 1737.4


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring_from_footprint(footprint: Column) -> Column:
    """(lat, lon) corners to an (x=lon, y=lat) ring; fewer than three corners give null."""
    return F.when(F.size(footprint) >= 3, F.transform(footprint, lambda c: point(c["lon"], c["lat"])))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0))


def _shifted(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _cross(ring: Column) -> Column:
    return F.zip_with(ring, _shifted(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def signed_area(ring: Column) -> Column:
    return F.when(F.size(ring) >= 3, _sum(_cross(ring)) / 2)


def area(ring: Column) -> Column:
    """Area of a simple ring in squared units (shoelace); 0 below three vertices, null for null."""
    return F.when(ring.isNotNull(), F.coalesce(F.abs(signed_area(ring)), F.lit(0.0)))


def centroid(ring: Column) -> Column:
    """Area-weighted centroid; the vertex mean where the area vanishes."""
    a6 = _sum(_cross(ring)) * 3
    part = lambda axis: _sum(F.zip_with(ring, _shifted(ring), lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    mean = lambda axis: _sum(F.transform(ring, lambda p: p[axis])) / F.size(ring)
    pick = lambda axis: F.coalesce(F.try_divide(part(axis), a6), mean(axis))
    return F.when(F.size(ring) > 0, point(pick("x"), pick("y")))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def intersect_bounds(a: Column, b: Column) -> Column:
    """May be inverted where the boxes are apart, as the callers test for that."""
    return F.struct(F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))


def bounds_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def is_convex(ring: Column) -> Column:
    """All turns one way and a winding of one: rejects bow ties, since opposite turns show up."""
    nxt = _shifted(ring)
    turns = F.zip_with(F.zip_with(ring, nxt, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), _shifted(nxt), lambda e, r: (e["q"]["x"] - e["p"]["x"]) * (r["y"] - e["q"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (r["x"] - e["q"]["x"]))
    return (F.size(ring) >= 3) & (F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0))


def on_boundary(ring: Column, x: Column, y: Column) -> Column:
    edges = F.zip_with(ring, _shifted(ring), lambda p, q: (
        ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"]))
        & (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"]))
        & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))
    ))
    return F.exists(edges, lambda e: e)


def _odd_crossings(ring: Column, x: Column, y: Column) -> Column:
    crossed = F.zip_with(ring, _shifted(ring), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + F.coalesce(F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"]), F.lit(0.0))))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def contains(ring: Column, x: Column, y: Column, boundary: bool = False) -> Column:
    """Even-odd test; points on the boundary count only if asked for."""
    edge = on_boundary(ring, x, y)
    return (_odd_crossings(ring, x, y) | edge) if boundary else (_odd_crossings(ring, x, y) & ~edge)


def clip(subject: Column, clipper: Column) -> Column:
    """Intersection of two convex rings (Sutherland and Hodgman); empty array where they are apart."""
    ccw = F.when(signed_area(clipper) >= 0, clipper).otherwise(F.reverse(clipper))
    edges = F.zip_with(ccw, _shifted(ccw), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def side(e: Column, v: Column) -> Column:
        return (e["q"]["x"] - e["p"]["x"]) * (v["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (v["x"] - e["p"]["x"])

    def cut(ring: Column, e: Column) -> Column:
        def step(pair: Column) -> Column:
            u, v = pair["u"], pair["v"]
            su, sv = side(e, u), side(e, v)
            t = F.try_divide(su, su - sv)
            crossing = point(u["x"] + t * (v["x"] - u["x"]), u["y"] + t * (v["y"] - u["y"]))
            none = F.slice(F.array(v), 1, 0)
            return F.concat(F.when((su < 0) != (sv < 0), F.array(crossing)).otherwise(none), F.when(sv >= 0, F.array(v)).otherwise(none))

        pairs = F.zip_with(F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))), ring, lambda u, v: F.struct(u.alias("u"), v.alias("v")))
        empty = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(F.size(ring) == 0, empty).otherwise(F.flatten(F.transform(pairs, step)).cast("array<struct<x:double,y:double>>"))

    return F.aggregate(edges, subject.cast("array<struct<x:double,y:double>>"), cut)


def overlap(ring_a: Column, ring_b: Column) -> Column:
    """Struct ``ring, inter, pct_a, pct_b, pct_smaller`` of two convex rings; null without common area."""
    ring = clip(ring_a, ring_b)
    found = F.get(F.transform(F.array(ring), lambda r: F.struct(r.alias("ring"), area(r).alias("inter"), area(ring_a).alias("aa"), area(ring_b).alias("ab"))), 0)
    return F.get(
        F.transform(
            F.array(found),
            lambda f: F.when((f["inter"] > 0) & (f["aa"] > 0) & (f["ab"] > 0), F.struct(
                f["ring"].alias("ring"), f["inter"].alias("inter"),
                F.try_divide(100 * f["inter"], f["aa"]).alias("pct_a"), F.try_divide(100 * f["inter"], f["ab"]).alias("pct_b"),
                F.try_divide(100 * f["inter"], F.least(f["aa"], f["ab"])).alias("pct_smaller"),
            )),
        ),
        0,
    )


def box_overlap(a: Column, b: Column) -> Column:
    """Common area of two boxes (structs of bounds)."""
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def valid_lat(lat: Column) -> Column:
    return F.coalesce(lat.between(-90.0, 90.0) & ~F.isnan(lat), F.lit(False))


def valid_lon(lon: Column) -> Column:
    return F.coalesce(lon.between(-180.0, 180.0) & ~F.isnan(lon), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MOON_RADIUS_KM) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def quad_extents(footprint: Column) -> Column:
    """Great-circle width (upper edge), length (left edge) and diagonal in km of UL, UR, LR, LL corners."""
    def span(i: int, j: int) -> Column:
        return haversine_km(footprint[i]["lat"], footprint[i]["lon"], footprint[j]["lat"], footprint[j]["lon"])

    return F.struct(span(0, 1).alias("width_km"), span(0, 3).alias("length_km"), span(0, 2).alias("diagonal_km"))


def south_polar_forward(lat: Column, lon: Column, lon0: float = 0.0, k0: float = 1.0, radius_m: float = MOON_RADIUS_KM * 1000) -> Column:
    rho = 2 * radius_m * k0 * F.tan(F.radians(lat + 90) / 2)
    return point(rho * F.sin(F.radians(lon - lon0)), rho * F.cos(F.radians(lon - lon0)))


def south_polar_inverse(xy: Column, lon0: float = 0.0, k0: float = 1.0, radius_m: float = MOON_RADIUS_KM * 1000) -> Column:
    lat = F.degrees(2 * F.atan(F.hypot(xy["x"], xy["y"]) / (2 * radius_m * k0))) - 90
    return F.struct(lat.alias("lat"), (F.degrees(F.atan2(xy["x"], xy["y"])) + lon0).alias("lon"))


def scale_at_standard_parallel(lat_ts: float) -> float:
    """k0 of a polar stereographic projection that is true at lat_ts degrees."""
    import math

    return (1 + math.sin(math.radians(abs(lat_ts)))) / 2


def _crossing(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Where segments p-q and r-s cross strictly inside both, else null."""
    side = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def meet(d: Column) -> Column:
        t = F.try_divide(d["c"], d["c"] - d["d"])
        return F.when((d["a"] * d["b"] < 0) & (d["c"] * d["d"] < 0), point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"])))

    return F.get(F.transform(F.array(F.struct(side(p, q, r).alias("a"), side(p, q, s).alias("b"), side(r, s, p).alias("c"), side(r, s, q).alias("d"))), meet), 0)


def _once(value: Column, then) -> Column:  # noqa: ANN001
    """``then`` applied to a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), 0)


def repaired(ring: Column) -> Column:
    """The ring, or of a bow tie of four corners the triangle with the highest corner; null without area.

    That is the part whose orientation counts as the ring's own. Rings of more corners come back as they are.
    """
    def fix(r: Column) -> Column:
        v = [F.get(r, F.lit(k)) for k in range(4)]

        def lobe(at: Column, a: list[Column], b: list[Column]) -> Column:
            top = lambda corners: F.greatest(*[c["y"] for c in corners])
            return F.when(top(a) >= top(b), F.array(at, *a)).otherwise(F.array(at, *b))

        def pick(c: Column) -> Column:
            one, two = c["one"], c["two"]
            return F.when((F.size(r) != 4) | (one.isNull() & two.isNull()), r).when(one.isNotNull(), lobe(one, [v[1], v[2]], [v[3], v[0]])).otherwise(lobe(two, [v[2], v[3]], [v[0], v[1]]))

        return _once(F.struct(_crossing(v[0], v[1], v[2], v[3]).alias("one"), _crossing(v[1], v[2], v[3], v[0]).alias("two")), pick)

    return _once(_once(ring, fix), lambda f: F.when(area(f) > 0, f))


def unwrapped(longitudes: Column) -> Column:
    """Longitudes without a jump at the antimeridian: where neighbours differ by 180 or more, those below 180 go up by 360."""
    jump = F.exists(F.zip_with(F.slice(longitudes, 2, F.size(longitudes)), F.slice(longitudes, 1, F.size(longitudes) - 1), lambda b, a: F.abs(b - a) >= 180), lambda x: x)
    return F.when(jump, F.transform(longitudes, lambda x: F.when(x < 180, x + 360).otherwise(x))).otherwise(longitudes)


def inside_raster(corners: Column, width: Column, height: Column) -> Column:
    """Whether all corners (x: column, y: row) are on the raster, its edges included."""
    return F.forall(corners, lambda c: c["x"].between(F.lit(0), width) & c["y"].between(F.lit(0), height))
