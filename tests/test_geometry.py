import pytest
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.operators import catalog, spatial


def square(lat0, lat1, lon0, lon1):
    return [(float(lat1), float(lon0)), (float(lat1), float(lon1)), (float(lat0), float(lon1)), (float(lat0), float(lon0))]


FOOT = "array<struct<lat:double,lon:double>>"


def products(spark, rows, side):
    return spark.createDataFrame(rows, f"{side}_id string, foot {FOOT}").select(f"{side}_id", G.ring_from_footprint(F.col("foot")).alias(f"{side}_ring"))


def test_area_and_missing_footprint(spark):
    df = spark.createDataFrame([(square(-85, -84, 23, 24),), ([],)], f"foot {FOOT}").select(G.ring_from_footprint(F.col("foot")).alias("r"))
    got = [r[0] for r in df.select(G.area(F.col("r"))).collect()]
    assert got == [1.0, None]


@pytest.mark.parametrize(("a", "b", "pct"), [((0, 2, 0, 2), (1, 3, 1, 3), 25.0), ((-5, -4, 141, 142), (-30, 0, 140, 143), 100.0), ((0, 1, 0, 1), (50, 51, 50, 51), None)])
def test_overlap(spark, a, b, pct):
    df = spark.createDataFrame([(square(*a), square(*b))], f"a {FOOT}, b {FOOT}")
    o = G.overlap(G.ring_from_footprint(F.col("a")), G.ring_from_footprint(F.col("b")))
    got = df.select(o.alias("o")).first().o
    assert (got is None) if pct is None else (got.pct_smaller == pytest.approx(pct) and (pct == 100 or got.pct_a == pytest.approx(got.pct_b)))


def test_overlap_join_threshold_and_missing(spark):
    a = products(spark, [("a", square(0, 2, 0, 2)), ("none", [])], "a")
    b = products(spark, [("b", square(1.99, 3.99, 1.99, 3.99))], "b")
    assert spatial.overlap_join(a, b, cell=1.0).count() == 1
    assert spatial.overlap_join(a, b, cell=1.0, min_pct=5.0).count() == 0


def test_join_order(spark):
    a = products(spark, [("scene", square(-5, -4, 141, 142))], "a")
    b = products(spark, [("far", square(50, 51, 0, 1)), ("partial", square(-6, 6, 140.5, 141.5)), ("covering", square(-30, 0, 140, 143))], "b")
    got = spatial.overlap_join(a, b).orderBy(F.desc("overlap.pct_smaller")).select("b_id").collect()
    assert [r[0] for r in got] == ["covering", "partial"]


def test_points_strictly_inside(spark):
    poly = spark.createDataFrame([(1, 24.0, -14.0, 26.0, -12.0), (2, 0.0, 44.0, 1.0, 46.0), (3, 100.0, 0.0, 101.0, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double").select("id", G.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))
    pts = spark.createDataFrame([(25.0, -13.0), (25.2, -13.2), (25.4, -13.4), (25.1, -13.6), (0.5, 0.0), (0.5, 45.0), (24.0, -13.0), (None, 1.0)], "x double, y double")
    assert {r.id: r.n_points for r in spatial.count_points(poly, pts, "id").collect()} == {1: 4, 2: 1, 3: 0}


def test_clip_of_sheared_quads_and_convexity(spark):
    def ring(p):
        return [{"x": float(x), "y": float(y)} for x, y in p]

    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(2, -2), (6, 2), (2, 6), (-2, 2)]), ring([(0, 0), (1, 1), (1, 0), (0, 1)]))], f"a {kind}, b {kind}, bow {kind}")
    got = df.select(G.area(G.clip(F.col("a"), F.col("b"))), G.is_convex(F.col("a")), G.is_convex(F.col("bow"))).first()
    assert got[0] == pytest.approx(16.0) and got[1] and not got[2]


def test_great_circle_and_polar_round_trip(spark):
    xy = G.south_polar_forward(F.lit(-84.5), F.lit(23.25))
    back = G.south_polar_inverse(xy)
    got = spark.range(1).select(G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("q"), back["lat"].alias("lat"), back["lon"].alias("lon")).first()
    assert got.q == pytest.approx(1737.4 * 3.141592653589793 / 2) and got.lat == pytest.approx(-84.5) and got.lon == pytest.approx(23.25)


def test_nearest_with_far_probe(spark):
    grid = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "grid_id long, gx double, gy double")
    probes = spark.createDataFrame([(1, 2.4, 0.2), (2, 500.0, 0.0), (3, 2.5, 0.0)], "p long, px double, py double")
    assert {r.p: r.grid_id for r in spatial.nearest(probes, grid, "p", 1.0).collect()} == {1: 2, 2: 9, 3: 2}


def catalog_row(pid, lat0, lat1, lon0, lon1, idx, bounds=None, orbit="1000"):
    f = lambda v: None if v is None else str(v)
    return (pid, f(lat1), f(lon0), f(lat1), f(lon1), f(lat0), f(lon0), f(lat0), f(lon1), orbit, idx, bounds)


CATALOG = "PRODUCT_ID string, UL_LAT string, UL_LON string, UR_LAT string, UR_LON string, BL_LAT string, BL_LON string, BR_LAT string, BR_LON string, IM_ORB_NUM string, row_index long, geometry_bounds struct<x0:double,y0:double,x1:double,y1:double>"


def test_catalog_rows(spark):
    rows = [
        catalog_row("good", -20, -18, 30, 32, 0), catalog_row("bad", -20, 733744.6, 30, 32, 1), catalog_row(None, -20, -18, 30, 32, 2), catalog_row("dup", 14, 16, -70, -68, 3), catalog_row("dup", 1, 2, 3, 4, 4),
        catalog_row("box", None, None, None, None, 5, (140.0, -33.0, 142.0, -31.0)),
    ]
    got = catalog.first_wins(catalog.rows_to_products(spark.createDataFrame(rows, CATALOG), "OHRC"), "product_id", "row_index").orderBy("row_index").collect()
    assert [r.product_id for r in got] == ["good", "dup", "box"]
    assert [tuple(c) for c in got[0].footprint] == [(-18, 30), (-18, 32), (-20, 32), (-20, 30)] and got[0].imaging_orbit_number == 1000
    assert tuple(got[1].footprint[0]) == (16, -70) and tuple(got[2].footprint[0]) == (-31, 140)
    with pytest.raises(ValueError, match="unsupported"):
        catalog.rows_to_products(spark.createDataFrame(rows, CATALOG), "XYZ")


def test_union_reports_empty_files(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "product_id string, row_index long")
    b = spark.createDataFrame([("x", 0)], "product_id string, row_index long")
    unique, kept = catalog.union_catalogs([("a", a), ("b", b)])
    assert unique.count() == 2 and {r.file: r.kept for r in kept.collect()} == {"a": 2, "b": 0}
