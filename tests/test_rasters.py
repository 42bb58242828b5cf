import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.functions import transforms as T
from skyquilt.operators import detection as D
from skyquilt.operators import raster as R
from skyquilt.operators import registration as G
from skyquilt.plans import comparison


def test_windowed_read_and_block_means(spark, tmp_path):
    image = np.arange(60 * 40, dtype=">u2").reshape(60, 40)
    path = tmp_path / "i.img"
    path.write_bytes(image.tobytes())
    tiles = R.read_raster(spark, path=path, product_id="p", lines=60, samples=40, dtype="UnsignedMSB2", row0=10, row1=50, col0=5, col1=25, lines_per_tile=16)
    assert tiles.rdd.getNumPartitions() == 3
    px = R.pixels(tiles)
    got = px.toPandas().pivot(index="y", columns="x", values="value").to_numpy()
    assert (got == image[10:50, 5:25]).all()
    means = R.block_means(px.withColumn("y", F.col("y") - 10).withColumn("x", F.col("x") - 5), 4).toPandas().pivot(index="y", columns="x", values="value").to_numpy()
    assert np.allclose(means, image[10:50, 5:25].astype(float).reshape(10, 4, 5, 4).mean((1, 3)))
    lim = R.stretch_limits(px).first()
    assert (lim.lo, lim.hi) == pytest.approx(tuple(np.percentile(image[10:50, 5:25], (0.5, 99.5))))
    with pytest.raises(Exception, match="shorter"):
        R.read_raster(spark, path=path, lines=100, samples=40, dtype="UnsignedMSB2").count()
    with pytest.raises(ValueError, match="unknown pixel type"):
        R.numpy_type("Odd")


def test_shrink_keeps_the_mean_and_never_enlarges():
    a = np.random.default_rng(0).random((51, 101))
    small = R.shrink(a, (5, 10))
    assert small.shape == (5, 10) and small.mean() == pytest.approx(a.mean()) and R.shrink(a, (100, 200)).shape == a.shape


def test_homographies(spark):
    quad = [0.0, 0.0, 10.0, 0.0, 10.0, -10.0, 0.0, -10.0]
    rows = [("same", quad, quad), ("flat", [0.0] * 8, quad), ("short", [0.0, 0.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "pair_id string, a_foot array<double>, b_foot array<double>").selectExpr("*", "100 as a_lines", "100 as a_samples", "200 as b_lines", "200 as b_samples")
    got = {r.pair_id: r for r in T.corner_transform(df).collect()}
    assert np.allclose(T.project(np.array(got["same"].forward), np.array([[49.5, 49.5], [0, 0]])), [[99.5, 99.5], [0, 0]])
    assert got["short"].error and got["short"].forward is None
    sql = spark.range(1).select(T.apply_homography(F.array(*map(F.lit, got["same"].forward)), F.lit(49.5), F.lit(49.5)).alias("p")).first().p
    assert (sql.x, sql.y) == pytest.approx((99.5, 99.5))
    m = spark.range(1).select(T.model_matrix(F.lit(3.0), F.lit(4.0), F.lit(1.5), F.lit(0.5), F.lit(30.0)).alias("m")).first().m
    assert np.allclose(np.reshape(m, (3, 3)), G.model(1.5, 0.5, 30, 3, 4)) and np.linalg.det(np.reshape(m, (3, 3))[:2, :2]) == pytest.approx(0.75)
    one = spark.range(1).select(T.downsample_factor(F.lit(0.2), F.lit(6.13)), T.downsample_factor(F.lit(6.13), F.lit(0.2)), T.crater_radius_px(F.lit(2.0), F.lit(0.2))).first()
    assert tuple(one) == pytest.approx((30.65, 1.0, 5000.0))


def test_phase_correlation_finds_the_shift():
    a = G.smooth_field(64, 1)
    dx, dy, _, psr = G.phase_correlate(a, np.roll(a, (5, -7), (0, 1)))
    assert (dx, dy) == (7, -5) and psr > 8
    with pytest.raises(ValueError, match="size"):
        G.phase_correlate(a, a[:10])


def test_fourier_mellin_finds_scale_and_rotation():
    a = G.smooth_field(192, 4, 0.2)
    c = (192 - 1) / 2
    h = np.eye(3)
    h[:2, :2] = G.linear(1.1, 1.1, 10)
    h[:2, 2] = c - h[:2, :2] @ [c, c]
    got = G.fourier_mellin(a, G.warp(a, h))
    assert got["scale"] == pytest.approx(1.1, abs=0.03) and got["theta"] == pytest.approx(10, abs=1.5)


def test_grid_search_and_simplex(spark):
    a = G.smooth_field(96, 5, 0.2)
    h = np.eye(3)
    h[:2, :2] = G.linear(1.1, 0.95, 5)
    c = (96 - 1) / 2
    h[:2, 2] = c - h[:2, :2] @ [c, c]
    b = G.warp(a, h)
    best = G.grid_search(spark, a, b, (0.8, 1.25), (-15.0, 15.0), coarse=5, fine=5, passes=1, polish_passes=0)
    fine = G.refine(a, b, best["sx"], best["sy"], best["theta"])
    assert fine["psr"] >= best["psr"] and fine["sx"] == pytest.approx(1.1, abs=0.04) and fine["sy"] == pytest.approx(0.95, abs=0.04) and fine["theta"] == pytest.approx(5, abs=2)


def test_robust_fit_ignores_outliers():
    r = np.random.default_rng(0)
    src = r.random((40, 2)) * 300
    dst = src @ G.linear(1.05, 0.97, 2).T + [5, -8]
    dst[:6] += 90
    p, keep = G.fit_model(src, dst)
    assert np.allclose(p, [1.05, 0.97, 2, 5, -8], atol=1e-6) and keep.sum() == 34


def test_gate_and_too_few_votes(spark):
    assert G.gate(spark)["passed"]
    flat = np.zeros((40, 40))
    with pytest.raises(ValueError, match="five votes"):
        G.register(spark, flat, flat, np.eye(3), n_tiles=2, tile=36)


def test_ransac():
    r = np.random.default_rng(1)
    src = r.random((60, 2)) * 100
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.9, 3], [1e-4, 0, 1]])
    dst = T.project(h, src)
    dst[:20] = r.random((20, 2)) * 100
    got, ok = G.ransac(src, dst, 1.0, 500)
    assert np.allclose(got, h, atol=1e-6) and ok.sum() >= 40
    assert G.ransac(src[:3], dst[:3])[0] is None


def test_detection_of_rings_and_suppression(spark):
    got = D.best(D.detect_tiles(D.ring_tiles(spark), 5.0)).limit(2).collect()
    found = sorted((round(r.cx), round(r.cy)) for r in got)
    assert abs(found[0][0] - 80) <= 3 and abs(found[0][1] - 90) <= 3 and abs(found[1][0] - 180) <= 3
    det = spark.createDataFrame([("p", 10.0, 10.0, 8.0, 0.9, 1.0, 1.0), ("p", 12.0, 10.0, 8.0, 0.8, 1.0, 1.0), ("p", 40.0, 10.0, 8.0, 0.1, 1.0, 1.0)], D.SCHEMA)
    assert {r.cx for r in R.suppress(det).collect()} == {10.0, 40.0}


def test_comparison_report(spark):
    pts = [(0, 0, 30), (100, 0, 20), (0, -100, 25), (70, 80, 15), (-60, 50, 28), (10, -40, 22)]
    a = spark.createDataFrame([(0, i, float(x), float(y), float(r)) for i, (x, y, r) in enumerate(pts)], "g int, id int, x double, y double, radius double")
    b = a.withColumn("x", F.col("x") + 7)
    matched = comparison.match_graphs(a, b, 3, ratio=None)
    fitted, scores, bands = comparison.report(matched, [1, 0, 7, 0, 1, 0, 0, 0, 1])
    assert fitted.first().n_inliers == 6 and scores.first().pct_correct == 100 and bands.where("band = 0").first().n == 6
