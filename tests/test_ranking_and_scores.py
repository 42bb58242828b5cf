import math

import pytest
from pyspark.sql import functions as F

from skyquilt.functions import angles as A
from skyquilt.functions import text as X
from skyquilt.operators import graph, ranking, scoring


@pytest.mark.parametrize(("a", "b", "d"), [(0, 10, 10), (350, 10, 20), (10, 350, 20), (100, 100, 0), (0, 180, 180), (0, 181, 179)])
def test_angle_diff(spark, a, b, d):
    assert spark.range(1).select(A.angle_diff(F.lit(a), F.lit(b))).first()[0] == d


MATCH = [((9.5, 90.0), (50.0, 95.0), False, "OHRC elevation"), ((50.0, 10.0), (55.0, 120.0), False, "azimuth diff"), ((40.0, 5.0), (45.0, 355.0), True, ""), ((None, None), (50.0, 95.0), False, "label needed: a"), ((20.0, 5.0), (45.0, 5.0), False, "OHRC elevation")]


@pytest.mark.parametrize(("a", "b", "ok", "text"), MATCH)
def test_sun_match(spark, a, b, ok, text):
    df = spark.createDataFrame([("a", *a, "b", *b)], "ia string, ea double, za double, ib string, eb double, zb double")
    got = df.select(ranking.match_reasons(*[F.col(c) for c in ("ia", "ea", "za", "ib", "eb", "zb")])).first()[0]
    assert (not got) == ok and text in " ".join(got)


@pytest.mark.parametrize(("overlap", "craters", "e1", "e2", "n"), [(100.0, 10, 60.0, 65.0, 0), (50.0, 10, 60.0, 65.0, 1), (100.0, 1, 20.0, 19.9, 2), (100.0, 9, None, 65.0, 1), (100.0, 9, 20.0, 60.0, 1)])
def test_candidate_reasons(spark, overlap, craters, e1, e2, n):
    df = spark.createDataFrame([(overlap, craters, e1, 0.0, e2, 170.0)], "o double, c int, e1 double, z1 double, e2 double, z2 double")
    got = df.select(ranking.candidate_reasons(*[F.col(c) for c in df.columns])).first()[0]
    assert len(got) == n
    strict = df.select(ranking.candidate_reasons(*[F.col(c) for c in df.columns], enforce_azimuth=True)).first()[0]
    assert len(strict) == n + (e1 is not None)


def test_shortlist_falls_back(spark):
    rows = spark.createDataFrame([(1, False, 3.0), (2, False, 5.0)], "id int, passes boolean, d double")
    assert [r.id for r in ranking.shortlist(rows, "passes", 5, F.desc("d")).orderBy("rank").collect()] == [2, 1]
    one = rows.withColumn("passes", F.col("id") == 1)
    assert [r.id for r in ranking.shortlist(one, "passes", 5, F.desc("d")).collect()] == [1]


def points(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "expected_x double, expected_y double, predicted_x double, predicted_y double")


def test_score(spark):
    perfect = scoring.score(points(spark, [(1, 2, 1, 2), (3, 4, 3, 4)]), 75.0).first()
    assert perfect.pct_correct == 100 and perfect.max_error == 0 and not perfect.bias_suspected
    assert scoring.score(points(spark, [(0, 0, 75, 0)]), 75.0).first().n_correct == 1
    assert scoring.score(points(spark, [(0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 500, 0), (0, 0, 0, 900)]), 75.0).first().pct_correct == 50
    shifted = scoring.score(points(spark, [(0, 0, 30, 0)] * 4), 50.0).first()
    assert shifted.mean_dx == -30 and shifted.bias_suspected
    empty = scoring.score(points(spark, []), 75.0).first()
    assert (empty.n, empty.pct_correct, empty.median_error) == (0, 0, 0)
    p90 = scoring.score(points(spark, [(0, 0, e, 0) for e in (1, 2, 3, 4, 20)]), 75.0).first()
    assert p90.p90_error == pytest.approx(13.6)


def test_bands_keep_empty_ones(spark):
    got = {r.band: r.n for r in scoring.error_bands(spark.createDataFrame([(0.0,), (74.9,), (75.0,), (9999.0,)], "error double")).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}


def test_detection_loser_stays_unmatched(spark):
    det = spark.createDataFrame([(0, 1, 1, 100.0, 100.0, 20.0), (0, 2, 2, 101.0, 100.0, 20.0), (0, 3, 3, 900.0, 900.0, 20.0)], "g int, det_id int, det_ord int, x double, y double, r double")
    gt = spark.createDataFrame([(0, 7, 100.0, 100.0, 20.0), (0, 8, 120.0, 100.0, 8.0)], "g int, gt_id int, x double, y double, r double")
    matched = scoring.match_detections(det, gt)
    assert {r.det_id: r.gt_id for r in matched.collect()} == {1: 7, 2: None, 3: None}
    rep = scoring.detection_report(matched, gt).first()
    assert (rep.tp, rep.fp, rep.fn, rep.precision, rep.recall) == (1, 2, 1, 0.3333, 0.5)


def test_mad_rule(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 1.1, 0.9, 1, 1.05, 0.95, 50)], "e double")
    assert {r.e for r in scoring.mad_inliers(rows, "e", 2.0).where("inlier").collect()} == {1.0, 1.1, 0.9, 1.05, 0.95}
    few = spark.createDataFrame([(1.0,), (50.0,)], "e double")
    assert scoring.mad_inliers(few, "e", 0.0).where("inlier").count() == 2


def test_occupancy_and_error_structure(spark):
    pts = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (99.0, 99.0), (150.0, 1.0)], "x double, y double")
    assert scoring.occupancy(pts, "x", "y", 100, 100).first().n_cells == 2
    plane = spark.createDataFrame([(float(x), float(y), 3.0 + 2 * x - y) for x in range(5) for y in range(5)], "x double, y double, e double")
    got = scoring.error_structure(plane, "x", "y", "e").first()
    assert got.rms_linear == pytest.approx(0, abs=1e-6) and got.rms_centred == pytest.approx(math.sqrt(4 * 2 + 2))


SCHEMA = "g int, id int, x double, y double, radius double"
BASE = [(0, 0, 30), (100, 0, 20), (0, -100, 25), (70, 80, 15), (-60, 50, 28), (10, -40, 22)]


def build(spark, turn=0.0, scale=1.0):
    c, s = math.cos(math.radians(turn)) * scale, math.sin(math.radians(turn)) * scale
    return spark.createDataFrame([(0, i, c * x - s * y, s * x + c * y, float(r) * scale) for i, (x, y, r) in enumerate(BASE)], SCHEMA)


def test_square_graph(spark):
    n = spark.createDataFrame([(0, i, float(x), float(y), 10.0) for i, (x, y) in enumerate([(0, 0), (100, 0), (100, 100), (0, 100)])], SCHEMA)
    e = graph.knn_edges(n, 2)
    assert {(r.a, r.b) for r in e.collect()} == {(0, 1), (1, 2), (2, 3), (0, 3)}
    assert {(r.a, r.b) for r in graph.knn_edges(n, 2, cell=40.0).collect()} == {(0, 1), (1, 2), (2, 3), (0, 3)}


def test_neighbourhood_padding(spark):
    n = spark.createDataFrame([(0, 0, 0.0, 0.0, 20.0), (0, 1, 10.0, 0.0, 10.0)], SCHEMA)
    h = graph.neighborhoods(n, graph.knn_edges(n, 3), 3).orderBy("id").first()
    assert h.ids == [1, -1, -1] and h.dist_ratio == [1.0, 3.0, 3.0] and h.size_ratio == [0.5, 0.0, 0.0] and h.dist[1] == math.inf


@pytest.mark.parametrize(("turn", "scale"), [(0.0, 1.0), (30.0, 1.5)])
def test_mutual_match_is_invariant(spark, turn, scale):
    hood = lambda n: graph.neighborhoods(n, graph.knn_edges(n, 3), 3)
    got = graph.mutual_matches(hood(build(spark)), hood(build(spark, turn, scale)), ratio=None).collect()
    assert len(got) == len(BASE) and all(r.a_id == r.b_id for r in got)
    kept = graph.consistent_matches(spark.createDataFrame([(0, i, i) for i in range(6)], "g int, a_id int, b_id int"), hood(build(spark)), hood(build(spark, turn, scale)))
    assert kept.count() == 6


def test_lowe_ratio(spark):
    a = spark.createDataFrame([(0, 1, [0.0, 0.0]), (0, 2, [5.0, 5.0])], "g int, a_id int, a_d array<double>")
    b = spark.createDataFrame([(0, 1, [0.0, 0.1]), (0, 2, [9.0, 9.0]), (0, 3, [1.0, 1.0])], "g int, b_id int, b_d array<double>")
    got = graph.lowe_matches(a, b, graph.l2(F.col("a_d"), F.col("b_d")), 0.7).collect()
    assert [(r.a_id, r.b_id) for r in got] == [(1, 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([(["x.py", "requirements.txt", "weights.pth", "README.md"],), (["sub/requirements.txt"],)], "f array<string>")
    got = [tuple(r.c) for r in df.select(X.file_classes(F.col("f")).alias("c")).collect()]
    assert got == [(True, True, True), (False, True, False)]
    one = spark.range(1).select(X.view_variant(F.lit("ch2_tmc_nca_2020")), X.strip(F.lit(" \t\n")), X.to_long(F.lit("2.5")), X.to_double(F.lit("abc")), X.header(F.lit("Center-Latitude (deg)"))).first()
    assert tuple(one) == ("aft", None, 2, None, "center_latitude_deg")
    html = "<a href='/a'>x</a><a href=\"b.html\"><a href='mailto:q@x'><a href='/a'>"
    assert spark.range(1).select(X.links(F.lit(html), F.lit("http://h.org/d/page.html"))).first()[0] == ["http://h.org/a", "http://h.org/d/b.html"]
