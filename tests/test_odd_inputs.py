"""Inputs on which queries once differed from their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from skyquilt.functions import transforms
from skyquilt.operators import spatial
from test_entry import rows


@pytest.fixture
def agrees(spark, tmp_path):
    """Writes tables given as SELECTs and compares a query's rows with its SQL's, texts letter by letter."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, select in tables.items():
            con.execute(f"copy ({select}) to '{tmp_path}/{t}.parquet'")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        got, want = rows(entry.queries()[name](spark, str(tmp_path)).toPandas()), rows(con.execute(entry.oracle_sql()[name]).df())
        assert want[1] and got == want

    return check


SUPPLIERS = "SELECT i::BIGINT AS s_suppkey, [-0.3, 0.3, -0.5, 0.5, -89.7, -90.2, -1.5, 0.0, 450.5, NULL][i % 10 + 1]::DOUBLE AS s_acctbal FROM range(40) t(i)"
#: Ids of two boxes, as boxes repeat after 10,080 ids.
SAME_BOXES = "SELECT (10080 * (i // 2) + i % 2)::BIGINT AS {} FROM range(60) t(i)"
NATIONS = "SELECT i::INTEGER AS n_nationkey FROM range(25) t(i)"


def test_sun_match_of_balances_that_round_to_minus_zero(agrees):
    agrees("sun_match_cross", supplier=SUPPLIERS, nation=NATIONS)


def vectors(points):
    """SELECT of embeddings whose points come to lie at places in steps of a hundredth."""
    values = ", ".join(f"({i}, {label}, [{x / 50000}, {y / 25000}])" for i, (label, x, y) in enumerate(points))
    return f"SELECT i::BIGINT AS vec_id, v::FLOAT[] AS embedding, g::INTEGER AS label FROM (VALUES {values}) t(i, g, v)"


def test_copies_of_points_find_themselves(agrees):
    agrees("mutual_neighbour_match", embeddings=vectors([(0, 700 * k % 997, 300 * k % 991) for k in range(25)] * 6))


def test_neighbours_at_one_distance_keep_their_order_when_scaled(agrees):
    # neighbours 3, 4 and 5 steps off on circles around each centre: distances that are equal but for rounding
    ring = [(0, 0), (30, 40), (50, 0), (-14, 48), (0, -50), (-48, -14), (40, -30)]
    agrees("mutual_neighbour_match", embeddings=vectors([(0, 1700 * k + 7 + x + k % 3, 911 * k % 5003 + 1 + y) for k in range(12) for x, y in ring]))


def test_equal_boxes_are_clipped_once(agrees, monkeypatch):
    seen, whole = [], spatial.overlap_join
    monkeypatch.setattr(spatial, "overlap_join", lambda a, b, **k: seen.append((a.count(), b.count())) or whole(a, b, **k))
    agrees("overlap_manifest_pairs", customer=SAME_BOXES.format("c_custkey"), supplier=SAME_BOXES.format("s_suppkey"))
    assert seen == [(2, 2)]


def test_homographies_of_equal_boxes_are_fitted_once(agrees, monkeypatch):
    seen, whole = [], transforms.corner_transform
    monkeypatch.setattr(transforms, "corner_transform", lambda pairs, **k: seen.append(pairs.count()) or whole(pairs, **k))
    agrees("homography_project", supplier=SAME_BOXES.format("s_suppkey"), part=SAME_BOXES.format("p_partkey"))
    assert seen == [2]
