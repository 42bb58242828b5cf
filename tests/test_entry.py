import os

import pytest

import __spark_entry__ as entry
from skyquilt import more_queries  # noqa: F401 - registers its queries
from skyquilt import queries as base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    cols = sorted(frame.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist())


def test_entry(spark):
    assert entry.entry(spark).count() == 18


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    assert rows(base.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(base.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLES)))
def test_rows_only(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_homographies_of_all_box_pairs(spark):
    pairs = base.box_pairs(spark, SF, base.A_SUPPLIER, base.B_PART).select(base.X.pair_id("a_id", "b_id").alias("pair_id"))
    got = base.QUERIES["homography_project"](spark, SF)
    assert sorted(r.pair_id for r in got.select("pair_id").collect()) == sorted(r.pair_id for r in pairs.collect())
