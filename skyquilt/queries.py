"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it.

The tables hold no image catalogs, so every operator runs on a fixed re-typing of a table's columns
(boxes from ids, angles from balances, coordinates from embeddings); the SQL says the same without
cells, broadcasts or rewrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions import angles as A
from skyquilt.functions import geometry as G
from skyquilt.functions import text as X
from skyquilt.operators import catalog, graph, ranking, scoring, spatial

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str, name: str, key: str, w: int, wm: int, h: int, hm: int, side: str) -> DataFrame:
    """Axis-aligned boxes in degrees from ids, as (id, box, ring)."""
    k = F.col(key)
    x0, y0 = k * 37 % 360 - 180, k * 53 % 160 - 80
    x1, y1 = x0 + w + k % wm, y0 + h + k % hm
    box = F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
    return table(spark, sf_dir, name).select(k.alias(f"{side}_id"), box.alias(f"{side}_box"), G.box_ring(x0, y0, x1, y1).alias(f"{side}_ring"))


def box_sql(name: str, key: str, w: int, wm: int, h: int, hm: int, side: str) -> str:
    return f"""{side} AS (SELECT {key} AS {side}_id, ({key} * 37 % 360) - 180 AS {side}_x0, ({key} * 53 % 160) - 80 AS {side}_y0,
      ({key} * 37 % 360) - 180 + {w} + {key} % {wm} AS {side}_x1, ({key} * 53 % 160) - 80 + {h} + {key} % {hm} AS {side}_y1 FROM {name})"""


def pairs_sql(min_pct: str, a: str = "a", b: str = "b") -> str:
    return f"""met AS (SELECT *, (least(a_x1, b_x1) - greatest(a_x0, b_x0))::DOUBLE * (least(a_y1, b_y1) - greatest(a_y0, b_y0)) AS inter,
      ((a_x1 - a_x0) * (a_y1 - a_y0))::DOUBLE AS area_a, ((b_x1 - b_x0) * (b_y1 - b_y0))::DOUBLE AS area_b,
      (greatest(a_y0, b_y0) + least(a_y1, b_y1)) / 2.0::DOUBLE AS cy
      FROM {a}, {b} WHERE a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1),
    pairs AS (SELECT *, 100 * inter / least(area_a, area_b) AS pct FROM met WHERE {min_pct})"""


A_SUPPLIER = ("supplier", "s_suppkey", 2, 5, 3, 4, "a")
B_PART = ("part", "p_partkey", 6, 7, 5, 6, "b")
A_CUSTOMER = ("customer", "c_custkey", 2, 5, 3, 4, "a")
B_SUPPLIER = ("supplier", "s_suppkey", 6, 7, 5, 6, "b")


def box_pairs(spark: SparkSession, sf_dir: str, a: tuple, b: tuple) -> DataFrame:
    met = spatial.box_candidates(boxes(spark, sf_dir, *a), boxes(spark, sf_dir, *b))
    area = lambda s: (F.col(f"{s}_box.x1") - F.col(f"{s}_box.x0")) * (F.col(f"{s}_box.y1") - F.col(f"{s}_box.y0"))
    common = G.intersect_bounds(F.col("a_box"), F.col("b_box"))
    met = met.withColumn("inter", G.box_overlap(F.col("a_box"), F.col("b_box"))).where("inter > 0")
    return met.select("a_id", "b_id", "a_ring", "b_ring", "inter", (100 * F.col("inter") / F.least(area("a"), area("b"))).alias("pct"), ((common["y0"] + common["y1"]) / 2).alias("cy"))


@query(f"""WITH {box_sql(*A_SUPPLIER)}, {box_sql(*B_PART)}, {pairs_sql("true")}
SELECT a_id, b_id, round(pct, 6) AS pct, abs(cy) > 60 AS polar, row_number() OVER w AS rank FROM pairs
WINDOW w AS (ORDER BY abs(cy) > 60, pct DESC, b_id % 3 <> 0, a_id, b_id) QUALIFY rank <= 20""")
def spatial_overlap_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = box_pairs(spark, sf_dir, A_SUPPLIER, B_PART).withColumn("nadir", F.col("b_id") % 3 == 0)
    top = ranking.ranked(pairs, F.abs("cy") > 60, F.desc("pct"), ~F.col("nadir"), "a_id", "b_id", top=20)
    return top.select("a_id", "b_id", F.round("pct", 6).alias("pct"), (F.abs("cy") > 60).alias("polar"), "rank")


@query(f"""WITH {box_sql(*A_CUSTOMER)}, {box_sql(*B_SUPPLIER)}, {pairs_sql("100 * inter / least(area_a, area_b) >= 50")}
SELECT a_id || '__x__' || b_id AS pair_id, round(pct, 6) AS pct_smaller, round(100 * inter / area_a, 6) AS pct_a, round(100 * inter / area_b, 6) AS pct_b, round(inter, 6) AS area FROM pairs""")
def overlap_manifest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = boxes(spark, sf_dir, *A_CUSTOMER), boxes(spark, sf_dir, *B_SUPPLIER)
    joined = spatial.overlap_join(spatial.shapes(a, "a").drop("a_box"), spatial.shapes(b, "b").drop("b_box"), min_pct=50.0)
    o = lambda c: F.round(f"overlap.{c}", 6)
    met = joined.select("a_shape", "b_shape", o("pct_smaller").alias("pct_smaller"), o("pct_a").alias("pct_a"), o("pct_b").alias("pct_b"), o("inter").alias("area"))
    return spatial.of_shapes(met, a, b).select(X.pair_id(F.col("a_id"), F.col("b_id")).alias("pair_id"), "pct_smaller", "pct_a", "pct_b", "area")


@query(f"""WITH {box_sql(*A_SUPPLIER)}, {box_sql(*B_PART)}, {pairs_sql("true")}
SELECT (SELECT count(*) FROM a) * (SELECT count(*) FROM b) AS naive, (SELECT count(*) FROM a, b WHERE a_x0 <= b_x1 AND b_x0 <= a_x1 AND a_y0 <= b_y1 AND b_y0 <= a_y1) AS candidates, count(*) AS overlaps, count(*) FILTER (abs(cy) <= 60) AS non_polar FROM pairs""")
def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = spatial.box_candidates(boxes(spark, sf_dir, *A_SUPPLIER), boxes(spark, sf_dir, *B_PART)).select("a_box", "b_box")
    common = G.intersect_bounds(F.col("a_box"), F.col("b_box"))
    met = met.select(G.box_overlap(F.col("a_box"), F.col("b_box")).alias("inter"), ((common["y0"] + common["y1"]) / 2).alias("cy"))
    sizes = table(spark, sf_dir, "supplier").agg(F.count("*").alias("na")).crossJoin(table(spark, sf_dir, "part").agg(F.count("*").alias("nb")))  # one row each
    counted = met.agg(F.count("*").alias("candidates"), F.count_if(F.col("inter") > 0).alias("overlaps"), F.count_if((F.col("inter") > 0) & (F.abs("cy") <= 60)).alias("non_polar"))
    return counted.crossJoin(sizes).select((F.col("na") * F.col("nb")).alias("naive"), "candidates", "overlaps", "non_polar")


POINTS_SQL = "points AS (SELECT vec_id, (embedding[1] * 500)::DOUBLE AS x, (embedding[2] * 250)::DOUBLE AS y FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("embedding")[0] * F.lit(500).cast("float")).cast("double").alias("x"), (F.col("embedding")[1] * F.lit(250).cast("float")).cast("double").alias("y"))


@query(f"""WITH {box_sql(*A_SUPPLIER)}, {POINTS_SQL}
SELECT a_id, count(vec_id) AS n_points, round(count(vec_id) / ((a_x1 - a_x0) * (a_y1 - a_y0))::DOUBLE, 6) AS density FROM a
LEFT JOIN points ON x > a_x0 AND x < a_x1 AND y > a_y0 AND y < a_y1 GROUP BY a_id, a_x0, a_x1, a_y0, a_y1""")
def pip_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spatial.count_points(boxes(spark, sf_dir, *A_SUPPLIER), points(spark, sf_dir), "a_id", "a_ring")
    return counted.select("a_id", "n_points", F.round(ranking.density(F.col("n_points"), G.area(F.col("a_ring"))), 6).alias("density"))


@query(f"""WITH {box_sql(*A_SUPPLIER)}, b AS (SELECT s_suppkey AS b_id, ((s_suppkey + 1) * 37 % 360) - 180 AS b_x0, (s_suppkey * 53 % 160) - 80 AS b_y0,
  ((s_suppkey + 1) * 37 % 360) - 150 AS b_x1, (s_suppkey * 53 % 160) - 77 AS b_y1 FROM supplier)
SELECT a_id, round((greatest(0, least(a_x1, b_x1) - greatest(a_x0, b_x0)) * greatest(0, least(a_y1, b_y1) - greatest(a_y0, b_y0)))::DOUBLE, 6) AS inter,
  round((a_x0 + a_x1) / 2.0, 6) AS cx, round((a_y0 + a_y1) / 2.0, 6) AS cy, round((a_x1 - a_x0) * (a_y1 - a_y0)::DOUBLE, 6) AS area FROM a JOIN b ON a_id = b_id""")
def convex_clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = boxes(spark, sf_dir, *A_SUPPLIER)
    k = F.col("a_id")
    x0, y0 = (k + 1) * 37 % 360 - 180, k * 53 % 160 - 80
    other = G.box_ring(x0, y0, x0 + 30, y0 + 3)
    c = G.centroid(F.col("a_ring"))
    return a.select("a_id", F.round(G.area(G.clip(F.col("a_ring"), other)), 6).alias("inter"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), F.round(G.area(F.col("a_ring")), 6).alias("area"))


@query("""WITH tagged AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS nth FROM documents)
SELECT source AS file, count(*) FILTER (nth = 1) AS kept FROM tagged GROUP BY source""")
def catalog_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "source", "doc_id")
    unique = catalog.first_wins(docs, "text", "source", "doc_id").groupBy("source").agg(F.count("*").alias("n"))
    return docs.select("source").distinct().join(unique, "source", "left").select(F.col("source").alias("file"), F.coalesce("n", F.lit(0)).alias("kept"))


@query("""WITH p AS (SELECT o_orderkey, o_totalprice % 200 - 100 AS lat, nullif(o_orderkey % 400, 7) - 200.0 AS lon FROM orders)
SELECT CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN 'good' ELSE 'bad' END AS state, count(*) AS n,
  count(*) FILTER (lat BETWEEN -14 AND -12 AND lon BETWEEN 24 AND 26) AS in_region FROM p GROUP BY 1""")
def coord_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select((F.col("o_totalprice") % 200 - 100).alias("lat"), (F.nullif(F.col("o_orderkey") % 400, F.lit(7)) - 200.0).alias("lon"))
    good = G.valid_lat(F.col("lat")) & G.valid_lon(F.col("lon"))
    inside = catalog.in_region(F.col("lat"), F.col("lon"), (-14, -12), (24, 26))
    return p.groupBy(F.when(good, "good").otherwise("bad").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(inside, F.lit(False))).alias("in_region"))


ANGLES_SQL = """angles AS (SELECT s_suppkey AS product_id, CASE WHEN s_suppkey % 7 <> 0 THEN round(s_acctbal, 0) % 90 END AS elev, round(s_acctbal, 0) * 7 % 360 AS azim FROM supplier)"""


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.signum("s_acctbal") * F.round(F.abs("s_acctbal"), 0)  # SQL rounds -0.3 to -0.0, which the notes show
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("product_id"), F.when(F.col("s_suppkey") % 7 != 0, whole % 90).alias("elev"), (whole * 7 % 360).alias("azim"))


CANDIDATE_SQL = f"""WITH {box_sql(*A_CUSTOMER)}, {box_sql(*B_SUPPLIER)}, {pairs_sql("true")}, {ANGLES_SQL},
lit AS (SELECT p.*, (a_id * 31 + b_id * 17) % 12 AS craters, ea.elev AS e1, ea.azim AS z1, eb.elev AS e2, eb.azim AS z2 FROM pairs p
  LEFT JOIN angles ea ON ea.product_id = p.a_id LEFT JOIN angles eb ON eb.product_id = p.b_id),
known AS (SELECT *, e1 IS NOT NULL AND z1 IS NOT NULL AND e2 IS NOT NULL AND z2 IS NOT NULL AS k FROM lit),
scored AS (SELECT *, list_filter([
  CASE WHEN pct < 90 THEN 'overlap ' || printf('%.1f', pct) || '% < 90.0%' END,
  CASE WHEN craters < 5 THEN 'only ' || craters || ' craters in footprint (< 5)' END,
  CASE WHEN k AND e1 < 20 THEN 'OHRC sun elevation ' || printf('%.1f', e1) || ' < 20.0' END,
  CASE WHEN k AND e2 < 20 THEN 'TMC2 sun elevation ' || printf('%.1f', e2) || ' < 20.0' END,
  CASE WHEN k AND abs(e1 - e2) > 30 THEN 'sun elevation diff ' || printf('%.1f', abs(e1 - e2)) || ' deg' END,
  CASE WHEN NOT k THEN 'sun angles unavailable - labels not downloaded' END], lambda x: x IS NOT NULL) AS reasons, craters / inter AS density FROM known)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = box_pairs(spark, sf_dir, A_CUSTOMER, B_SUPPLIER).withColumn("craters", (F.col("a_id") * 31 + F.col("b_id") * 17) % 12)
    lit = ranking.with_angles(pairs, angles(spark, sf_dir), "a_id", "b_id")
    a = [F.col(c) for c in ("elev_a", "azim_a", "elev_b", "azim_b")]
    out = lit.withColumn("reasons", ranking.candidate_reasons(F.col("pct"), F.col("craters"), *a)).withColumn("density", F.col("craters") / F.col("inter"))
    return out.withColumn("passes", F.size("reasons") == 0).withColumn("sun", a[0].isNotNull() & a[1].isNotNull() & a[2].isNotNull() & a[3].isNotNull())


@query(CANDIDATE_SQL + """
SELECT a_id || '__x__' || b_id AS pair_id, array_to_string(reasons, '; ') AS note, row_number() OVER w AS rank FROM scored
WINDOW w AS (ORDER BY len(reasons) > 0, NOT k, density DESC, a_id, b_id) QUALIFY rank <= 200""")
def candidate_rank_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.ranked(candidates(spark, sf_dir), ~F.col("passes"), ~F.col("sun"), F.desc("density"), "a_id", "b_id", top=200)
    return top.select(X.pair_id(F.col("a_id"), F.col("b_id")).alias("pair_id"), F.array_join("reasons", "; ").alias("note"), "rank")


@query(CANDIDATE_SQL + """, any_pass AS (SELECT coalesce(bool_or(len(reasons) = 0), false) AS p FROM scored)
SELECT a_id, b_id, len(reasons) = 0 AS passes, row_number() OVER w AS rank FROM scored, any_pass WHERE len(reasons) = 0 OR NOT p
WINDOW w AS (ORDER BY NOT k, density DESC, a_id, b_id) QUALIFY rank <= 10""")
def shortlist_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shortlist(candidates(spark, sf_dir), "passes", 10, ~F.col("sun"), F.desc("density"), "a_id", "b_id").select("a_id", "b_id", "passes", "rank")


@query(CANDIDATE_SQL + """
SELECT count(*) AS n, count(*) FILTER (len(reasons) = 0) AS n_passing, count(*) FILTER (k) AS n_with_sun, count(*) FILTER (NOT k) AS n_without_sun FROM scored""")
def ranking_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("passes").alias("n_passing"), F.count_if("sun").alias("n_with_sun"), F.count_if(~F.col("sun")).alias("n_without_sun"))


@query(f"""WITH {ANGLES_SQL}, n AS (SELECT n_nationkey AS id, (n_nationkey * 13 % 90)::DOUBLE AS e2, (n_nationkey * 41 % 360)::DOUBLE AS z2 FROM nation),
d AS (SELECT *, abs(azim - z2) % 360 AS dz FROM angles, n), m AS (SELECT *, least(dz, 360 - dz) AS az FROM d)
SELECT product_id AS a_id, id AS b_id, CASE WHEN elev IS NOT NULL THEN round(az, 6) END AS az_diff, elev IS NOT NULL AND elev > 20 AND e2 > 20 AND az <= 30 AS matched,
  array_to_string(list_filter([CASE WHEN elev IS NULL THEN 'label needed: ' || product_id || ' (sun angles not all present)' END,
    CASE WHEN elev <= 20 THEN 'OHRC elevation ' || printf('%.1f', elev) || ' < 20.0' END,
    CASE WHEN elev IS NOT NULL AND e2 <= 20 THEN 'TMC-2 elevation ' || printf('%.1f', e2) || ' < 20.0' END,
    CASE WHEN elev IS NOT NULL AND az > 30 THEN 'azimuth diff ' || printf('%.1f', az) || ' > 30.0' END], lambda x: x IS NOT NULL), '; ') AS note FROM m""")
def sun_match_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 13 % 90).cast("double").alias("e2"), (F.col("n_nationkey") * 41 % 360).cast("double").alias("z2"))
    # the product of both lists is what is asked for; the nations are 25 rows
    both = angles(spark, sf_dir).crossJoin(F.broadcast(nation))
    a = (F.col("product_id").cast("string"), F.col("elev"), F.col("azim"))
    b = (F.col("id").cast("string"), F.col("e2"), F.col("z2"))
    note = ranking.match_reasons(*a, *b)
    return both.select(F.col("product_id").alias("a_id"), F.col("id").alias("b_id"), F.when(F.col("elev").isNotNull(), F.round(A.angle_diff(F.col("azim"), F.col("z2")), 6)).alias("az_diff"), (F.size(note) == 0).alias("matched"), F.array_join(note, "; ").alias("note"))


@query("""SELECT d.doc_id, quality, l.doc_id IS NULL AS label_needed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def enrich_left_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", F.col("there").isNull().alias("label_needed"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.round(F.col("x"), 2).alias("x"), F.round(F.col("y"), 2).alias("y"), (F.col("vec_id") % 17 + 1).cast("double").alias("radius"))


NODES_SQL = "nodes AS (SELECT label AS g, vec_id AS id, round((embedding[1] * 500::FLOAT)::DOUBLE, 2) AS x, round((embedding[2] * 250::FLOAT)::DOUBLE, 2) AS y, (vec_id % 17 + 1)::DOUBLE AS radius FROM embeddings)"


@query(f"""WITH {NODES_SQL}, near AS (SELECT a.g, a.id AS p, b.id AS q, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, least(a.radius, b.radius) / greatest(a.radius, b.radius) AS r,
  row_number() OVER (PARTITION BY a.g, a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS nth FROM nodes a JOIN nodes b ON a.g = b.g AND a.id <> b.id)
SELECT DISTINCT g, least(p, q) AS a, greatest(p, q) AS b, round(dist, 6) AS dist, round(r, 6) AS size_ratio FROM near WHERE nth <= 4""")
def knn_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.knn_edges(nodes(spark, sf_dir), 4)
    return e.select("g", "a", "b", F.round("dist", 6).alias("dist"), F.round("size_ratio", 6).alias("size_ratio"))


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), "vec_id", F.col("embedding").cast("array<double>").alias("d"))
    side = lambda s, odd: e.where(F.col("vec_id") % 2 == odd).select("g", F.col("vec_id").alias(f"{s}_id"), F.col("d").alias(f"{s}_d"))
    return side("a", 0), side("b", 1)


@query("""WITH e AS (SELECT label AS g, vec_id, embedding::DOUBLE[] AS d FROM embeddings), m AS (
  SELECT a.g, a.vec_id AS a_id, b.vec_id AS b_id, list_distance(a.d, b.d) AS cost FROM e a JOIN e b ON a.g = b.g AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY g, a_id ORDER BY cost, b_id) AS nth FROM m)
SELECT x.g, x.a_id, x.b_id, round(x.cost, 4) AS cost FROM r x LEFT JOIN r y ON x.g = y.g AND x.a_id = y.a_id AND y.nth = 2
WHERE x.nth = 1 AND (coalesce(y.cost, 1) <= 0 OR x.cost < 0.95 * coalesce(y.cost, 1))""")
def lowe_ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = descriptors(spark, sf_dir)
    return graph.lowe_matches(a, b, graph.l2(F.col("a_d"), F.col("b_d")), 0.95).select("g", "a_id", "b_id", F.round("cost", 4).alias("cost"))


@query("""WITH a AS (SELECT vec_id AS a_id, round((embedding[1] * 500::FLOAT)::DOUBLE, 2) AS px, round((embedding[2] * 250::FLOAT)::DOUBLE, 2) AS py FROM embeddings WHERE vec_id % 3 = 0),
b AS (SELECT vec_id AS grid_id, round((embedding[1] * 500::FLOAT)::DOUBLE, 2) AS gx, round((embedding[2] * 250::FLOAT)::DOUBLE, 2) AS gy FROM embeddings WHERE vec_id % 3 <> 0)
SELECT a_id, grid_id, round(d2, 4) AS d2 FROM (SELECT a_id, grid_id, (px - gx) ** 2 + (py - gy) ** 2 AS d2, row_number() OVER (PARTITION BY a_id ORDER BY (px - gx) ** 2 + (py - gy) ** 2, grid_id) AS nth FROM a, b) WHERE nth = 1""")
def nn_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("vec_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
    probes = p.where("vec_id % 3 = 0").select(F.col("vec_id").alias("a_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    grid = p.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("grid_id"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    return spatial.nearest(probes, grid, "a_id", 16.0).select("a_id", "grid_id", F.round("d2", 4).alias("d2"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices against a linear model of quantity, as a correspondence."""
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("expected_x"), (F.col("l_quantity") * 1500).alias("predicted_x"), (F.col("l_discount") * 1000).alias("expected_y"), (F.col("l_tax") * 1000).alias("predicted_y"),
    )


RESIDUAL_SQL = """r AS (SELECT *, l_extendedprice - l_quantity * 1500 AS dx, (l_discount * 1000) - (l_tax * 1000) AS dy FROM lineitem), e AS (SELECT *, sqrt(dx * dx + dy * dy) AS error FROM r)"""


@query(f"""WITH {RESIDUAL_SQL} SELECT l_returnflag, count(*) AS n, count(*) FILTER (error <= 5000) AS n_correct, round(100.0 * count(*) FILTER (error <= 5000) / count(*), 4) AS pct_correct,
  round(avg(dx), 2) AS mean_dx, round(avg(dy), 2) AS mean_dy, round(min(error), 2) AS min_error, round(max(error), 2) AS max_error, round(avg(error), 2) AS mean_error,
  round(quantile_cont(error, 0.5), 2) AS median_error, round(quantile_cont(error, 0.9), 2) AS p90_error, abs(avg(dx)) > 1500 OR abs(avg(dy)) > 1500 AS bias_suspected FROM e GROUP BY l_returnflag""")
def correspondence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.score(residuals(spark, sf_dir), 5000.0, "l_returnflag")
    two = [F.round(c, 2).alias(c) for c in ("mean_dx", "mean_dy", "min_error", "max_error", "mean_error", "median_error", "p90_error")]
    return s.select("l_returnflag", "n", "n_correct", F.round("pct_correct", 4).alias("pct_correct"), *two, "bias_suspected")


@query(f"""WITH {RESIDUAL_SQL}, b(band, label, lo, hi) AS (VALUES (0, '<=75', 0, 75), (1, '75-150', 75, 150), (2, '150-300', 150, 300), (3, '300-600', 300, 600), (4, '600-1200', 600, 1200), (5, '1200-2500', 1200, 2500), (6, '>2500', 2500, 1e18))
SELECT band::INT AS band, label, count(error) AS n FROM b LEFT JOIN e ON error >= lo AND error < hi GROUP BY band, label""")
def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_bands(scoring.with_errors(residuals(spark, sf_dir)))


@query(f"""WITH {RESIDUAL_SQL} SELECT count(*) FILTER (error <= 50) AS within_50, count(*) FILTER (error <= 100) AS within_100, count(*) FILTER (error <= 300) AS within_300 FROM e""")
def within_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_errors(residuals(spark, sf_dir)).agg(*scoring.within(F.col("error"), 50, 100, 300))


DETECTION_SQL = """det AS (SELECT event_id AS det_id, event_id * 37 % 400000 * 1.0 AS x, event_id % 97 * 20.0 AS y, 20 + event_id % 60 AS r FROM events),
gt AS (SELECT o_orderkey AS gt_id, o_orderkey * 37 % 400000 * 1.0 AS x, o_orderkey % 89 * 20.0 AS y, 20 + o_orderkey % 50 AS r FROM orders),
c AS (SELECT det_id, gt_id, d.r AS dr, g.r AS gr, sqrt((d.x - g.x) ** 2 + (d.y - g.y) ** 2) AS dist FROM det d JOIN gt g ON abs(d.x - g.x) <= 150 AND abs(d.y - g.y) <= 150),
o AS (SELECT *, greatest(least(dr, gr) - dist / 2, 0) ** 2 * pi() AS both_ FROM c WHERE dist <= 150 AND greatest(dr, gr) <= 3 * least(dr, gr)),
i AS (SELECT *, both_ / greatest(pi() * (dr * dr + gr * gr) - both_, 1e-6) AS iou FROM o),
ch AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS nth FROM i WHERE iou > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY det_id) AS k FROM ch WHERE nth = 1)"""


@query(f"""WITH {DETECTION_SQL}, s AS (SELECT count(*) FILTER (k = 1) AS tp, (SELECT count(*) FROM det) AS nd, (SELECT count(*) FROM gt) AS ng FROM w)
SELECT tp, nd - tp AS fp, ng - tp AS fn, round(tp / greatest(nd, 1), 4) AS precision, round(tp / greatest(ng, 1), 4) AS recall, round(2.0 * tp / nd * tp / ng / greatest(tp / nd + tp / ng, 1e-6), 4) AS f1 FROM s""")
def detection_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = table(spark, sf_dir, "events").select(F.lit(0).alias("g"), F.col("event_id").alias("det_id"), F.col("event_id").alias("det_ord"), (F.col("event_id") * 37 % 400000 * 1.0).alias("x"), (F.col("event_id") % 97 * 20.0).alias("y"), (F.col("event_id") % 60 + 20).alias("r"))
    gt = table(spark, sf_dir, "orders").select(F.lit(0).alias("g"), F.col("o_orderkey").alias("gt_id"), (F.col("o_orderkey") * 37 % 400000 * 1.0).alias("x"), (F.col("o_orderkey") % 89 * 20.0).alias("y"), (F.col("o_orderkey") % 50 + 20).alias("r"))
    return scoring.detection_report(scoring.match_detections(det, gt), gt)


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT e.*, m, abs(value - m) AS dev FROM events e JOIN m USING (event_type)),
x AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1), i AS (SELECT d.*, value <= greatest(3 * 1.4826 * mad, 5.0) AS ok FROM d JOIN x USING (event_type)),
k AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY event_type) AS k FROM i)
SELECT event_type, count(*) AS n, count(*) FILTER (ok OR k < 5) AS n_inlier FROM k GROUP BY 1""")
def mad_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.mad_inliers(table(spark, sf_dir, "events").select("event_type", "value"), "value", 5.0, 5, "event_type")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("inlier").alias("n_inlier"))


@query("""WITH c AS (SELECT trunc((user_id % 130 - 5) * 8 / 100.0)::INT AS gx, trunc((event_id % 90) * 8 / 100.0)::INT AS gy FROM events)
SELECT count(DISTINCT gx * 8 + gy) AS n_cells, count(DISTINCT gx * 8 + gy) / 64 AS uniformity FROM c WHERE gx BETWEEN 0 AND 7 AND gy BETWEEN 0 AND 7""")
def occupancy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.occupancy(table(spark, sf_dir, "events").select((F.col("user_id") % 130 - 5).alias("x"), (F.col("event_id") % 90).alias("y")), "x", "y", 100, 100)


@query("""WITH m AS (SELECT l_shipdate::DATE AS d, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
w AS (SELECT m, lag(m) OVER (ORDER BY d) AS p, lead(m) OVER (ORDER BY d) AS q FROM m)
SELECT round(avg(CASE WHEN p IS NULL THEN q - m WHEN q IS NULL THEN m - p ELSE (q - p) / 2 END), 4) AS mean_gradient, count(*) AS n FROM w""")
def mirror_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_extendedprice")
    return catalog.chain_gradient(rows, "d", "l_extendedprice").select(F.round("mean_gradient", 4).alias("mean_gradient"), "n")


@query("""WITH e AS (SELECT user_id, event_id, ts, (epoch_us(ts) % 86400000000) / 86400000000.0 AS f FROM events),
p AS (SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, round(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0, 2) AS days, abs(a.f - b.f) AS d FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id)
SELECT user_id, a_id, b_id, days, round(least(d, 1 - d) * 86400, 3) AS tod_seconds FROM p WHERE least(d, 1 - d) * 86400 < 3600""")
def time_delta_cotemporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    # within an hour of each other on the clock: in the same hour of the day or in neighbouring ones
    a = e.select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("ta"), F.explode(F.array(*[F.pmod(F.hour("ts") + k, F.lit(24)) for k in (-1, 0, 1)])).alias("hour"))
    b = e.select("user_id", F.col("event_id").alias("b_id"), F.col("ts").alias("tb"), F.hour("ts").alias("hour"))
    pairs = a.join(b, ["user_id", "hour"]).where("a_id < b_id")
    days = F.round(F.abs(A.micros(F.col("ta")) - A.micros(F.col("tb"))) / 86_400_000_000, 2)
    tod = A.circular_seconds(A.day_fraction(F.col("ta")), A.day_fraction(F.col("tb")))
    return pairs.where(tod < 3600).select("user_id", "a_id", "b_id", days.alias("days"), F.round(tod, 3).alias("tod_seconds"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1) AS hs, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages),
f AS (SELECT *, root || regexp_extract(regexp_replace(url[length(root) + 1:], '[?#].*$', ''), '^(.*/)', 1) AS folder, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) AS scheme FROM p),
u AS (SELECT page_id, i, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN scheme || h WHEN starts_with(h, '/') THEN root || h WHEN starts_with(h, '#') OR starts_with(h, '?') THEN url || h
  ELSE CASE WHEN folder = root THEN root || '/' ELSE folder END || h END AS link FROM (SELECT *, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM f) WHERE NOT starts_with(lower(h), 'mailto:')),
d AS (SELECT page_id, link, min(i) AS i FROM u GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, link FROM d""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(X.links(F.col("html"), F.col("url"))).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query("""SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type, p_size)), lower('BRAND#1'))""")
def dbf_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyquilt.sources.dbf import search

    return search(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "BRAND#1").select("p_partkey")


@query("""WITH f AS (SELECT p_partkey, [p_name || CASE WHEN p_size % 3 = 0 THEN '.py' ELSE '.md' END, CASE WHEN p_size % 5 = 0 THEN 'sub/requirements.txt' ELSE 'README.md' END, CASE WHEN p_size % 7 = 0 THEN 'w/model.pth' ELSE 'x.txt' END] AS fs FROM part)
SELECT p_partkey, p_size % 3 = 0 AS has_source, p_size % 5 = 0 AS has_requirements, p_size % 7 = 0 AS has_weights,
  CASE WHEN p_size % 3 = 0 AND p_size % 5 = 0 AND p_size % 7 = 0 THEN 'usable' WHEN p_size % 3 = 0 THEN 'code only' ELSE 'no code' END AS verdict FROM part""")
def file_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.col("p_size") % n == 0
    files = F.array(F.concat("p_name", F.when(k(3), ".py").otherwise(".md")), F.when(k(5), "sub/requirements.txt").otherwise("README.md"), F.when(k(7), "w/model.pth").otherwise("x.txt"))
    t = table(spark, sf_dir, "part").withColumn("c", X.file_classes(files))
    return t.select("p_partkey", "c.*", X.file_verdict(F.col("c")).alias("verdict"))


@query("""WITH p AS (SELECT c_custkey, -60 - (c_custkey % 29) AS lat, (c_custkey * 7 % 360) - 180 AS lon FROM customer),
x AS (SELECT *, 2 * 1737400 * tan(radians(lat + 90) / 2) AS rho FROM p)
SELECT c_custkey, round(rho * sin(radians(lon)), 3) + 0.0 AS x, round(rho * cos(radians(lon)), 3) + 0.0 AS y, lat::DOUBLE AS lat, CASE WHEN lon = -180 THEN 180 ELSE abs(lon) END::DOUBLE AS abs_lon FROM x""")
def polar_stereo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (-60 - F.col("c_custkey") % 29).alias("lat"), (F.col("c_custkey") * 7 % 360 - 180).alias("lon")).withColumn("xy", G.south_polar_forward(F.col("lat"), F.col("lon"))).withColumn("back", G.south_polar_inverse(F.col("xy")))
    return c.select("c_custkey", (F.round("xy.x", 3) + 0.0).alias("x"), (F.round("xy.y", 3) + 0.0).alias("y"), F.round("back.lat", 6).alias("lat"), F.round(F.abs("back.lon"), 6).alias("abs_lon"))


@query("""WITH p AS (SELECT c_custkey, c_custkey % 170 - 85 AS a1, c_custkey % 350 - 175 AS o1, c_custkey * 3 % 170 - 85 AS a2, c_custkey * 11 % 350 - 175 AS o2 FROM customer),
h AS (SELECT *, sin(radians(a2 - a1) / 2) ** 2 + cos(radians(a1)) * cos(radians(a2)) * sin(radians(o2 - o1) / 2) ** 2 AS h FROM p)
SELECT c_custkey, round(2 * 1737.4 * asin(sqrt(least(h, 1))), 4) AS km FROM h""")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(G.haversine_km(k % 170 - 85, k % 350 - 175, k * 3 % 170 - 85, k * 11 % 350 - 175), 4).alias("km"))


@query("""WITH p AS (SELECT o_orderkey, o_custkey * 37 % 720 - 360 AS a, o_orderkey * 53 % 720 - 360 AS b FROM orders), d AS (SELECT *, abs(a - b) % 360 AS m, ((a % 360) + 360) % 360 AS f, ((a - b + 180) % 360 + 360) % 360 - 180 AS s FROM p)
SELECT o_orderkey, least(m, 360 - m) AS diff, CASE WHEN f > 180 THEN f - 360 ELSE f END AS folded, s AS signed FROM d""")
def angle_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_custkey") * 37 % 720 - 360, F.col("o_orderkey") * 53 % 720 - 360
    return table(spark, sf_dir, "orders").select("o_orderkey", A.angle_diff(a, b).alias("diff"), A.fold_angle(a).alias("folded"), A.signed_error(a - b).alias("signed"))


@query("""SELECT CASE WHEN regexp_matches(p_name, '(?i)^[a-f]') THEN 'OHRC' WHEN regexp_matches(p_type, '(?i)^s') THEN 'TMC2' ELSE 'IIRS' END AS instrument, count(*) AS n FROM part GROUP BY 1""")
def instrument_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("p_name").rlike("(?i)^[a-f]"), "ch2_ohr_ncp").otherwise("none")
    second = F.when(F.col("p_type").rlike("(?i)^s"), "Terrain Mapping Camera 2").otherwise("IIRS spectrometer")
    return table(spark, sf_dir, "part").groupBy(X.instrument(first, second).alias("instrument")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_size, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS item FROM part)
SELECT p_size, count(*) AS n, sum(p_size * 100 * greatest(p_size % 3, 1) * item)::BIGINT AS expected_bytes, count(*) FILTER (item = 1) AS n_bytes_typed FROM s GROUP BY p_size""")
def raster_size_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyquilt.operators.raster import expected_bytes

    kind = F.element_at(F.array(*map(F.lit, ("UnsignedByte", "SignedLSB2", "IEEE754LSBSingle", "IEEE754MSBDouble"))), (F.col("p_size") % 4 + 1).cast("int"))
    size = expected_bytes(F.col("p_size"), F.lit(100), F.col("p_size") % 3, kind)
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("expected_bytes"), F.count_if(kind == "UnsignedByte").alias("n_bytes_typed"))


@query("""SELECT CASE WHEN e > 75 THEN 'TOO-HIGH' WHEN e > 20 THEN 'HIGH-SUN' ELSE 'LOW-SUN' END AS band, count(*) AS n FROM (SELECT s_acctbal % 90 AS e FROM supplier) GROUP BY 1""")
def elevation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy(A.elevation_band(F.col("s_acctbal") % 90).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std, 1.0::DOUBLE AS finite_share FROM events GROUP BY 1""")
def value_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "value")
    q, s = scoring.quartiles(e, "value", "event_type"), scoring.value_statistics(e, "value", "event_type").drop("median")
    six = [F.round(c, 6).alias(c) for c in ("median", "iqr", "min", "max", "std")]
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(q, "event_type").join(s, "event_type").select("event_type", "n", *six, "finite_share")


@query("""SELECT count(*) AS n, round(median(l_discount * 100 - l_tax * 100), 6) AS median_dx, round(median(l_quantity - 25), 6) AS median_dy, round(median(sqrt((l_discount * 100 - l_tax * 100) ** 2 + (l_quantity - 25) ** 2)), 6) AS median_r,
  round(avg(sqrt((l_discount * 100 - l_tax * 100) ** 2 + (l_quantity - 25) ** 2)), 6) AS mean_r, round(quantile_cont(sqrt((l_discount * 100 - l_tax * 100) ** 2 + (l_quantity - 25) ** 2), 0.9), 6) AS p90_r, round(median(l_extendedprice), 6) AS median_score FROM lineitem""")
def displacement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100 - F.col("l_tax") * 100).alias("dx"), (F.col("l_quantity") - 25).alias("dy"), F.col("l_extendedprice").alias("w"))
    d = scoring.displacement(rows, "dx", "dy", "w")
    return d.select("n", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_extendedprice) AS m FROM lineitem)
SELECT count(*) AS n, round(sqrt(avg(l_extendedprice ** 2)) / 1000, 3) AS rms, round(sqrt(avg((l_extendedprice - m) ** 2)) / 1000, 3) AS rms_centred, round(sqrt(avg((l_extendedprice - a - b * l_quantity) ** 2)) / 1000, 3) AS rms_linear_x, round(corr(l_extendedprice, l_quantity), 6) AS ncc FROM lineitem, f""")
def error_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", F.lit(0.0).alias("zero"))
    s = scoring.error_structure(t.withColumn("y", F.lit(0.0)), "l_quantity", "y", "l_extendedprice").select("n", "rms", "rms_centred")
    one = t.agg(F.stddev_pop("l_extendedprice").alias("s"), F.corr("l_extendedprice", "l_quantity").alias("c"))
    both = s.crossJoin(one).crossJoin(scoring.correlation(t, "l_extendedprice", "l_quantity").select("ncc"))  # one row each
    k = lambda c: F.round(c / 1000, 3)
    return both.select("n", k(F.col("rms")).alias("rms"), k(F.col("rms_centred")).alias("rms_centred"), k(F.col("s") * F.sqrt(1 - F.col("c") * F.col("c"))).alias("rms_linear_x"), F.round("ncc", 6).alias("ncc"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1""")
def argmax_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_candidate(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "l_orderkey", "l_linenumber")


@query("""SELECT page_id, md5(html) AS md5, strlen(html) AS file_size FROM pages""")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("md5"), F.octet_length("html").cast("long").alias("file_size"))


@query("""SELECT min(event_id) AS scan0, max(event_id) AS scan1, min(user_id) AS pixel0, max(user_id) AS pixel1, count(*) AS n FROM events WHERE value BETWEEN 10 AND 60""")
def locate_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyquilt.sources.geolocation import locate

    grid = table(spark, sf_dir, "events").select(F.col("event_id").cast("double").alias("scan"), F.col("user_id").cast("double").alias("pixel"), F.col("value").alias("lon"), F.lit(5.0).alias("lat"))
    return locate(grid, G.box_ring(F.lit(10.0), F.lit(0.0), F.lit(60.0), F.lit(10.0)), boundary=True)


def label_xml(key: Column, lines: Column, name: Column, elevation: Column) -> Column:
    """A product label as text, from columns; every third has no refined corners, every fourth is a cube."""
    corner = lambda c, lat, lon: F.concat(F.lit(f"<isda:{c}_latitude>"), lat.cast("string"), F.lit(f"</isda:{c}_latitude><isda:{c}_longitude>"), lon.cast("string"), F.lit(f"</isda:{c}_longitude>"))

    def block(tag: str, shift: int) -> Column:
        lat, lon = key % 80 + shift, key % 170 + shift
        return F.concat(F.lit(f"<isda:{tag}>"), corner("upper_left", lat + 1, lon), corner("upper_right", lat + 1, lon + 2), corner("lower_left", lat, lon), corner("lower_right", lat, lon + 2), F.lit(f"</isda:{tag}>"))

    cube = key % 4 == 0
    kind = F.when(cube, "Array_3D_Spectrum").otherwise("Array_2D_Image")
    axis = lambda n, v: F.concat(F.lit(f"<Axis_Array><axis_name>{n}</axis_name><elements>"), v.cast("string"), F.lit("</elements></Axis_Array>"))
    return F.concat(
        F.lit('<?xml version="1.0"?><Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1" xmlns:isda="https://isda.issdc.gov.in/pds4/isda/v1"><Identification_Area><logical_identifier>urn:x:'), key.cast("string"),
        F.lit("</logical_identifier></Identification_Area><Observation_Area><Observing_System_Component><name>Orbiter High Resolution Camera</name></Observing_System_Component><isda:sun_elevation>"), elevation.cast("string"),
        F.lit("</isda:sun_elevation>"), block("System_Level_Coordinates", 0), F.when(key % 3 != 0, block("Refined_Corner_Coordinates", -5)).otherwise(""),
        F.lit("</Observation_Area><File_Area_Observational><File><file_name>"), name, F.lit("</file_name><file_size>"), (lines * 12000).cast("string"), F.lit("</file_size><md5_checksum>"), F.md5(name.cast("binary")), F.lit("</md5_checksum></File><"), kind, F.lit(">"),
        axis("Line", lines), axis("Sample", F.lit(12000)), F.when(cube, axis("BAND", key % 200 + 1)).otherwise(""), F.lit("</"), kind, F.lit("></File_Area_Observational></Product_Observational>"),
    )


@query("""SELECT o_orderkey, 'OHRC' AS instrument, (o_orderkey % 1000 + 1)::BIGINT AS lines, 12000::BIGINT AS samples, 'urn:x:' || o_orderkey AS logical_identifier, 'img' || o_custkey || '.img' AS file_name, round(o_totalprice, 2) AS sun_elevation_deg,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 + 1 ELSE 1 END::BIGINT AS bands, (o_orderkey % 1000 + 1) * 12000 AS file_size_bytes, md5('img' || o_custkey || '.img') AS md5_checksum,
  concat_ws(' ', k + 1, o, k + 1, o + 2, k, o + 2, k, o) AS corners FROM (SELECT *, o_orderkey % 80 - CASE WHEN o_orderkey % 3 <> 0 THEN 5 ELSE 0 END AS k, o_orderkey % 170 - CASE WHEN o_orderkey % 3 <> 0 THEN 5 ELSE 0 END AS o FROM orders) WHERE o_orderkey % 9 <> 0""")
def xml_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyquilt.sources.labels import parse

    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("img"), F.col("o_custkey").cast("string"), F.lit(".img"))
    whole = label_xml(F.col("o_orderkey"), F.col("o_orderkey") % 1000 + 1, name, F.round("o_totalprice", 2))
    broken = F.when(F.col("o_orderkey") % 9 == 0, F.concat(whole, F.lit("<oops>"))).otherwise(whole)
    got = parse(o.select("o_orderkey", F.concat(F.lit("/data/"), F.col("o_orderkey").cast("string"), F.lit("/label.xml")).alias("path"), broken.alias("xml")), keep=("o_orderkey",))
    return got.select("o_orderkey", "instrument", "lines", "samples", "logical_identifier", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.round("sun_elevation_deg", 2).alias("sun_elevation_deg"), "bands", "file_size_bytes", "md5_checksum", F.array_join(F.flatten(F.transform("footprint", lambda c: F.array(c["lat"].cast("long"), c["lon"].cast("long")))), " ").alias("corners"))


@query(f"""WITH {box_sql(*A_SUPPLIER)}, {box_sql(*B_PART)}, {pairs_sql("true")}
SELECT a_id || '__x__' || b_id AS pair_id, round(((a_x0 + a_x1) / 2.0 - b_x0) / (b_x1 - b_x0) * 199, 6) + 0.0 AS x, round((b_y1 - (a_y0 + a_y1) / 2.0) / (b_y1 - b_y0) * 199, 6) + 0.0 AS y, NULL::VARCHAR AS error FROM pairs""")
def homography_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner homographies of box pairs, and where A's centre falls in B."""
    from skyquilt.functions import transforms as T

    flat = lambda ring: F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    a, b = boxes(spark, sf_dir, *A_SUPPLIER), boxes(spark, sf_dir, *B_PART)
    met = spatial.box_candidates(spatial.shapes(a, "a"), spatial.shapes(b, "b")).where(G.box_overlap(F.col("a_box"), F.col("b_box")) > 0)
    pairs = met.select(F.struct("a_shape", "b_shape").alias("pair_id"), flat(F.col("a_ring")).alias("a_foot"), flat(F.col("b_ring")).alias("b_foot"), *[F.lit(v).alias(n) for n, v in (("a_lines", 100), ("a_samples", 100), ("b_lines", 200), ("b_samples", 200))])
    fitted = T.corner_transform(pairs.repartition(spark.sparkContext.defaultParallelism, "pair_id"))
    there = T.apply_homography(F.col("forward"), F.lit(49.5), F.lit(49.5))
    placed = fitted.select("pair_id.*", (F.round(there["x"], 6) + 0.0).alias("x"), (F.round(there["y"], 6) + 0.0).alias("y"), "error")
    return spatial.of_shapes(placed, a, b).select(X.pair_id(F.col("a_id"), F.col("b_id")).alias("pair_id"), "x", "y", "error")


@query("SELECT label AS g, vec_id AS a_id, vec_id AS b_id, 1.0::DOUBLE AS similarity FROM embeddings")
def mutual_neighbour_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of each label's points against itself scaled by 1.5: nodes find themselves."""
    a = nodes(spark, sf_dir)
    b = a.select("g", "id", (F.col("x") * 1.5).alias("x"), (F.col("y") * 1.5).alias("y"), (F.col("radius") * 1.5).alias("radius"))
    hood = lambda n: graph.neighborhoods(n, graph.knn_edges(n, 4, digits=10), 4, digits=10)
    return graph.mutual_matches(hood(a), hood(b), ratio=None).select("g", "a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT s_suppkey AS pair_id, 5 - s_suppkey % 11 AS dx, 4 - s_suppkey % 9 AS dy, 1.0::DOUBLE AS peak FROM supplier")
def phase_corr_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth fields shifted by amounts from the suppliers' ids, and the shifts found again."""
    import numpy as np
    import pandas as pd

    from skyquilt.operators import registration as R

    def make(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for k in pdf["k"]:
                a = R.smooth_field(64, int(k))
                rows.append((int(k), 64, 64, a.tobytes(), np.roll(a, (k % 9 - 4, k % 11 - 5), (0, 1)).tobytes()))
            yield pd.DataFrame(rows, columns=["pair_id", "h", "w", "a", "b"])

    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).mapInPandas(make, "pair_id long, h int, w int, a binary, b binary")
    return R.correlate_pairs(pairs, window=False).select("pair_id", "dx", "dy", F.round("peak", 0).alias("peak"))


@query()
def registration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile votes and robust fit on an injected transform."""
    from skyquilt.operators import registration as R

    g = R.gate(spark)
    return spark.createDataFrame([(round(g["rms"], 3), g["passed"], g["n_votes"], g["n_inliers"])], "rms double, passed boolean, n_votes long, n_inliers long")


@query("SELECT 1.6::DOUBLE AS sx, 0.75::DOUBLE AS sy, -22.0::DOUBLE AS theta, 2487::BIGINT AS n_eval")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anisotropic grid search, all 2,487 candidates, on an injected warp."""
    import numpy as np

    from skyquilt.operators import registration as R

    a = R.smooth_field(96, 5)
    h = np.eye(3)
    h[:2, :2] = R.linear(1.6, 0.75, -22.0)
    c = (np.array(a.shape[::-1]) - 1) / 2
    h[:2, 2] = c - h[:2, :2] @ c
    best = R.grid_search(spark, a, R.warp(a, h))
    return spark.createDataFrame([(round(best["sx"], 2), round(best["sy"], 2), round(best["theta"], 1), best["n_eval"])], "sx double, sy double, theta double, n_eval long")


@query()
def crater_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles in a synthetic product."""
    from skyquilt.operators import detection as D

    return D.detect_tiles(D.ring_tiles(spark), 5.0).select("cx", "cy", "radius", F.round("confidence", 3).alias("confidence"))
