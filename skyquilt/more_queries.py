"""Registered queries of geometry repair, transforms, verdicts, rasters and neighbourhoods, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions import angles as A
from skyquilt.functions import geometry as G
from skyquilt.functions import text as X
from skyquilt.functions import transforms as T
from skyquilt.operators import catalog, graph, ranking, raster, scoring
from skyquilt.queries import NODES_SQL, nodes, query, table


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 50 + 1)::DOUBLE AS w, (p_size + 1)::DOUBLE AS h, p_partkey % 4 AS kind FROM part)
SELECT p_partkey, kind <> 3 AS usable, CASE kind WHEN 0 THEN w * h WHEN 1 THEN round(2 * w * h / 3, 6) WHEN 2 THEN round(w * h / 4, 6) END AS area FROM p""")
def footprint_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, uneven and even bow ties, and rings without area."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50 + 1).alias("w"), (F.col("p_size") + 1).alias("h"), (F.col("p_partkey") % 4).alias("kind"))
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    ring = lambda *xy: F.array(*[G.point(x, y) for x, y in xy])
    shape = F.when(F.col("kind") == 0, ring((zero, h), (w, h), (w, zero), (zero, zero))).when(F.col("kind") == 1, ring((zero, zero), (w, h), (w, zero), (zero, 2 * h)))
    shape = shape.when(F.col("kind") == 2, ring((zero, zero), (w, h), (w, zero), (zero, h))).otherwise(ring((zero, zero), (w, h), (2 * w, 2 * h), (3 * w, 3 * h)))
    fixed = G.repaired(shape)
    return p.select("p_partkey", fixed.isNotNull().alias("usable"), F.round(G.area(fixed), 6).alias("area"))


@query("""WITH c AS (SELECT c_custkey, (c_custkey * 7 % 360) AS l, c_custkey % 3 AS a, c_custkey % 2 AS b FROM customer), u AS (SELECT *, (l + 3) % 360 AS r FROM c)
SELECT c_custkey, CASE WHEN abs(r - l) >= 180 THEN CASE WHEN r < 180 THEN r + 360 ELSE r END - CASE WHEN l < 180 THEN l + 360 ELSE l END ELSE r - l END::DOUBLE AS span,
  CASE WHEN a = 0 AND b = 0 THEN 'NONE' ELSE 'MIRRORED' END AS verdict, CASE WHEN a = b THEN 'NONE' ELSE 'MIRRORED' END AS predicted FROM u""")
def mirror_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 360).alias("l"), (F.col("c_custkey") % 3).alias("a"), (F.col("c_custkey") % 2).alias("b"))
    lons = G.unwrapped(F.array(F.col("l").cast("double"), ((F.col("l") + 3) % 360).cast("double")))
    limb = lambda k, odd: F.when(F.col(k) == 0, F.lit(" Ascending")).when(F.col(k) == 1, F.lit("DESCENDING ")).otherwise(F.lit(odd))
    return c.select("c_custkey", (lons[1] - lons[0]).alias("span"), A.mirror_verdict(F.col("a") == 0, F.col("b") == 0).alias("verdict"), A.mirror_prediction(limb("a", "unknown"), F.lower(limb("b", "none"))).alias("predicted"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 120 - 10 AS x, o_custkey % 110 - 5 AS y, o_orderkey % 21 / 20.0 AS f, 0.9 + (o_custkey % 21) / 100.0 AS wr, 0.85 + (o_orderkey % 31) / 100.0 AS lr FROM orders),
v AS (SELECT *, x >= 0 AND x + 10 <= 100 AND y >= 0 AND y + 10 <= 100 AS inside FROM o)
SELECT o_orderkey, inside, CASE WHEN inside AND f >= 0.95 AND wr BETWEEN 0.95 AND 1.05 AND lr BETWEEN 0.95 AND 1.05 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verdict,
  CASE WHEN wr BETWEEN 0.9 AND 1.1 AND lr BETWEEN 0.9 AND 1.1 AND f > 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS strip,
  concat_ws('; ', CASE WHEN NOT (wr BETWEEN 0.9 AND 1.1 AND lr BETWEEN 0.9 AND 1.1) THEN 'corner-quad extent inconsistent with strip dimensions' END, CASE WHEN f <= 0 THEN 'no intersection with TMC raster' END, CASE WHEN x <= 0 THEN 'corner quad does not intersect the OHRC footprint' END) AS reasons FROM v""")
def containment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 120 - 10).alias("x"), (F.col("o_custkey") % 110 - 5).alias("y"), (F.col("o_orderkey") % 21 / 20.0).alias("f"), F.round(0.9 + (F.col("o_custkey") % 21) / 100.0, 2).alias("wr"), F.round(0.85 + (F.col("o_orderkey") % 31) / 100.0, 2).alias("lr"))
    x, y = F.col("x"), F.col("y")
    corners = F.array(*[G.point(a, b) for a, b in ((x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10))])
    o = o.withColumn("inside", G.inside_raster(corners, F.lit(100), F.lit(100))).withColumn("s", ranking.strip_verdict(F.col("lr"), F.col("wr"), F.col("f"), x))
    return o.select("o_orderkey", "inside", ranking.containment_verdict(F.col("inside"), F.col("f"), F.lit(1.0), F.col("wr"), F.col("lr")).alias("verdict"), F.col("s.verdict").alias("strip"), F.array_join("s.reasons", "; ").alias("reasons"))


@query("""SELECT o_orderkey, (o_orderkey * 37 % 90000)::BIGINT AS dt_sec, o_custkey % 12 AS craters FROM orders WHERE o_orderkey * 37 % 90000 < 21600 AND o_custkey % 12 >= 3 ORDER BY craters DESC, o_orderkey LIMIT 40""")
def near_pass_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty pairs with most craters taken within six hours."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 90000).cast("long").alias("dt_sec"), (F.col("o_custkey") % 12).alias("craters"))
    return ranking.near_pass(o, "o_orderkey")


@query("""WITH e AS (SELECT event_id, epoch_us(ts) / 86400000000.0 + 2440587.5 AS jd, user_id % 180 - 90 AS lat, event_id % 360 AS lon FROM events),
s AS (SELECT *, ((123.0 + (jd - 2460000.5) * (360.0::DOUBLE / 29.530588853)) % 360 + 360) % 360 AS sub FROM e)
SELECT event_id, round(jd, 5) AS jd, round(sub, 3) AS sub, round(degrees(asin(greatest(-1, least(1, cos(radians(lat)) * cos(radians(lon - sub)))))), 3) + 0.0 AS elevation FROM s""")
def subsolar_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", A.julian_date(F.col("ts")).alias("jd"), (F.col("user_id") % 180 - 90).alias("lat"), (F.col("event_id") % 360).alias("lon"))
    e = e.withColumn("sub", A.subsolar_longitude(F.col("jd"), F.lit(2460000.5), F.lit(123.0)))
    return e.select("event_id", F.round("jd", 5).alias("jd"), F.round("sub", 3).alias("sub"), (F.round(A.sun_elevation(F.col("lat"), F.col("lon"), F.lit(0.0), F.col("sub")), 3) + 0.0).alias("elevation"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 5 <> 0 AS is_local, (c_custkey % 170 - 85)::DOUBLE AS lat, (c_custkey % 350 - 175)::DOUBLE AS lon, (c_custkey % 40 + 1) / 4.0 AS km FROM customer)
SELECT c_custkey, is_local, round(CASE WHEN is_local THEN 3 * lon + 0.5 * lat + 700 - 64 ELSE (10 * lon + 2000) / (0.001 * lat + 2) END, 6) AS x,
  round(CASE WHEN is_local THEN -2 * lat + 300 - 128 ELSE (-8 * lat + 900) / (0.001 * lat + 2) END, 6) AS y, round(km * 500 / 6.25, 6) AS radius_px FROM c""")
def crater_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Craters on a crop where it has a matrix of its own, else on the whole image."""
    from skyquilt.sources import craters

    k = F.col("c_custkey")
    matrix = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    c = table(spark, sf_dir, "customer").select("c_custkey", (k % 170 - 85).cast("double").alias("latitude_deg"), (k % 350 - 175).cast("double").alias("longitude_deg"), ((k % 40 + 1) / 4).alias("diameter_km"), F.when(k % 5 != 0, matrix(3, 0.5, 700, 0, -2, 300, 0, 0, 1)).alias("local"), matrix(10, 0, 2000, 0, -8, 900, 0, 0.001, 2).alias("corner"))
    on = craters.on_crop(c, "local", "corner", 6.25, 128, 64)
    return on.select("c_custkey", "is_local", *[F.round(n, 6).alias(n) for n in ("x", "y", "radius_px")])


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 60 - 30)::DOUBLE AS th, 0.5 + (p_size % 16) / 10.0 AS sx, 2.0 - (p_size % 16) / 10.0 AS sy, (p_partkey % 11)::DOUBLE AS tx, (p_partkey % 7)::DOUBLE AS ty FROM part),
q AS (SELECT *, cos(radians(th)) * sx * (20 - 50) + sin(radians(th)) * sy * (70 - 40) + tx AS mx, -sin(radians(th)) * sx * (20 - 50) + cos(radians(th)) * sy * (70 - 40) + ty AS my FROM p)
SELECT p_partkey, round(mx + 50, 6) AS x, round(my + 40, 6) AS y, round((mx + 50) * 4, 6) AS x_full, round((my + 40) * 2, 6) AS y_full, greatest(10 / (p_partkey % 20 + 1), 1.0)::DOUBLE AS factor FROM q""")
def affine_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-parameter models about a centre, taken back to full resolution."""
    k, s = F.col("p_partkey"), F.col("p_size") % 16 / 10.0
    h = T.centred(T.model_matrix((k % 11).cast("double"), (k % 7).cast("double"), 0.5 + s, 2.0 - s, (k % 60 - 30).cast("double"), clockwise=True), F.lit(50.0), F.lit(40.0))

    def points(m):  # noqa: ANN001, ANN202 - the matrix is evaluated once
        full = T.original_homography(m, F.lit(0.5), F.lit(0.25), F.lit(4.0), F.lit(2.0))
        there = F.transform(F.array(full), lambda f: T.apply_homography(f, F.lit(20.0 * 0.5), F.lit(70.0 * 0.25)))
        return F.struct(T.apply_homography(m, F.lit(20.0), F.lit(70.0)).alias("at"), F.get(there, 0).alias("there"))

    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(F.array(h), points)).alias("e")).select("p_partkey", "e.at", "e.there")
    return p.select("p_partkey", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"), F.round("there.x", 6).alias("x_full"), F.round("there.y", 6).alias("y_full"), T.downsample_factor(k % 20 + 1, F.lit(10.0)).alias("factor"))


@query("""WITH m AS (SELECT avg(l_extendedprice * l_quantity) - avg(l_extendedprice) * avg(l_quantity) AS exq, avg(l_extendedprice * l_discount) - avg(l_extendedprice) * avg(l_discount) AS exd, var_pop(l_quantity) AS vq, var_pop(l_discount) AS vd, covar_pop(l_quantity, l_discount) AS cqd, var_pop(l_extendedprice) AS ve, count(*) AS n FROM lineitem)
SELECT n, round(sqrt(ve - (exq * exq * vd - 2 * cqd * exq * exd + exd * exd * vq) / (vq * vd - cqd * cqd)) / 1000, 3) AS rms_plane FROM m""")
def plane_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.error_structure(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), "l_quantity", "l_discount", "l_extendedprice")
    return s.select("n", F.round(F.col("rms_linear") / 1000, 3).alias("rms_plane"))


PIXELS_SQL = "px AS (SELECT (event_id // 3000)::VARCHAR AS product_id, 1 AS band, event_id % 3000 // 60 AS y, event_id % 60 AS x, CASE WHEN event_id % 97 <> 0 THEN value END AS v FROM events)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of pixels, 60 wide and 50 high."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.floor(k / 3000).cast("string").alias("product_id"), F.lit(1).alias("band"), F.floor(k % 3000 / 60).alias("y"), (k % 60).alias("x"), F.when(k % 97 != 0, F.col("value")).alias("value"))


@query(f"""WITH {PIXELS_SQL} SELECT product_id, y // 7 AS y, x // 7 AS x, round(avg(v), 6) AS value FROM px GROUP BY product_id, band, y // 7, x // 7 HAVING count(*) = 49""")
def area_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_means(pixels(spark, sf_dir), 7).select("product_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("value", 6).alias("value"))


@query(f"""WITH {PIXELS_SQL}, l AS (SELECT product_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM px GROUP BY 1)
SELECT product_id, CASE WHEN v IS NULL OR hi <= lo THEN 128 ELSE floor(greatest(0, least(1, (v - lo) / (hi - lo))) * 255) END::INT AS shade, count(*) AS n FROM px JOIN l USING (product_id) GROUP BY 1, 2""")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.join(raster.stretch_limits(p), "product_id").groupBy("product_id", raster.stretch(F.col("value"), F.col("lo"), F.col("hi")).alias("shade")).agg(F.count("*").alias("n"))


@query(f"""WITH {PIXELS_SQL} SELECT product_id, (event_row * 60 + x)::BIGINT AS at, rank FROM (SELECT product_id, y AS event_row, x, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(v, -1) DESC, x, y) AS rank FROM px)""")
def radius_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).select("product_id", F.coalesce("value", F.lit(-1.0)).alias("radius"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return raster.largest_first(p).select("product_id", (F.col("cy") * 60 + F.col("cx")).cast("long").alias("at"), "rank")


@query("""WITH f AS (SELECT s_suppkey, s_suppkey % 80 AS lat, s_suppkey * 3 % 170 AS lon FROM supplier), h AS (SELECT s_suppkey,
  cos(radians(lat + 1)) ** 2 * sin(radians(2) / 2) ** 2 AS w, sin(radians(1) / 2) ** 2 AS l, sin(radians(1) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat + 1)) * sin(radians(2) / 2) ** 2 AS d FROM f)
SELECT s_suppkey, round(2 * 1737.4 * asin(sqrt(w)), 6) AS width_km, round(2 * 1737.4 * asin(sqrt(l)), 6) AS length_km, round(2 * 1737.4 * asin(sqrt(d)), 6) AS diagonal_km FROM h""")
def quad_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("s_suppkey") % 80, F.col("s_suppkey") * 3 % 170
    box = F.struct(lon.cast("double").alias("x0"), lat.cast("double").alias("y0"), (lon + 2).cast("double").alias("x1"), (lat + 1).cast("double").alias("y1"))
    e = table(spark, sf_dir, "supplier").select("s_suppkey", G.quad_extents(catalog.bounds_footprint(box)).alias("e"))
    return e.select("s_suppkey", *[F.round(f"e.{n}", 6).alias(n) for n in ("width_km", "length_km", "diagonal_km")])


@query("""WITH o AS (SELECT o_custkey % 500 AS crop, o_orderkey % 4096 - 100.0 AS x, o_orderkey * 7 % 3000 - 50.5 AS y FROM orders),
w AS (SELECT crop, greatest(floor(min(y)) - 8, 0)::BIGINT AS row0, least(ceil(max(y)) + 8, 2800)::BIGINT AS row1, greatest(floor(min(x)) - 8, 0)::BIGINT AS col0, least(ceil(max(x)) + 8, 3900)::BIGINT AS col1 FROM o GROUP BY 1)
SELECT crop, CASE WHEN row1 > row0 AND col1 > col0 THEN row0 END AS row0, CASE WHEN row1 > row0 AND col1 > col0 THEN row1 END AS row1, CASE WHEN row1 > row0 AND col1 > col0 THEN col0 END AS col0, CASE WHEN row1 > row0 AND col1 > col0 THEN col1 END AS col1 FROM w""")
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("crop"), (F.col("o_orderkey") % 4096 - 100.0).alias("x"), (F.col("o_orderkey") * 7 % 3000 - 50.5).alias("y"))
    w = o.groupBy("crop").agg(T.crop_window(F.col("x"), F.col("y"), 8, F.lit(2800), F.lit(3900)).alias("w"))
    return w.select("crop", "w.row0", "w.row1", "w.col0", "w.col1")


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' nan ' WHEN 1 THEN '' ELSE '  ' || c_name || ' ' END AS product_id, CASE c_custkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '95.5' ELSE ' ' || (c_custkey % 80) || '.25 ' END AS lat, CASE c_custkey % 7 WHEN 0 THEN '1e1' ELSE (c_custkey % 170)::VARCHAR END AS lon, CASE c_custkey % 4 WHEN 0 THEN '2.5' WHEN 1 THEN 'x' ELSE '7' END AS orb FROM customer),
v AS (SELECT *, try_cast(trim(lat) AS DOUBLE) AS la, try_cast(lon AS DOUBLE) AS lo FROM c)
SELECT trim(product_id) AS product_id, la AS ul_lat, lo AS ul_lon, CASE orb WHEN '2.5' THEN 2 WHEN '7' THEN 7 END::BIGINT AS orbit, 'OHRC' AS instrument FROM v WHERE c_custkey % 5 > 1 AND la BETWEEN -90 AND 90""")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of messy texts as products."""
    k = F.col("c_custkey")
    lat = F.when(k % 6 == 0, "n/a").when(k % 6 == 1, "95.5").otherwise(F.concat(F.lit(" "), (k % 80).cast("string"), F.lit(".25 ")))
    lon = F.when(k % 7 == 0, "1e1").otherwise((k % 170).cast("string"))
    corners = {f"{c.upper()}_{a}": v for c in catalog.CORNERS for a, v in (("LAT", lat), ("LON", lon))}
    name = F.when(k % 5 == 0, " nan ").when(k % 5 == 1, "").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
    raw = table(spark, sf_dir, "customer").select(k.alias("row_index"), name.alias("Product_ID"), F.when(k % 4 == 0, "2.5").when(k % 4 == 1, "x").otherwise("7").alias("IM_ORB_NUM"), *[v.alias(n) for n, v in corners.items()])
    p = catalog.rows_to_products(raw, "OHRC")
    return p.select("product_id", F.col("footprint")[0]["lat"].alias("ul_lat"), F.col("footprint")[0]["lon"].alias("ul_lon"), F.col("imaging_orbit_number").alias("orbit"), "instrument")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'aft' WHEN 1 THEN 'fore' WHEN 2 THEN 'nadir' END AS variant, replace(replace(lower(p_type), ' ', '_'), '-', '_') || '_km' AS header FROM part""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, "aFnx")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.view_variant(F.concat(F.lit("ch2_tmc_nc"), letter, F.lit("_2020"))).alias("variant"), X.header(F.concat(F.lit(" "), F.col("p_type"), F.lit(" (KM)"))).alias("header"))


@query(f"""WITH {NODES_SQL}, near AS (SELECT a.g, a.id AS p, b.id AS q, row_number() OVER (PARTITION BY a.g, a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS nth FROM nodes a JOIN nodes b ON a.g = b.g AND a.id <> b.id),
e AS (SELECT DISTINCT g, least(p, q) AS a, greatest(p, q) AS b FROM near WHERE nth <= 4), both_ AS (SELECT g, a AS id, b AS nb FROM e UNION ALL SELECT g, b, a FROM e),
d AS (SELECT t.g, t.id, t.nb, sqrt((n.x - m.x) ** 2 + (n.y - m.y) ** 2) AS dist, least(n.radius, m.radius) / greatest(n.radius, m.radius) AS r FROM both_ t JOIN nodes n ON n.g = t.g AND n.id = t.id JOIN nodes m ON m.g = t.g AND m.id = t.nb),
o AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY dist, nb) AS nth FROM d), k AS (SELECT g, id, count(*) AS n, median(dist) AS med, sum(dist) AS s, sum(r) AS sizes, arg_min(nb, nth) AS first FROM o WHERE nth <= 4 GROUP BY 1, 2)
SELECT g, id, n, first, round(CASE WHEN med > 0 THEN s / med ELSE n END + 3.0 * (4 - n), 4) AS ratios, round(sizes, 4) AS sizes FROM k""")
def node_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhoods of all nodes, padded to four, as sums."""
    n = nodes(spark, sf_dir)
    hood = graph.neighborhoods(n, graph.knn_edges(n, 4), 4)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return hood.select("g", "id", F.size(F.filter("ids", lambda i: i != -1)).cast("long").alias("n"), F.col("ids")[0].alias("first"), F.round(total("dist_ratio"), 4).alias("ratios"), F.round(total("size_ratio"), 4).alias("sizes"))
