import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.functions import geometry as G
from skyquilt.plans import manifest as plan
from skyquilt.sources import craters, dbf, geolocation, labels, manifest, shapefile


def axes(*pairs):
    return "".join(f"<Axis_Array><axis_name>{n}</axis_name><elements>{v}</elements></Axis_Array>" for n, v in pairs)


def corner_block(tag, lat0, lat1, lon0, lon1, drop=""):
    pts = {"upper_left": (lat1, lon0), "upper_right": (lat1, lon1), "lower_left": (lat0, lon0), "lower_right": (lat0, lon1)}
    body = "".join(f"<isda:{k}_latitude>{a}</isda:{k}_latitude><isda:{k}_longitude>{b}</isda:{k}_longitude>" for k, (a, b) in pts.items() if k != drop)
    return f"<isda:{tag}>{body}</isda:{tag}>"


def label(name="ch2_ohr_x_d_img_d18.img", component="Orbiter High Resolution Camera", dims=axes(("Line", 100), ("Sample", 50)), array="Array_2D_Image", blocks="", extra=""):
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1" xmlns:isda="https://isda.issdc.gov.in/pds4/isda/v1">'
        f"<Identification_Area><logical_identifier>urn:isro:{name}</logical_identifier></Identification_Area><Observing_System_Component><name>{component}</name></Observing_System_Component>{extra}{blocks}"
        f"<File_Area_Observational><File><file_name>{name}</file_name></File><{array}>{dims}<Element_Array><data_type>UnsignedByte</data_type></Element_Array></{array}></File_Area_Observational></Product_Observational>"
    )


def parse(spark, *texts):
    return labels.parse(spark.createDataFrame([(f"/d/{i}.xml", t) for i, t in enumerate(texts)], "path string, xml string"))


def test_label_fields(spark):
    r = parse(spark, label(blocks=corner_block("Refined_Corner_Coordinates", -20, -18, 30, 32))).first()
    assert (r.instrument, r.lines, r.samples, r.datatype, r.bands, r.file_path) == ("OHRC", 100, 50, "UnsignedByte", 1, "/d/ch2_ohr_x_d_img_d18.img")
    assert [tuple(c) for c in r.footprint] == [(-18, 30), (-18, 32), (-20, 32), (-20, 30)]


def test_refined_corners_win(spark):
    both = corner_block("System_Level_Coordinates", 0, 1, 0, 1) + corner_block("Refined_Corner_Coordinates", 5, 6, 5, 6)
    broken = corner_block("System_Level_Coordinates", 0, 1, 0, 1) + corner_block("Refined_Corner_Coordinates", 5, 6, 5, 6, "upper_left")
    got = parse(spark, label(blocks=both), label(blocks=corner_block("System_Level_Coordinates", 0, 1, 0, 1)), label(blocks=broken), label()).orderBy("label_path").collect()
    assert [r.footprint[0].lat if r.footprint else None for r in got] == [6.0, 1.0, None, None]


def test_bad_labels_give_no_row(spark):
    texts = ["<oops", "", "plain text", label() + "<more>", label() + label()[38:], "<Other/>", label(dims=axes(("Line", 1))), label(component="unknown", name="thing.img")]
    assert parse(spark, *texts, None).count() == 0


def test_cube_and_instrument(spark):
    r = parse(spark, label("ch2_iir_cube.qub", "Imaging Infrared Spectrometer", axes(("BAND", 256), ("LINE", 1250), ("Sample", 250)), "Array_3D_Spectrum")).first()
    assert (r.instrument, r.bands, r.lines, r.samples) == ("IIRS", 256, 1250, 250)


def test_manifest_of_a_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    big, small = corner_block("Refined_Corner_Coordinates", -30, 0, 140, 143), corner_block("Refined_Corner_Coordinates", -5, -4, 141, 142)
    (tmp_path / "sub" / "a.xml").write_text(label("ch2_ohr_a.img", blocks=small))
    (tmp_path / "b.xml").write_text(label("ch2_tmc_b.img", "Terrain Mapping Camera 2", blocks=big))
    (tmp_path / "c_brw.xml").write_text("<x/>")
    (tmp_path / "d.xml").write_text("<broken")
    doc = plan.build(spark, str(tmp_path))
    r = doc.first()
    assert r.counts.n_products == 2 and r.counts.n_pairs == 1 and r.pairs[0].pct_smaller == 100.0 and r.pairs[0].method == "corner_homography"
    assert sorted(s.reason for s in r.skipped) == ["auxiliary label", "not a usable label"] and r.products["ch2_ohr_a"].pairing_eligible
    manifest.write_document(doc, str(tmp_path / "out"))
    assert manifest.pair_at(manifest.read_document(spark, str(tmp_path / "out"))).first().pair_id == "ch2_ohr_a__x__ch2_tmc_b"


def test_companions(spark):
    p = spark.createDataFrame([("/r/a/b/x_d_img_1.xml",), ("/r/c/y_d_img_2.xml",), ("/q/z_d_img_3.xml",)], "label_path string")
    files = spark.createDataFrame([("/r/a/geometry/x_g_grd_1.csv",), ("/r/a/geometry/o_g_grd_9.csv",), ("/r/geometry/k_g_grd_5.csv",), ("/q/geometry/a_g_grd_1.csv",), ("/q/geometry/b_g_grd_2.csv",)], "path string")
    got = {r.label_path: r.geometry_csv_path for r in labels.companions(p, files).collect()}
    assert got == {"/r/a/b/x_d_img_1.xml": "/r/a/geometry/x_g_grd_1.csv", "/r/c/y_d_img_2.xml": "/r/geometry/k_g_grd_5.csv", "/q/z_d_img_3.xml": None}


def grid_file(path):
    rows = ["Longitude,Latitude,Pixel,Scan"] + [f"{20 + 0.01 * p + 0.002 * s},{-10 - 0.01 * s},{p},{s}" for s in range(0, 201, 5) for p in range(0, 101, 5)]
    path.write_text("\n".join([*rows, "garbage", "", "1,2,x,4"]) + "\n")


def test_grid(spark, tmp_path):
    grid_file(tmp_path / "g.csv")
    g = geolocation.read_grid(spark, str(tmp_path))
    assert g.count() == 861
    ring = G.box_ring(F.lit(20.2), F.lit(-10.5), F.lit(20.4), F.lit(-10.2))
    r = geolocation.locate(g, ring, boundary=True).first()
    assert 15 <= r.scan0 <= r.scan1 <= 55 and 10 <= r.pixel0 <= r.pixel1 <= 45
    with pytest.raises(Exception, match="no grid point"):
        geolocation.locate(g, G.box_ring(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).collect()
    fit = geolocation.fit_windows(g.where(geolocation.in_window(15, 55, 10, 45))).first()
    h, back = np.reshape(fit.to_lonlat, (3, 3)), np.reshape(fit.to_pixel, (3, 3))
    lon, lat, w = h @ [20, 30, 1]
    x, y, v = back @ [lon / w, lat / w, 1]
    assert lon / w == pytest.approx(20.26, abs=1e-6) and x / v == pytest.approx(20, abs=1e-3) and y / v == pytest.approx(30, abs=1e-3)
    assert "needed" in geolocation.fit_windows(g.limit(10)).first().error


def test_craters(spark, tmp_path):
    rows = "﻿Longitude,Latitude,Diameter_km,Depth_km,Name\n25.1,-13,2.0,0.2,A\n25.2,-13.2,0.5,,B\n25.4,-12.9,3,0.1,C\n10,10,5,,D\n80,0,1.0,,E\nbad,0,1,,F\n"
    (tmp_path / "c.csv").write_text(rows, encoding="utf-8")
    path = str(tmp_path / "c.csv")
    assert craters.read_csv(spark, path).count() == 5 and craters.read_csv(spark, path, min_km=1.0).count() == 4
    craters.read_csv(spark, path).write.parquet(str(tmp_path / "p"))
    assert craters.read_parquet(spark, str(tmp_path / "p"), 1.0, 3.0).count() == 3
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        craters.read_csv(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="no column"):
        craters.resolve(["Center Latitude", "Center Longitude", "Diameter"])
    assert craters.resolve(["Center Latitude", "Center Longitude", "Diameter"], strict=True)["latitude_deg"] == "Center Latitude"
    made = craters.synthetic(spark, 500, (-10, 0), (20, 30)).collect()
    d = [r.diameter_km for r in made]
    assert len(d) == 500 and d == sorted(d, reverse=True) and 1 <= min(d) and sum(x < 2 for x in d) > 300


def make_dbf(rows, names=(("PRODUCT_ID", "C", 12), ("UL_LAT", "N", 8), ("DOP", "D", 8))):
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(names) + 1, 1 + sum(n[2] for n in names))
    fields = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([w, 0]) + bytes(14) for n, t, w in names) + b"\r"
    return head + fields + b"".join((b"*" if gone else b" ") + b"".join(v.encode().ljust(n[2]) for v, n in zip(vals, names, strict=True)) for gone, vals in rows)


def make_shp(boxes):
    out = b"\0" * 100
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        pts = [(x0, y1), (x1, y1), (x1, y0), (x0, y0), (x0, y1)]
        body = struct.pack("<i4d2ii", 5, x0, y0, x1, y1, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        out += struct.pack(">2i", i + 1, len(body) // 2) + body
    return out


def test_dbf_and_shapefile(spark, tmp_path):
    rows = [(False, ("one", "1.5", "00000000")), (True, ("gone", "2", "")), (False, ("two", "3", "20200101"))]
    (tmp_path / "t.dbf").write_bytes(make_dbf(rows) + b"")
    (tmp_path / "t.shp").write_bytes(make_shp([(140.0, -33.0, 142.0, -31.0), (0.0, 0.0, 1.0, 1.0)]))
    assert [r.fields["PRODUCT_ID"] for r in dbf.read_dbf(spark, str(tmp_path)).orderBy("row_index").collect()] == ["one", "two"]
    assert list(dbf.records(make_dbf(rows)[:-5])) == list(dbf.records(make_dbf(rows)))[:1]
    cat = shapefile.read_catalog(spark, str(tmp_path))
    assert "DOP" not in cat.columns
    r = cat.orderBy("row_index").first()
    assert (r.PRODUCT_ID, r.UL_LAT, r.geometry_bounds.x0, len(r.geometry)) == ("one", "1.5", 140.0, 4)
    assert dbf.search(spark.createDataFrame([("Abc", 1), ("x", 2)], "a string, b int"), "bC 1").count() == 1


def test_catalogs_are_found_by_name(spark, tmp_path):
    for name in ("a/ch2_ohr_cal_1.shp", "a/b/ch2_ohr_cal_0.shp", "a/ch2_tmc_cal_1.shp", "a/ch2_ohr_raw.shp", "a/ch2_ohr_cal_1.dbf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = [r.path.rsplit("/", 1)[1] for r in shapefile.discover_catalogs(spark, str(tmp_path), "OHRC").collect()]
    assert sorted(got) == ["ch2_ohr_cal_0.shp", "ch2_ohr_cal_1.shp"]
    with pytest.raises(ValueError, match="unsupported"):
        shapefile.discover_catalogs(spark, str(tmp_path), "IIRS")
