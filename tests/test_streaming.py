from skyquilt.streaming.labels import label_stream, write_products

from test_sources import label


def test_labels_are_parsed_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.xml").write_text(label("ch2_ohr_a.img"))
    (src / "a_brw.xml").write_text("<x/>")
    write_products(label_stream(spark, str(src)), out, cp).awaitTermination()
    (src / "b.xml").write_text(label("ch2_tmc_b.img", "Terrain Mapping Camera 2"))
    write_products(label_stream(spark, str(src)), out, cp).awaitTermination()
    assert sorted(r.product_id for r in spark.read.parquet(out).collect()) == ["ch2_ohr_a", "ch2_tmc_b"]
