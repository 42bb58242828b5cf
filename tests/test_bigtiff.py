import struct

import numpy as np
import pytest

from skyquilt.functions import transforms as T
from skyquilt.operators import raster as R
from skyquilt.sources import bigtiff as B


def make(path, image, order="<"):
    h, w = image.shape
    data_at = 16
    row = w * image.dtype.itemsize
    offsets = struct.pack(f"{order}{h}Q", *[data_at + i * row for i in range(h)])
    at = data_at + h * row
    scale, tie = struct.pack(f"{order}3d", 2.0, 2.0, 0.0), struct.pack(f"{order}6d", 0, 0, 0, 1000.0, 5000.0, 0)
    keys = struct.pack(f"{order}12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 34736, 1, 0)
    doubles, text = struct.pack(f"{order}2d", 7.5, 8.5), b"polar|\0"
    extra, places = b"", {}
    for tag, raw in ((273, offsets), (33550, scale), (33922, tie), (34735, keys), (34736, doubles)):
        places[tag] = at + len(extra)
        extra += raw
    ifd = at + len(extra)
    inline = lambda tag, kind, code, v: struct.pack(f"{order}HHQ", tag, kind, 1) + struct.pack(f"{order}{code}", v).ljust(8, b"\0")
    far = lambda tag, kind, n: struct.pack(f"{order}HHQQ", tag, kind, n, places[tag])
    entries = [inline(256, 4, "I", w), inline(257, 4, "I", h), inline(258, 3, "H", 8 * image.dtype.itemsize), far(273, 16, h), inline(278, 4, "I", 1), far(33550, 12, 3), far(33922, 12, 6), far(34735, 3, 12), far(34736, 12, 2), struct.pack(f"{order}HHQ", 34737, 2, len(text)) + text.ljust(8, b"\0")]
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HHHQ", 43, 8, 0, ifd)
    path.write_bytes(head + image.astype(image.dtype.newbyteorder(order)).tobytes() + extra + struct.pack(f"{order}Q", len(entries)) + b"".join(entries) + bytes(8))


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags_keys_and_window(spark, tmp_path, order):
    image = np.arange(40 * 30, dtype=np.uint16).reshape(40, 30)
    make(tmp_path / "t.tif", image, order)
    path = str(tmp_path / "t.tif")
    tags = B.read_tags(path)
    assert (tags[256], tags[257], tags[34737]) == ((30,), (40,), "polar|") and B.geo_keys(tags) == {1024: 1, 3072: 7.5}
    assert [float(v) for v in B.pixel_to_map(tags, 0, 0)] == [1001.0, 4999.0]
    got = R.pixels(B.read_strips(spark, path=path, product_id="t", row0=5, row1=35, col0=3, col1=13, lines_per_tile=8)).toPandas().pivot(index="y", columns="x", values="value").to_numpy()
    assert (got == image[5:35, 3:13]).all()


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"II*\0" + bytes(30))
    with pytest.raises(ValueError, match="BigTIFF"):
        B.read_tags(str(tmp_path / "x.tif"))


def test_affine_chain_and_frame():
    h = np.array([[2.0, 0.5, 3], [-0.5, 2, 1], [0, 0, 1]])
    grid = np.random.default_rng(0).random((20, 2)) * 50
    got, left = T.chain_prior(h, lambda p: p * 10, lambda p: p / 5 + 1, grid)
    assert np.allclose(T.project(got, grid), T.project(h, grid) * 2 + 1) and left.max() < 1e-9
    f = T.strip_frame(np.array([1.0, 2.0]), np.array([1.0, 0.0]))
    assert np.allclose(f @ f.T, np.eye(2))
