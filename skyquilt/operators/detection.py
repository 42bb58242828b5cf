"""Crater-like circle detection on tiles: enhancement, gradient voting, validation.

The kernels are numpy re-implementations of the usual steps; they agree with other libraries in what
they look for, not bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators.raster import decode, shrink, suppress

MIN_CONFIDENCE = 0.05
#: Radius ranges in pixels by resolution: up to 1 m, up to 10 m, above.
PRESETS = ((1.0, 50, 5000), (10.0, 15, 2500), (float("inf"), 3, 50))
#: Votes that make a place a candidate; a whole rim gives about one and more.
MIN_VOTES = 0.5
#: Radii are looked for in octaves, each on an image shrunk so that they come to about this many pixels.
OCTAVE = 12
SCHEMA = "product_id string, cx double, cy double, radius double, confidence double, circularity double, mean_intensity double"


def preset(metres_per_px: float) -> tuple[int, int]:
    return next((a, b) for limit, a, b in PRESETS if metres_per_px <= limit)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    k = np.exp(-(np.arange(-int(3 * sigma) - 1, int(3 * sigma) + 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    r = len(k) // 2
    pad = np.pad(image.astype(float), r, mode="edge")
    rows = sum(w * pad[:, i : i + image.shape[1]] for i, w in enumerate(k))
    return sum(w * rows[i : i + image.shape[0]] for i, w in enumerate(k))


def extreme(image: np.ndarray, size: int, pick) -> np.ndarray:  # noqa: ANN001
    """Minimum or maximum over size x size neighbourhoods."""
    r = size // 2
    pad = np.pad(image, r, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view
    return pick(view(pick(view(pad, size, axis=1), axis=-1), size, axis=0), axis=-1)


def equalize(image: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Local histogram equalisation with clipped histograms, blended between tiles."""
    h, w = image.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    q = np.clip(image, 0, 255).astype(np.uint8)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(q[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=256).astype(float)
            top = max(clip * hist.sum() / 256, 1)
            extra = np.maximum(hist - top, 0).sum()
            cdf = np.cumsum(np.minimum(hist, top) + extra / 256)
            maps[i, j] = cdf / max(cdf[-1], 1) * 255
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(fy.astype(int), max(tiles - 2, 0)), np.minimum(fx.astype(int), max(tiles - 2, 0))
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda a, b: maps[a[:, None], b[None], q]
    return (at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy


def enhance(image: np.ndarray, size: int = 15) -> np.ndarray:
    """Bright and dark details: top hat plus bottom hat, scaled to 255."""
    opened = extreme(extreme(image, size, np.min), size, np.max)
    closed = extreme(extreme(image, size, np.max), size, np.min)
    out = (image - opened) + (closed - image)
    return out / max(out.max(), 1e-9) * 255


def circles(image: np.ndarray, r_min: int, r_max: int, least: float = MIN_VOTES) -> list[tuple[float, float, float]]:
    """(cx, cy, radius) by votes of strong gradients along their direction, then the radius that most edge points agree on; every place with ``least`` votes."""
    gy, gx = np.gradient(image)
    size = np.hypot(gx, gy)
    strong = size >= max(np.percentile(size, 90), 1e-6)
    y, x = np.nonzero(strong)
    if not len(y):
        return []
    ux, uy = gx[y, x] / size[y, x], gy[y, x] / size[y, x]
    votes = np.zeros(image.shape)
    for r in range(r_min, r_max + 1, max(1, (r_max - r_min) // 24)):
        for sign in (1, -1):
            px, py = np.rint(x + sign * r * ux).astype(int), np.rint(y + sign * r * uy).astype(int)
            ok = (px >= 0) & (py >= 0) & (px < image.shape[1]) & (py < image.shape[0])
            np.add.at(votes, (py[ok], px[ok]), 1 / r)
    votes = blur(votes, 2.0)
    cy, cx = np.nonzero((votes == extreme(votes, 2 * max(r_min // 2, 2) + 1, np.max)) & (votes >= least))
    out = []
    for i in range(len(cy)):
        d = np.hypot(x - cx[i], y - cy[i])
        hist = np.bincount(np.rint(d[(d >= r_min) & (d <= r_max)]).astype(int), minlength=r_max + 1)[r_min : r_max + 1]
        if hist.sum():
            out.append((float(cx[i]), float(cy[i]), float(r_min + np.argmax(hist / np.arange(r_min, r_max + 1)))))
    return out


def validate(image: np.ndarray, cx: float, cy: float, r: float) -> tuple[float, float, float]:
    """(confidence, circularity, mean intensity): share of the rim where brightness changes, evenly around; 0 off the image."""
    t = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    ring = lambda k: (np.rint(cx + k * r * np.cos(t)).astype(int), np.rint(cy + k * r * np.sin(t)).astype(int))
    inside = lambda p: (p[0] >= 0) & (p[1] >= 0) & (p[0] < image.shape[1]) & (p[1] < image.shape[0])
    a, b = ring(0.85), ring(1.15)
    ok = inside(a) & inside(b)
    if ok.mean() < 0.75:
        return 0.0, 0.0, 0.0
    step = np.abs(image[b[1][ok], b[0][ok]] - image[a[1][ok], a[0][ok]])
    edge = step > max(0.25 * image.std(), 1e-6)
    quarters = [edge[(t[ok] // (np.pi / 2)) == q] for q in range(4)]
    even = min((q.mean() if len(q) else 0.0) for q in quarters)
    y0, y1, x0, x1 = int(max(cy - r, 0)), int(cy + r) + 1, int(max(cx - r, 0)), int(cx + r) + 1
    return float(edge.mean() * (0.5 + 0.5 * even)), float(edge.mean()), float(image[y0:y1, x0:x1].mean())


def octaves(r_min: int, r_max: int) -> list[tuple[int, int, int]]:
    """(least radius, largest radius, shrink factor), largest first; together they cover the range."""
    out, lo = [], r_min
    while lo <= r_max:
        hi = min(r_max, 2 * lo)
        out.append((lo, hi, max(1, lo // OCTAVE)))
        lo = hi + 1
    return out[::-1]


def detect(image: np.ndarray, r_min: int, r_max: int) -> list[tuple[float, float, float, float, float, float]]:
    """(cx, cy, radius, confidence, circularity, mean) of circles above the least confidence, from coarse radii to fine ones."""
    ready = blur(equalize(image), 1.2)
    rows = []
    for lo, hi, f in octaves(r_min, r_max):
        small = ready if f == 1 else shrink(ready, (ready.shape[0] // f, ready.shape[1] // f))
        fy, fx = (a / b for a, b in zip(ready.shape, small.shape, strict=True))
        for cx, cy, r in circles(small + 0.25 * enhance(small), max(lo // f, 2), -(-hi // f)):
            conf, circ, mean = validate(small, cx, cy, r)
            if conf > MIN_CONFIDENCE:
                rows.append(((cx + 0.5) * fx - 0.5, (cy + 0.5) * fy - 0.5, r * (fx + fy) / 2, conf, circ, mean))
    return sorted(rows, key=lambda x: (-x[2], x[0], x[1]))


def detect_tiles(tiles: DataFrame, metres_per_px: float, share: float = 0.5) -> DataFrame:
    """Detections of tile rows in product coordinates, suppressed across overlapping tiles, with rank by radius."""
    import pandas as pd

    r_min, r_max = preset(metres_per_px)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                image = decode(t.dtype, t.data, t.h, t.w).astype(float)
                if min(image.shape) > 2 * r_min:
                    rows += [(t.product_id, cx + t.col0, cy + t.row0, *rest) for cx, cy, *rest in detect(image, r_min, min(r_max, min(image.shape) // 2))]
            yield pd.DataFrame(rows, columns=["product_id", "cx", "cy", "radius", "confidence", "circularity", "mean_intensity"])

    found = tiles.select("product_id", "row0", "col0", "h", "w", "dtype", "data").mapInPandas(scan, SCHEMA)
    return suppress(found, share)


def ring_tiles(spark: SparkSession, size: int = 256) -> DataFrame:
    """A synthetic product with two bright rings on a dark ground, as one tile row."""
    y, x = np.mgrid[:size, :size].astype(float)
    image = np.full((size, size), 60.0)
    for cx, cy, r in ((80.0, 90.0, 25.0), (180.0, 170.0, 35.0)):
        d = np.hypot(x - cx, y - cy)
        image[d < r] = 30
        image[np.abs(d - r) < 3] = 200
    image += np.random.default_rng(1).normal(0, 2, image.shape)
    data = np.clip(image, 0, 255).astype(np.uint8)
    from skyquilt.operators.raster import TILE_SCHEMA

    return spark.createDataFrame([("ring", 0, 0, 0, size, size, "|u1", bytearray(data.tobytes()))], TILE_SCHEMA)


def best(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("confidence"), "cx", "cy")
