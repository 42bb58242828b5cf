"""Homographies and affine models: applied as Columns, solved in numpy.

A matrix is ``array<double>`` of nine values, row by row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(F.try_divide(h[0] * x + h[1] * y + h[2], w).alias("x"), F.try_divide(h[3] * x + h[4] * y + h[5], w).alias("y"))


def matmul(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def scaling(fx: Column, fy: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(fx.cast("double"), zero, zero, zero, fy.cast("double"), zero, zero, zero, one)


def original_homography(h: Column, fx_a: Column, fy_a: Column, fx_b: Column, fy_b: Column) -> Column:
    """A homography between scaled images as one between the originals: undo A's scale, redo B's."""
    return matmul(scaling(fx_b, fy_b), matmul(h, scaling(1 / fx_a, 1 / fy_a)))


def model_matrix(tx: Column, ty: Column, sx: Column, sy: Column, theta_deg: Column, clockwise: bool = False) -> Column:
    """Five-parameter model L * p + t with L = rotation * diag(sx, sy)."""
    c, s = F.cos(F.radians(theta_deg)), F.sin(F.radians(theta_deg)) * (-1 if clockwise else 1)
    return F.array(c * sx, -s * sy, tx, s * sx, c * sy, ty, F.lit(0.0), F.lit(0.0), F.lit(1.0))


def centred(h: Column, cx: Column, cy: Column) -> Column:
    """An affine matrix that acts about a centre: the centre moves by the matrix's shift only."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return matmul(F.array(one, zero, cx, zero, one, cy, zero, zero, one), matmul(h, F.array(one, zero, -cx, zero, one, -cy, zero, zero, one)))


def downsample_factor(source: Column, target: Column) -> Column:
    """target / source metres per pixel, 1 at least; an error where either is not positive."""
    bad = (source <= 0) | (target <= 0)
    return F.when(bad, F.raise_error(F.lit("resolutions must be positive")).cast("double")).otherwise(F.greatest(F.try_divide(target, source), F.lit(1.0)))


def to_original(x: Column, factor: Column) -> Column:
    return x * factor


def crater_radius_px(diameter_km: Column, metres_per_px: Column) -> Column:
    return F.try_divide(diameter_km * 500.0, metres_per_px)


def crop_window(x: Column, y: Column, padding: int, lines: Column, samples: Column) -> Column:
    """Aggregates projected corners to a clamped window ``row0, row1, col0, col1``; null where it is empty."""
    lo = lambda v: F.greatest(F.floor(F.min(v)) - padding, F.lit(0))
    hi = lambda v, end: F.least(F.ceil(F.max(v)) + padding, F.max(end))
    w = F.struct(lo(y).cast("long").alias("row0"), hi(y, lines).cast("long").alias("row1"), lo(x).cast("long").alias("col0"), hi(x, samples).cast("long").alias("col1"))
    return F.when((w["row1"] > w["row0"]) & (w["col1"] > w["col0"]), w)


def solve_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Normalised direct linear transform from four points or more; ValueError where it is degenerate."""
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    if len(src) != len(dst) or len(src) < 4:
        raise ValueError("four point pairs at least")

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(0)
        spread = np.hypot(*(p - mean).T).mean()
        s = np.sqrt(2) / spread if spread else 1.0
        t = np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])
        return (p - mean) * s, t

    (a, ta), (b, tb) = normal(src), normal(dst)
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    one, zero = np.ones(len(a)), np.zeros(len(a))
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    if abs(h[2, 2]) < 1e-12:
        raise ValueError("degenerate points")
    return h / h[2, 2]


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    q = np.column_stack([points, np.ones(len(points))]) @ np.asarray(h, float).reshape(3, 3).T
    return q[:, :2] / q[:, 2:]


def pixel_corners(lines: float, samples: float) -> np.ndarray:
    """UL, UR, LR, LL pixel centres as (x, y)."""
    return np.array([[0, 0], [samples - 1, 0], [samples - 1, lines - 1], [0, lines - 1]], float)


def corner_transform(pairs, key: str = "pair_id"):  # noqa: ANN001, ANN201
    """``key, forward, backward, error`` for rows with ``a_foot, b_foot`` (flat lon, lat of four corners) and ``a_lines, a_samples, b_lines, b_samples``.

    forward maps A pixels to B pixels through longitude and latitude. Bad corners give nulls and
    an error text instead of failing the job.
    """
    import pandas as pd

    def fit(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    fa, fb = np.reshape(r.a_foot, (-1, 2)), np.reshape(r.b_foot, (-1, 2))
                    to_ground = solve_homography(pixel_corners(r.a_lines, r.a_samples), fa)
                    to_b = solve_homography(fb, pixel_corners(r.b_lines, r.b_samples))
                    h = to_b @ to_ground
                    h, g = h / h[2, 2], np.linalg.inv(h)
                    out.append((getattr(r, key), h.ravel().tolist(), (g / g[2, 2]).ravel().tolist(), None))
                except (ValueError, TypeError, np.linalg.LinAlgError) as e:
                    out.append((getattr(r, key), None, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "forward", "backward", "error"])

    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, "a_foot", "a_lines", "a_samples", "b_foot", "b_lines", "b_samples").mapInPandas(fit, f"{key} {kind}, forward array<double>, backward array<double>, error string")


def fit_affine(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3 x 3 affine matrix, residual lengths) of a least-squares fit through three points or more."""
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    if len(src) < 3:
        raise ValueError("three point pairs at least")
    a = np.column_stack([src, np.ones(len(src))])
    part = np.linalg.lstsq(a, dst, rcond=None)[0]
    h = np.vstack([part.T, [0, 0, 1]])
    return h, np.hypot(*(a @ part - dst).T)


def chain_prior(to_ground: np.ndarray, ground_to_map, map_to_b, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Affine prior from A pixels to B pixels through ground and map coordinates, fitted over grid points, with residuals."""
    return fit_affine(grid, map_to_b(ground_to_map(project(to_ground, np.asarray(grid, float)))))


def strip_frame(along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Orthonormal frame (rows: across, along) from two directions by Gram and Schmidt; across is kept on its own side."""
    u = np.asarray(along, float) / np.linalg.norm(along)
    v = np.asarray(across, float) - np.dot(across, u) * u
    size = np.linalg.norm(v)
    if size < 1e-12:
        raise ValueError("directions are parallel")
    return np.stack([v / size, u])
