"""Scores of correspondences and detections: one aggregate wherever one will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIAS_SHARE = 0.3
BANDS = (0.0, 75.0, 150.0, 300.0, 600.0, 1200.0, 2500.0)
BAND_LABELS = ("<=75", "75-150", "150-300", "300-600", "600-1200", "1200-2500", ">2500")


def with_errors(rows: DataFrame) -> DataFrame:
    """rows (``expected_x, expected_y, predicted_x, predicted_y``) with ``dx, dy, error``."""
    dx, dy = F.col("expected_x") - F.col("predicted_x"), F.col("expected_y") - F.col("predicted_y")
    return rows.withColumn("dx", dx).withColumn("dy", dy).withColumn("error", F.hypot(dx, dy))


def score(rows: DataFrame, tolerance: float, *by: str) -> DataFrame:
    """Count, correct, percent, mean offsets, bias flag and error distribution; no rows give zeros (without ``by``)."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    e = F.col("error")
    out = with_errors(rows).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(e <= tolerance).alias("n_correct"),
        F.coalesce(F.try_divide(100.0 * F.count_if(e <= tolerance), F.count("*")), F.lit(0.0)).alias("pct_correct"),
        F.coalesce(F.avg("dx"), F.lit(0.0)).alias("mean_dx"), F.coalesce(F.avg("dy"), F.lit(0.0)).alias("mean_dy"),
        *[F.coalesce(f, F.lit(0.0)).alias(k) for k, f in distribution(e).items()],
    )
    return out.withColumn("bias_suspected", (F.abs("mean_dx") > BIAS_SHARE * tolerance) | (F.abs("mean_dy") > BIAS_SHARE * tolerance))


def distribution(e: Column) -> dict[str, Column]:
    return {"min_error": F.min(e), "max_error": F.max(e), "mean_error": F.avg(e), "median_error": F.median(e), "p90_error": F.percentile(e, F.lit(0.9))}


def within(e: Column, *limits: float) -> list[Column]:
    return [F.count_if(e <= x).alias(f"within_{x:g}") for x in limits]


def band_of(e: Column) -> Column:
    """Index of a half-open band; the last one is open above. A value on an edge belongs to the upper band."""
    out = F.when(e >= BANDS[-1], len(BANDS) - 1)
    for i in range(len(BANDS) - 2, -1, -1):
        out = out.when(e >= BANDS[i], i)
    return out


def error_bands(errors: DataFrame, column: str = "error") -> DataFrame:
    """``band, label, n`` with bands of no rows too."""
    counts = errors.groupBy(band_of(F.col(column)).alias("band")).agg(F.count("*").alias("n"))
    bands = errors.sparkSession.createDataFrame(list(enumerate(BAND_LABELS)), "band int, label string")
    return bands.join(counts, "band", "left").select("band", "label", F.coalesce("n", F.lit(0)).alias("n"))


def match_detections(detections: DataFrame, truth: DataFrame, radius: float = 150.0, ratio: float = 3.0, group: str = "g") -> DataFrame:
    """Each detection with the truth it matches, or null: ``g, det_id, gt_id, iou``.

    detections: ``g, det_id, det_ord, x, y, r``; truth: ``g, gt_id, x, y, r``. A detection's choice is the
    truth of the largest positive overlap score within radius and size ratio; a truth goes to the
    first detection that chose it, and the others stay unmatched. Candidates meet in cells of one
    radius.
    """
    cell = lambda v: F.floor(v / radius)
    d = detections.withColumn("c", F.explode(F.array(*[F.struct((cell(F.col("x")) + i).alias("cx"), (cell(F.col("y")) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    t = truth.select(group, "gt_id", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("r").alias("gr"), F.struct(cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy")).alias("c"))
    dist = F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy"))
    big, small = F.greatest("r", "gr"), F.least("r", "gr")
    fits = (F.col("gr") <= 0) | (big <= ratio * F.greatest(small, F.lit(5e-7)))
    pairs = d.join(t, [group, "c"]).where((dist <= radius) & fits).withColumn("iou", circle_score(F.col("r"), F.col("gr"), dist)).where("iou > 0")
    chosen = pairs.groupBy(group, "det_id").agg(F.max_by(F.struct("gt_id", "iou", "det_ord"), F.struct(F.col("iou"), -F.col("gt_id"))).alias("m")).select(group, "det_id", "m.*")
    won = chosen.withColumn("nth", F.row_number().over(Window.partitionBy(group, "gt_id").orderBy("det_ord"))).where("nth = 1").select(group, "det_id", "gt_id", "iou")
    return detections.select(group, "det_id").join(won, [group, "det_id"], "left")


def circle_score(r1: Column, r2: Column, dist: Column) -> Column:
    """Stand-in for the overlap of two circles: (min r - d / 2)^2 pi over what is left of both."""
    both = F.pow(F.greatest(F.least(r1, r2) - dist / 2, F.lit(0.0)), 2) * F.pi()
    return both / F.greatest(F.pi() * (r1 * r1 + r2 * r2) - both, F.lit(1e-6))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-6)), 4).alias("f1")]


def detection_report(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    found = matched.agg(F.count("gt_id").alias("tp"), (F.count("*") - F.count("gt_id")).alias("fp"))
    out = found.crossJoin(truth.agg(F.count("*").alias("n_gt"))).withColumn("fn", F.col("n_gt") - F.col("tp"))  # one row each
    return out.select("tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def mad_inliers(rows: DataFrame, column: str, floor: float, least: int = 5, *by: str) -> DataFrame:
    """rows with ``inlier``: at most max(3 * 1.4826 * MAD, floor); all where fewer than ``least`` would be left."""
    def attach(left: DataFrame, stats: DataFrame) -> DataFrame:
        return left.join(stats, list(by)) if by else left.crossJoin(F.broadcast(stats))  # one row

    step = attach(rows, rows.groupBy(*by).agg(F.median(column).alias("m_")))
    step = attach(step, step.groupBy(*by).agg(F.median(F.abs(F.col(column) - F.col("m_"))).alias("mad_")))
    limit = F.greatest(3 * 1.4826 * F.col("mad_"), F.lit(floor))
    step = step.withColumn("in_", F.col(column) <= limit)
    step = attach(step, step.groupBy(*by).agg(F.count_if("in_").alias("k_")))
    return step.withColumn("inlier", F.col("in_") | (F.col("k_") < least)).drop("m_", "mad_", "in_", "k_")


def occupancy(rows: DataFrame, x: str, y: str, width: float, height: float, n: int = 8) -> DataFrame:
    """``n_cells, uniformity``: distinct cells of an n x n grid that hold a point; points outside do not count."""
    gx, gy = (F.col(x) * n / width).cast("int"), (F.col(y) * n / height).cast("int")
    inside = gx.between(0, n - 1) & gy.between(0, n - 1)
    return rows.agg(F.count_distinct(F.when(inside, gx * n + gy)).alias("n_cells")).withColumn("uniformity", F.col("n_cells") / (n * n))


def displacement(rows: DataFrame, dx: str, dy: str, weight: str) -> DataFrame:
    r = F.hypot(F.col(dx), F.col(dy))
    return rows.agg(F.count("*").alias("n"), F.median(dx).alias("median_dx"), F.median(dy).alias("median_dy"), F.median(r).alias("median_r"), F.avg(r).alias("mean_r"), F.percentile(r, F.lit(0.9)).alias("p90_r"), F.median(weight).alias("median_score"))


def quartiles(rows: DataFrame, column: str, *by: str) -> DataFrame:
    q = F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def value_statistics(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Share of finite values and their min, median, max and population deviation."""
    v = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))
    return rows.groupBy(*by).agg(F.try_divide(F.count(v), F.count("*")).alias("finite_share"), F.min(v).alias("min"), F.median(v).alias("median"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def correlation(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Masked normalised correlation: pairs with both values present."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.where(ok).groupBy(*by).agg(F.corr(a, b).alias("ncc"), F.count("*").alias("n"))


def error_structure(rows: DataFrame, x: str, y: str, e: str) -> DataFrame:
    """RMS of e: as it is, after its mean, and after a plane a + b x + c y, from moments in one pass."""
    cols = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "e": F.col(e)}
    moments = rows.agg(*[F.sum(cols[p] * cols[q]).alias(f"{p}{q}") for i, p in enumerate(cols) for q in list(cols)[i:]])
    m = lambda p: F.col(p)
    n = m("nn")
    cov = lambda p, q: m(f"{p}{q}") / n - m(f"n{p}") * m(f"n{q}") / (n * n)
    det = cov("x", "x") * cov("y", "y") - cov("x", "y") * cov("x", "y")
    fit = F.try_divide(cov("x", "e") * cov("x", "e") * cov("y", "y") - 2 * cov("x", "y") * cov("x", "e") * cov("y", "e") + cov("y", "e") * cov("y", "e") * cov("x", "x"), det)
    var = cov("e", "e")
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    return moments.select(n.cast("long").alias("n"), root(m("ee") / n).alias("rms"), root(var).alias("rms_centred"), root(var - F.coalesce(fit, F.lit(0.0))).alias("rms_linear"))


def best_candidate(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """The row with the largest value; among equals the first in the given order."""
    first = F.row_number().over(Window.orderBy(F.desc(value), *order))
    return rows.orderBy(F.desc(value), *order).limit(1).withColumn("rank", first).drop("rank")
