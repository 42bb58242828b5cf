"""Raw rasters as tile rows: types, sizes, windowed reads, stretches, block means, suppression.

A tile row is ``product_id, band, row0, col0, h, w, dtype, data`` with native little-endian bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed names of stored pixel types and their numpy codes.
DTYPES = {
    "UnsignedByte": "|u1", "SignedByte": "|i1", "UnsignedLSB2": "<u2", "UnsignedMSB2": ">u2", "SignedLSB2": "<i2", "SignedMSB2": ">i2", "UnsignedLSB4": "<u4", "UnsignedMSB4": ">u4", "SignedLSB4": "<i4", "SignedMSB4": ">i4",
    "IEEE754LSBSingle": "<f4", "IEEE754MSBSingle": ">f4", "IEEE754LSBDouble": "<f8", "IEEE754MSBDouble": ">f8",
}
TILE_SCHEMA = "product_id string, band int, row0 long, col0 long, h int, w int, dtype string, data binary"


def numpy_type(name: str) -> np.dtype:
    if name not in DTYPES:
        raise ValueError(f"unknown pixel type: {name}")
    return np.dtype(DTYPES[name])


def item_size(dtype: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, code in DTYPES.items():
        out = F.when(dtype == name, F.lit(np.dtype(code).itemsize)).otherwise(out)
    return out


def expected_bytes(lines: Column, samples: Column, bands: Column, dtype: Column) -> Column:
    return lines.cast("long") * samples * F.greatest(bands, F.lit(1)) * item_size(dtype)


def size_state(declared: Column, actual: Column, expected: Column) -> Column:
    """Struct ``same, overhead_ok``: declared equals actual, and at most one percent is not pixels."""
    return F.struct((declared == actual).alias("same"), ((actual >= expected) & (F.try_divide(actual - expected, expected) <= 0.01)).alias("overhead_ok"))


class _Bands(InputPartition):
    def __init__(self, band: int, row0: int, row1: int) -> None:
        self.band, self.row0, self.row1 = band, row0, row1


class RasterReader(DataSourceReader):
    """Reads rows [row0, row1) and columns [col0, col1) of a band-sequential file, a few lines at a time."""

    def __init__(self, options: dict) -> None:
        get = lambda k, d=0: int(options.get(k, d))
        self.path, self.product = options["path"], options.get("product_id", "")
        self.lines, self.samples, self.bands, self.offset = get("lines"), get("samples"), get("bands", 1), get("offset")
        self.dtype_name = options.get("dtype", "UnsignedByte")
        self.rows = (get("row0"), get("row1", self.lines))
        self.cols = (get("col0"), get("col1", self.samples))
        self.step = get("lines_per_tile", 512)

    def partitions(self) -> list[_Bands]:
        a, b = self.rows
        return [_Bands(k, r, min(r + self.step, b)) for k in range(self.bands) for r in range(a, b, self.step)]

    def read(self, part: _Bands) -> Iterator[tuple]:
        kind = numpy_type(self.dtype_name)
        c0, c1 = self.cols
        n = part.row1 - part.row0
        with open(self.path.removeprefix("file://"), "rb") as f:
            f.seek(self.offset + (part.band * self.lines + part.row0) * self.samples * kind.itemsize)
            raw = f.read(n * self.samples * kind.itemsize)
        if len(raw) < n * self.samples * kind.itemsize:
            raise ValueError(f"{self.path} is shorter than its label says")
        tile = np.frombuffer(raw, kind).reshape(n, self.samples)[:, c0:c1]
        native = np.ascontiguousarray(tile.astype(kind.newbyteorder("<")))
        yield (self.product, part.band, part.row0, c0, n, c1 - c0, native.dtype.str, native.tobytes())


class RasterSource(DataSource):
    """``spark.read.format("raw_raster")``; the file must be on storage that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "raw_raster"

    def schema(self) -> str:
        return TILE_SCHEMA

    def reader(self, schema) -> RasterReader:  # noqa: ANN001
        return RasterReader(self.options)


def read_raster(spark: SparkSession, **options: object) -> DataFrame:
    spark.dataSource.register(RasterSource)
    return spark.read.format("raw_raster").options(**{k: str(v) for k, v in options.items()}).load()


def decode(dtype: str, data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(dtype)).reshape(h, w)


def pixels(tiles: DataFrame) -> DataFrame:
    """``product_id, band, y, x, value`` of tile rows."""
    import pandas as pd

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                y, x = np.mgrid[t.row0 : t.row0 + t.h, t.col0 : t.col0 + t.w]
                yield pd.DataFrame({"product_id": t.product_id, "band": t.band, "y": y.ravel(), "x": x.ravel(), "value": decode(t.dtype, t.data, t.h, t.w).ravel().astype(float)})

    return tiles.mapInPandas(scan, "product_id string, band int, y long, x long, value double")


def block_means(pixel_rows: DataFrame, factor: int) -> DataFrame:
    """Area means over factor x factor blocks; rests at the edges are dropped, a factor of 1 keeps all."""
    if factor < 1:
        raise ValueError("factor below 1")
    full = pixel_rows.groupBy("product_id", "band", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return full.where(F.col("n") == factor * factor).drop("n")


def shrink(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Area-average resampling to a smaller shape with exact fractional weights; never enlarges."""
    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        lo = np.maximum(edge[:-1, None], np.arange(n))
        hi = np.minimum(edge[1:, None], np.arange(1, n + 1))
        w = np.maximum(hi - lo, 0)
        return w / w.sum(1, keepdims=True)

    h, w = min(shape[0], image.shape[0]), min(shape[1], image.shape[1])
    return weights(image.shape[0], h) @ image.astype(float) @ weights(image.shape[1], w).T


def stretch_limits(pixel_rows: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """``product_id, lo, hi`` over all pixels of a product."""
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return pixel_rows.groupBy("product_id").agg(F.percentile(finite, F.lit(low)).alias("lo"), F.percentile(finite, F.lit(high)).alias("hi"))


def stretch(value: Column, lo: Column, hi: Column) -> Column:
    """0 to 255 between the limits; 128 where the limits coincide or the value is missing."""
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - lo, hi - lo))) * 255)
    return F.when((hi <= lo) | value.isNull() | F.isnan(value), F.lit(128)).otherwise(v).cast("int")


def suppress(detections: DataFrame, share: float = 0.5, key: str = "product_id") -> DataFrame:
    """Greedy suppression by confidence: a detection goes if a kept one lies within ``share`` of the larger radius.

    Decisions reach no further than the largest radius from detection to detection, but chain, so a
    product is one group; its detections are thousands, not pixels. Ties go to the larger radius, then to x, y.
    """
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "radius", "cx", "cy"], ascending=[False, False, True, True], kind="stable")
        x, y, r = (pdf[c].to_numpy(float) for c in ("cx", "cy", "radius"))
        kept: list[int] = []
        for i in range(len(pdf)):
            if not kept or (np.hypot(x[kept] - x[i], y[kept] - y[i]) >= share * np.maximum(r[kept], r[i])).all():
                kept.append(i)
        return pdf.iloc[kept]

    return detections.groupBy(key).applyInPandas(keep, detections.schema)


def tile_lattice(spark: SparkSession, width: int, height: int, tile: int, n: int) -> DataFrame:
    """Centres ``tile_id, x, y`` of n x n tiles inside the image."""
    at = lambda size, k: tile // 2 + k * (size - 2 * (tile // 2)) / max(n - 1, 1)
    i = F.col("id")
    return spark.range(n * n).select(i.alias("tile_id"), at(width, i % n).alias("x"), at(height, F.floor(i / n)).alias("y"))


def largest_first(detections: DataFrame) -> DataFrame:
    w = Window.partitionBy("product_id").orderBy(F.desc("radius"), "cx", "cy")
    return detections.withColumn("rank", F.row_number().over(w))
