"""ESRI shapefile catalogs as a Python data source with column pruning by schema."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from skyquilt.sources import dbf

BOUNDS = "geometry_bounds struct<x0:double,y0:double,x1:double,y1:double>, geometry array<struct<x:double,y:double>>"


def shapes(data: bytes) -> Iterator[tuple[tuple[float, float, float, float] | None, list[tuple[float, float]] | None]]:
    """(bounds, first ring without its closing vertex) of each record; null shapes give nulls."""
    at = 100
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind in (3, 5, 13, 15, 23, 25):
            box = struct.unpack_from("<4d", data, at + 12)
            parts, n = struct.unpack_from("<2i", data, at + 44)
            ends = [*struct.unpack_from(f"<{parts}i", data, at + 52)[1:], n]
            flat = struct.unpack_from(f"<{2 * ends[0]}d", data, at + 52 + 4 * parts)
            ring = list(zip(flat[::2], flat[1::2], strict=True))
            yield box, ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        elif kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", data, at + 12)
            yield (x, y, x, y), [(x, y)]
        else:
            yield None, None
        at += 8 + size


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all shapefiles under path: ``file, row_index``, the geometry and the text of each attribute.

    Attributes come as texts; date fields are left out, since catalogs hold years that no date type
    takes. A file without its table of attributes gives geometry only.
    """
    import pandas as pd

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    from pyspark.sql import functions as F

    files = found.where(F.lower("path").rlike(r"\.(shp|dbf)$")).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind"), "content")
    names = files.where("kind = 'dbf'").select(F.substring("content", 1, 8192).alias("head")).mapInPandas(_field_names, "name string").distinct()
    columns = sorted(r[0] for r in names.collect())  # the attributes of a catalog are a few dozen names

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: bytes(c) for k, c in zip(pdf["kind"], pdf["content"], strict=True)}
        rows = list(dbf.records(parts["dbf"])) if "dbf" in parts else []
        geo = list(shapes(parts["shp"])) if "shp" in parts else []
        n = max(len(rows), len(geo))
        rows += [{}] * (n - len(rows))
        geo += [(None, None)] * (n - len(geo))
        out = pd.DataFrame({"file": [pdf["stem"].iloc[0]] * n, "row_index": range(n)})
        out["geometry_bounds"] = [None if b is None else dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b, _ in geo]
        out["geometry"] = [None if r is None else [{"x": x, "y": y} for x, y in r] for _, r in geo]
        for c in columns:
            out[c] = [r.get(c) for r in rows]
        return out

    schema = f"file string, row_index long, {BOUNDS}" + "".join(f", `{c}` string" for c in columns)
    return files.groupBy("stem").applyInPandas(join, schema)


def _field_names(batches):  # noqa: ANN001, ANN202
    import pandas as pd

    for pdf in batches:
        yield pd.DataFrame({"name": [n for h in pdf["head"] for n, kind, _ in dbf.header(bytes(h))[3] if kind != "D"]})


#: Fixed names of calibrated catalogs, by instrument.
CATALOG_NAMES = {"OHRC": "ch2_ohr_cal*.shp", "TMC2": "ch2_tmc_cal*.shp"}


def discover_catalogs(spark: SparkSession, root: str, instrument: str) -> DataFrame:
    """``path`` of an instrument's catalogs anywhere under root, in order; ValueError for an instrument without catalogs. No file is opened."""
    if instrument not in CATALOG_NAMES:
        raise ValueError(f"unsupported instrument: {instrument}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", CATALOG_NAMES[instrument]).load(root)
    return files.select("path").orderBy("path")
