"""BigTIFF headers and strips: typed tags of the first directory, geographic keys, row windows.

Files of tens of gigabytes are read by byte range, so a window is a few partitions of strips, not a
file in memory; the file must be on storage that all executors mount.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed sizes in bytes of tag types, and struct codes of those that are decoded.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {3: "H", 4: "I", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, OFFSETS, ROWS_PER_STRIP, COUNTS, SCALE, TIEPOINT, GEOKEYS, GEODOUBLES, GEOASCII = 256, 257, 258, 273, 278, 279, 33550, 33922, 34735, 34736, 34737


def read_tags(path: str, limit: int = 1 << 26) -> dict[int, object]:
    """Tags of the first directory; values beyond ``limit`` bytes and types without a code stay raw. ValueError for anything but BigTIFF."""
    with open(path.removeprefix("file://"), "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 43:
            raise ValueError("not a BigTIFF file")
        f.seek(struct.unpack(order + "Q", head[8:16])[0])
        n = struct.unpack(order + "Q", f.read(8))[0]
        entries = f.read(20 * n)
        tags: dict[int, object] = {"order": order}  # type: ignore[dict-item]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHQ", entries, 20 * k)
            size = SIZES.get(kind, 1) * count
            raw = entries[20 * k + 12 : 20 * k + 20]
            if size > 8:
                if size > limit:
                    continue
                f.seek(struct.unpack(order + "Q", raw)[0])
                raw = f.read(size)
            raw = raw[:size]
            if kind == 2:
                tags[tag] = raw.split(b"\0")[0].decode("ascii", "replace")
            elif kind in CODES:
                tags[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", raw)
            else:
                tags[tag] = raw
    return tags


def geo_keys(tags: dict[int, object]) -> dict[int, object]:
    """Key to value of the geographic key directory; values stand in place or in the double or text tags."""
    flat = tags.get(GEOKEYS, ())
    out: dict[int, object] = {}
    for k in range(4, len(flat) - 3, 4):
        key, where, n, value = flat[k : k + 4]
        if where == 0:
            out[key] = value
        elif where == GEODOUBLES:
            found = tags.get(GEODOUBLES, ())[value : value + n]
            out[key] = found[0] if len(found) == 1 else tuple(found)
        elif where == GEOASCII:
            out[key] = tags.get(GEOASCII, "")[value : value + n].rstrip("|\0")
    return out


class _Strips(InputPartition):
    def __init__(self, row0: int, row1: int) -> None:
        self.row0, self.row1 = row0, row1


class StripReader(DataSourceReader):
    """Rows [row0, row1) of an uncompressed one-sample file with one row a strip, columns [col0, col1)."""

    def __init__(self, options: dict) -> None:
        self.path, self.product = options["path"], options.get("product_id", "")
        tags = read_tags(self.path)
        self.width, self.height, self.order = tags[WIDTH][0], tags[HEIGHT][0], tags["order"]  # type: ignore[index]
        self.bits = tags.get(BITS, (8,))[0]
        offsets = tags[OFFSETS]
        row_bytes = self.width * self.bits // 8
        if tags.get(ROWS_PER_STRIP, (1,))[0] != 1 or any(b - a != row_bytes for a, b in zip(offsets[:-1], offsets[1:], strict=True)):
            raise ValueError("strips are not contiguous single rows")
        self.start, self.row_bytes = offsets[0], row_bytes
        get = lambda k, d: int(options.get(k, d))
        self.rows, self.cols = (get("row0", 0), get("row1", self.height)), (get("col0", 0), get("col1", self.width))
        self.step = get("lines_per_tile", 512)

    def partitions(self) -> list[_Strips]:
        return [_Strips(r, min(r + self.step, self.rows[1])) for r in range(*self.rows, self.step)]

    def read(self, part: _Strips) -> Iterator[tuple]:
        kind = np.dtype(f"{self.order}u{self.bits // 8}")
        n = part.row1 - part.row0
        with open(self.path.removeprefix("file://"), "rb") as f:
            f.seek(self.start + part.row0 * self.row_bytes)
            raw = f.read(n * self.row_bytes)
        tile = np.frombuffer(raw, kind).reshape(n, self.width)[:, self.cols[0] : self.cols[1]]
        native = np.ascontiguousarray(tile.astype(kind.newbyteorder("<")))
        yield (self.product, 0, part.row0, self.cols[0], n, self.cols[1] - self.cols[0], native.dtype.str, native.tobytes())


class StripSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigtiff_strips"

    def schema(self) -> str:
        from skyquilt.operators.raster import TILE_SCHEMA

        return TILE_SCHEMA

    def reader(self, schema) -> StripReader:  # noqa: ANN001
        return StripReader(self.options)


def read_strips(spark: SparkSession, **options: object) -> DataFrame:
    """Tile rows of a window of a BigTIFF file."""
    spark.dataSource.register(StripSource)
    return spark.read.format("bigtiff_strips").options(**{k: str(v) for k, v in options.items()}).load()


def pixel_to_map(tags: dict[int, object], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Map coordinates of pixel centres by the scale and tie point tags."""
    sx, sy = tags[SCALE][:2]  # type: ignore[index]
    i, j, _, mx, my, _ = tags[TIEPOINT][:6]  # type: ignore[index]
    return mx + (np.asarray(x) + 0.5 - i) * sx, my - (np.asarray(y) + 0.5 - j) * sy
