"""dBase tables: a reader over file bytes, and free-text search."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def header(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """(records, header size, record size, fields as (name, type, width))."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    at = 32
    while at + 32 <= head and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    return n, head, size, fields


def records(data: bytes) -> Iterator[dict[str, str]]:
    """Rows as texts by field name; deleted rows are passed over, a short row ends the table."""
    n, head, size, fields = header(data)
    for k in range(n):
        row = data[head + k * size : head + (k + 1) * size]
        if len(row) < size:
            return
        if row[:1] == b"*":
            continue
        at, out = 1, {}
        for name, _, width in fields:
            out[name] = row[at : at + width].decode("ascii", "replace").strip()
            at += width
        yield out


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """``path, row_index, fields`` (a map of texts) of all dBase files under a path that Spark can list."""
    import pandas as pd

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(records(bytes(content)))
                yield pd.DataFrame({"path": p, "row_index": range(len(rows)), "fields": rows})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][bB][fF]").load(path)
    return files.select("path", "content").mapInPandas(scan, "path string, row_index long, fields map<string,string>")


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows whose columns, as one text, hold the needle in any case."""
    names: list[Column] = [F.col(c).cast("string") for c in (columns or rows.columns)]
    return rows.where(F.lower(F.concat_ws(" ", *names)).contains(needle.lower()))
