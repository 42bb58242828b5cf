"""Token ids in Parquet list columns: dictionary and delta encoding, bounded row groups, page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquilt.llm.bpe import encoder
from skyquilt.llm.common import bound_batches, ddl, fresh_path, slices, texts

#: Ids repeat, so they are dictionary pages; the version 2 writer has delta pages for the sorted columns. Pages of few rows, each with its entry in the page index, let a reader fetch single documents.
FORMAT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "256", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}

#: Bytes of a text by which rows of one doc_id are dealt to ranges, and those without one, of which there may be many.
PREFIX, PREFIX_WITHOUT_ID = 32, 128

STORED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, spaces: bool = True) -> None:
    """Encode whole texts (null: empty), end each with ``end_id``, and write them in ascending doc_id order.

    Files follow one another by ``part``; rows without doc_id come first, repeated ids stay next to
    each other in the order of their texts' bytes. Ranges may end between them where the first
    ``PREFIX`` or ``PREFIX_WITHOUT_ID`` bytes differ. An empty table writes no rows.
    """
    bound_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = encoder(tokenizer_file, spaces, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, data, off in slices(batch, limit=1 << 20):
                flat, n = bpe.encode(data, off)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.record_batch([rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), ids], schema=STORED)
                at += int(ends[-1])

    # beginnings of texts follow the order of texts and are short enough to be sampled for the ends of ranges
    head = F.substring(F.col("text").cast("binary"), F.lit(1), F.when(F.col("doc_id").isNull(), PREFIX_WITHOUT_ID).otherwise(PREFIX))
    keyed = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("head", head)
    ordered = keyed.repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    ordered.mapInArrow(encode, ddl(STORED)).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows with ``start``, the number of ids in all documents before."""
    rows = spark.read.schema(ddl(STORED)).parquet(path)
    return with_start(rows, rows)


def with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    # one row for each written file, so this window is short
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before", "start_in_part", "part")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.record_batch([batch.column(k) for k in range(3)] + [pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], schema=DIGEST)

    stored = spark.read.schema(ddl(STORED)).parquet(path)
    rows = stored.select("doc_id", "part", "start_in_part", "ids").mapInArrow(digest, ddl(DIGEST))
    return with_start(rows, stored).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenize_and_digest(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, end_id)
    return token_digests(docs.sparkSession, path)
