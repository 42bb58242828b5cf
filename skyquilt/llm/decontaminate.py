"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark item. Patterns of one length share a
shift table over blocks of two words: it says how far a cursor may move because no pattern ends
sooner. Where the shift is 0, the bucket of the last block's hash names the patterns that may end
there and their words are compared directly. Cursors of many stretches of text advance together.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import bound_batches, ddl, lean, mix, output, prefix_sums, slices, span_hashes, texts
from skyquilt.llm.common import BYTE_VALUES

WINDOW = 10
#: Text bytes of benchmark items in one block of patterns; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 20
LANE = 512

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a run of texts: lower-cased bytes, where each starts and ends, its text and its hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        # a gap after each text keeps words of neighbours apart
        n = np.diff(off)
        gaps = np.arange(len(n))
        self.data = np.full(len(data) + len(n), 32, np.uint8)
        self.data[np.arange(len(data)) + np.repeat(gaps, n)] = LOWER[data]
        edge = np.diff(np.concatenate([[False], WORD[self.data], [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(off[1:] + gaps, self.start, "right")
        self.hash = span_hashes(prefix_sums(BYTE_VALUES[self.data]), self.start, self.end)

    def joined(self, first: int, last: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[first:last], self.end[first:last], strict=True))


def block_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Table index of the block of ``size`` words that ends at each word; the first has none before it."""
    h = words.copy()
    if size == 2:
        h[1:] = words[1:] ^ mix(words[:-1] + np.uint64(0x51ED27))
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Patterns:
    """Shift table and suffix buckets of the patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]], hashes: dict[bytes, np.ndarray]) -> None:
        self.length, self.block = length, min(2, length)
        self.items = patterns
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int64)
        self.buckets: dict[int, set[bytes]] = defaultdict(set)
        for pattern in patterns:
            at = block_hashes(hashes[pattern], self.block)
            for j in range(self.block - 1, length):
                self.shift[at[j]] = min(self.shift[at[j]], length - 1 - j)
            self.buckets[int(at[-1])].add(pattern)

    def occurrences(self, words: Words) -> Iterator[tuple[int, list[int]]]:
        """(last word, items) of each occurrence; none crosses texts."""
        n, m = len(words.start), self.length
        if n < m:
            return
        at = block_hashes(words.hash, self.block)
        stops = np.minimum(np.arange(0, n, LANE) + LANE, n)
        cursor = np.arange(0, n, LANE)
        cursor[0] = m - 1
        found = []
        while len(cursor):
            live = cursor < stops
            cursor, stops = cursor[live], stops[live]
            move = self.shift[at[cursor]]
            found.append(cursor[move == 0])
            cursor = cursor + np.maximum(move, 1)
        for last in np.sort(np.concatenate(found)).tolist() if found else ():
            if last >= m - 1 and words.text[last] == words.text[last - m + 1]:
                pattern = words.joined(last - m + 1, last + 1)
                if pattern in self.buckets[int(at[last])]:
                    yield last, self.items[pattern]


def compile_patterns(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    """Patterns by length from (item id, text) rows."""
    encoded = [t.encode() for _, t in items]
    off = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(encoded), np.uint8), off)
    edges = np.searchsorted(words.text, np.arange(len(items) + 1))
    by_length: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    hashes: dict[bytes, np.ndarray] = {}
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        size = min(window, b - a)
        for k in range(a, b - size + 1) if size else ():
            pattern = words.joined(k, k + size)
            if i not in by_length[size][pattern]:
                by_length[size][pattern].append(i)
            hashes[pattern] = words.hash[k : k + size]
    return [Patterns(length, dict(p), hashes) for length, p in sorted(by_length.items())]


HITS = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit_words", pa.list_(pa.int64())), ("items", pa.string())])


def search(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """``row_id, doc_id, n_words, hit_words, items`` of docs (``row_id, doc_id, text``): runs of hit words as start, end, start, end, ... and ids joined by newlines."""
    cast = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_BYTES of text at most

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, compiled = [i for i, _ in cast.value], compile_patterns(cast.value, window)
        for batch in batches:
            for rows, data, off in slices(batch, limit=1 << 20):
                words = Words(data, off)
                hit = np.zeros(len(words.start) + 1, np.int64)
                names: dict[int, set[str]] = defaultdict(set)
                for patterns in compiled:
                    for last, found in patterns.occurrences(words):
                        hit[last - patterns.length + 1] += 1
                        hit[last + 1] -= 1
                        names[int(words.text[last])].update(ids[i] for i in found if ids[i] is not None)
                covered = np.cumsum(hit)[:-1] > 0
                first = np.searchsorted(words.text, np.arange(rows.num_rows + 1))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                a, b = edge[::2], edge[1::2]
                runs: list[list[int]] = [[] for _ in range(rows.num_rows)]
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    while s < e:  # a run can go on from one text's last word to the next text's first
                        t = int(words.text[s])
                        stop = min(e, int(first[t + 1]))
                        runs[t] += [s - int(first[t]), stop - int(first[t])]
                        s = stop
                yield output(HITS, {"row_id": rows.column("row_id"), "doc_id": rows.column("doc_id"), "n_words": np.diff(first), "hit_words": runs, "items": ["\n".join(sorted(names[i])) if i in names else "" for i in range(rows.num_rows)]})

    return docs.mapInArrow(scan, ddl(HITS))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_words", pa.list_(pa.int64()))])


def summarize(hits: DataFrame) -> DataFrame:
    @lean
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, names = batch.column("hit_words").to_pylist(), [x.split("\n") if x else [] for x in batch.column("items").to_pylist()]
            n = [sum(r[1::2]) - sum(r[::2]) for r in runs]
            yield output(RESULT, {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": n, "n_items": [len(x) for x in names], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], "contaminated": [k > 0 for k in n], "hit_words": runs})

    return hits.select("doc_id", "n_words", "hit_words", "items").mapInArrow(summary, ddl(RESULT))


def merged(hits: DataFrame) -> DataFrame:
    """Hits of several blocks of patterns joined by row."""
    union = F.udf(lambda runs: _union(runs), "array<long>")
    return hits.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), union(F.collect_list("hit_words")).alias("hit_words"), F.array_join(F.array_sort(F.array_distinct(F.split(F.concat_ws("\n", F.collect_list(F.nullif("items", F.lit("")))), "\n"))), "\n").alias("items"))


def _union(runs: list[list[int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted((r[i], r[i + 1]) for r in runs for i in range(0, len(r), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words``.

    Words are runs of digits, ASCII letters in lower case and non-ASCII characters. A window is
    ``window`` consecutive words of an item, or the whole item where it has fewer. Null or empty
    texts and items have no words and no windows. Items without id hit words but are not listed;
    rows that repeat an id count as one item. Repeated document rows give a row each. The benchmark
    is broadcast in blocks of ``block_bytes``; with more than one block the documents are searched
    once per block and the hits are joined by row. No documents give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    blocks = blocks_of(benchmark, block_bytes)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    if len(blocks) == 1:
        return summarize(search(rows.select(F.lit(0).cast("long").alias("row_id"), "doc_id", "text"), blocks[0], window))
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    parts = [search(rows, block, window) for block in blocks]
    return summarize(merged(reduce(DataFrame.union, parts)))


def flag_udf(docs: DataFrame, items: list[tuple[str, str]], window: int):
    """A Column function from text to whether any window of the items occurs in it."""
    import pandas as pd

    cast = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_BYTES of text at most

    @lean
    def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = compile_patterns(cast.value, window)
        for batch in batches:
            out = []
            for rows, data, off in slices(pa.record_batch([pa.array(batch, pa.string())], names=["text"]), limit=1 << 20):
                words, hit = Words(data, off), np.zeros(rows.num_rows, bool)
                for patterns in compiled:
                    for last, _ in patterns.occurrences(words):
                        hit[words.text[last]] = True
                out.append(hit)
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    flag.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(flag, "boolean")


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark's (item id, text) rows in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return [[tuple(r) for r in dealt.where(F.col("block") == b).drop("block").collect()] for b in range(n)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents in which any benchmark window occurs; texts are not shuffled.

    Null and empty texts stay; repeated rows are judged each. No documents give no rows.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    flags = [flag_udf(docs, block, window)(text) for block in blocks_of(benchmark, block_bytes)]
    return docs.where(~reduce(lambda a, b: a | b, flags))
