"""Exact substring dedup by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A string of ``length`` bytes has one anchor: the leftmost smallest k-gram hash in it. Equal strings
have equal anchors, so the stretches of text around equal anchors can be searched apart from all
others. Stretches whose anchor occurs once in the corpus hold no repeat. Equal stretches are counted
and kept once. The rest are dealt by anchor; a task concatenates them, builds the transform, and
finds common prefixes by increasing value: intervals of suffixes are extended backwards, breadth
first, and each newly met right end of an interval has the current level as its common prefix. At
``length`` the expansion stops; suffixes between which no end was met share at least that much.

An anchor with many different stretches (the edge of a passage that many documents share) is
narrowed: its strings are dealt by their distance from the anchor and by what all strings of such a
range have in common, down to single strings if need be, so that no group grows with the corpus.

Stretches are told apart by 64-bit hashes of the hashes of all short strings in them: two steps with
a non-linear mix between, so that no text makes them collide by construction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import BYTE_VALUES, bound_batches, ddl, materialize, mix, output, prefix_sums, signed, slices, span_hashes

LENGTH = 400
GRAM = 64
#: Different stretches of an anchor in one group at most, and bytes in one transform.
GROUP = 256
BATCH = 1 << 20
#: Ranges of starts into which a larger group is narrowed, one after the other.
STEPS = (24, 1)
NO_ID = -(2**63)


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches as (text, first start, number of starts, distance from first start to the anchor, anchor hash, stretch hash)."""
    width = length - gram + 1
    n = len(data) - gram + 1
    counts = np.maximum(np.diff(off) - length + 1, 0)
    if n < width or not counts.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    total = prefix_sums(BYTE_VALUES[data])
    at = np.arange(n)
    h = span_hashes(total, at, at + gram)
    key = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + off[:-1][text]
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    size = np.diff(np.append(new, len(start)))
    first, text, anchor = start[new], text[new], anchor[new]
    stretch = span_hashes(prefix_sums(h), first, first + size + length - gram)
    return text, first - off[:-1][text], size, anchor - first, h[anchor], stretch


def suffix_order(t: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of t sorted to at least ``depth`` bytes, and their first eight bytes; ``left``: bytes to the separator."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    short = np.flatnonzero(left < 8)
    lost = (8 * (8 - left[short])).astype(np.uint64)
    key[short] = np.where(left[short] > 0, (key[short] >> (lost % np.uint64(64))) << (lost % np.uint64(64)), np.uint64(0))
    order = np.argsort(key).astype(np.int64)
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(head)
    group = np.repeat(first, np.diff(np.append(first, n)))
    rank[order] = group
    h = 8
    while h < depth:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        who = order[tied]
        # suffixes that end before h differ in their separators, which follow their places
        second = np.where(left[who] < h, who, rank[np.minimum(who + h, n - 1)])
        both = (rank[who].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        way = np.argsort(both)
        order[tied] = who[way]
        both = both[way]
        head[tied] = np.concatenate([[True], both[1:] != both[:-1]]) | head[tied]
        first = np.flatnonzero(head[tied])
        rank[order[tied]] = np.repeat(tied[first], np.diff(np.append(first, len(tied))))
        h *= 2
    return order, sorted_key


def repeated_starts(data: np.ndarray, off: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the stretches, whether the ``length`` bytes from there occur twice or more.

    ``weight``: how often each stretch occurs in the corpus.
    """
    sizes = np.diff(off)
    m = len(sizes)
    t = np.zeros(len(data) + m, np.uint8)
    owner = np.repeat(np.arange(m), sizes)
    place = np.arange(len(data)) + owner
    t[place] = data + 1  # UTF-8 has no byte 255; 0 is the separator
    ends = off[1:] + np.arange(m)
    left = np.repeat(ends, sizes + 1) - np.arange(len(t))
    n = len(t)
    order, key = suffix_order(t, left, length)
    before = t[order - 1]  # a text's first byte is preceded by a separator: the last one, for the very first
    lf = np.empty(n, np.int64)
    lf[np.argsort(before, kind="stable")] = np.arange(n)
    letter = t[order]

    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    differs = key[1:] ^ key[:-1]
    met[1:n] = differs != 0
    edge = np.flatnonzero(met)
    begin, end = edge[:-1], edge[1:]
    # intervals of eight bytes whose right end has a common prefix of seven
    seed = (end < n) & (left[order[begin]] >= 8)
    seed[seed] = differs[end[seed] - 1] < 256
    begin, end = begin[seed], end[seed]
    for _ in range(8, length):
        if not len(begin):
            break
        size = end - begin
        reach = np.cumsum(size)
        at = np.repeat(begin - (reach - size), size) + np.arange(reach[-1])
        interval = np.repeat(np.arange(len(begin)), size)
        whole = before[at] != 0
        both = (lf[at[whole]].astype(np.uint64) << np.uint64(32)) | interval[whole].astype(np.uint64)
        both.sort()
        to, interval = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
        if not len(to):
            break
        new = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (interval[1:] != interval[:-1]) | (letter[to[1:]] != letter[to[:-1]])])
        first = np.flatnonzero(new)
        begin, end = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~met[end]
        met[end[fresh]] = True
        begin, end = begin[fresh], end[fresh]

    short = left[order] < length
    met[1:n] |= short[1:] | short[:-1]
    first = np.flatnonzero(met[:n])
    block = np.diff(np.append(first, n))
    found = np.zeros(n, bool)
    found[order] = np.repeat(block >= 2, block)
    return (found[place] | (weight[owner] >= 2)) & (left[place] >= length)


ANCHORS = pa.schema([("jk", pa.int64()), ("tk", pa.int64()), ("pos", pa.int64()), ("starts", pa.int32()), ("back", pa.int32()), ("g", pa.int64()), ("s", pa.int64())])
REPEATS = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("spans", pa.list_(pa.int64()))])
LINKS = pa.schema([("pg", pa.int64()), ("ps", pa.int64()), ("g", pa.int64()), ("s", pa.int64()), ("a", pa.int64()), ("starts", pa.int32()), ("back", pa.int32()), ("n", pa.int64())])


def find_anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, limit=2 << 20):
                text, pos, size, back, h, s = anchors(data, off, length, gram)
                if len(text):
                    take = pa.array(text)
                    yield output(ANCHORS, {"jk": rows.column("jk").take(take), "tk": rows.column("tk").take(take), "pos": pos, "starts": size, "back": back, "g": signed(h), "s": signed(s)})

    return keyed.mapInArrow(scan, ddl(ANCHORS))


def grouped(stretches: DataFrame, *origin: str) -> DataFrame:
    """Equal stretches once, with their number ``n``, one ``origin``, and how many different ones share the group; lone ones go."""
    same = stretches.groupBy("g", "s").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in (*origin, "starts", "back")])
    group = same.groupBy("g").agg(F.sum("n").alias("in_group"), F.count("*").alias("variants")).where("in_group > 1").drop("in_group")
    return same.join(group, "g")


def expand(stretches: DataFrame, length: int) -> DataFrame:
    """``g, s, spans`` of stretches (``g, s, n, data``; repeated rows count once): repeated bytes as start, end, start, end, ... within the stretch."""

    def solve(part: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        off = np.concatenate([[0], np.cumsum([len(x[3]) for x in part])]).astype(np.int64)
        data = np.frombuffer(b"".join(x[3] for x in part), np.uint8)
        found = repeated_starts(data, off, np.array([x[2] for x in part]), length)
        out: list[list[int]] = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], found[a:b], [False]]).astype(np.int8))).reshape(-1, 2)
            edge[:, 1] += length - 1
            out.append(edge.ravel().tolist())
        keep = [k for k, x in enumerate(out) if x]
        return output(REPEATS, {"g": [part[k][0] for k in keep], "s": [part[k][1] for k in keep], "spans": [out[k] for k in keep]})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "s", "n", "data")), strict=True):
                if size >= BATCH and row[0] != part[-1][0]:
                    yield solve(part)
                    part, size = [], 0
                if not part or row[:2] != part[-1][:2]:
                    part.append(row)
                    size += len(row[3])
        if part:
            yield solve(part)

    return stretches.select("g", "s", "n", "data").repartition("g").sortWithinPartitions("g", "s").mapInArrow(scan, ddl(REPEATS))


def narrow(stretches: DataFrame, step: int, length: int) -> DataFrame:
    """Parts of stretches (``g, s, n, back, data``) by ranges of ``step`` starts, counted from the anchor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8)
            size = np.array([len(x) for x in batch.column("data").to_pylist()], np.int64)
            off = np.cumsum(size) - size
            back = batch.column("back").to_numpy().astype(np.int64)
            starts = size - length + 1
            # starts at distances back, back - 1, ... from the anchor; ranges are [r * step, r * step + step)
            low = (back - starts + 1) // step
            number = back // step - low + 1
            row = np.repeat(np.arange(len(size)), number)
            r = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + low[row]
            a = np.maximum(back[row] - (r * step + step - 1), 0)
            b = np.minimum(back[row] - r * step, starts[row] - 1)
            k = max(1, min(16, length - step + 1))
            total = prefix_sums(BYTE_VALUES[data])
            at = np.arange(max(len(data) - k + 1, 0))
            total = prefix_sums(span_hashes(total, at, at + k))
            # what every string of the range holds: from its last start to its first end
            core_a, core_b = back[row] - r * step, back[row] - (r * step + step - 1) + length
            core = span_hashes(total, off[row] + core_a, off[row] + core_b - k + 1) if len(row) else np.zeros(0, np.uint64)
            g = mix(core ^ mix(batch.column("g").to_numpy().astype(np.int64).view(np.uint64)[row] + r.astype(np.uint64)))
            s = span_hashes(total, off[row] + a, off[row] + b + length - k + 1)
            take = pa.array(row)
            yield output(LINKS, {"pg": batch.column("g").take(take), "ps": batch.column("s").take(take), "g": signed(g), "s": signed(s), "a": a, "starts": b - a + 1, "back": back[row] - a, "n": batch.column("n").take(take)})

    return stretches.select("g", "s", "n", "back", "data").mapInArrow(scan, ddl(LINKS))


def repeats_of(candidates: DataFrame, data: DataFrame, steps: tuple[int, ...], length: int, group: int) -> DataFrame:
    """``g, s, spans`` of grouped candidates; ``data``: the same rows with their bytes."""
    small = expand(data.where(F.col("variants") <= group), length)
    if not steps or candidates.where(F.col("variants") > group).limit(1).count() == 0:
        return small if steps else expand(data, length)
    large = data.where(F.col("variants") > group)
    links = materialize(narrow(large, steps[0], length), "narrowed", free=True)
    parts = materialize(grouped(links, "pg", "ps", "a"), "parts", free=True)
    bytes_of = large.select(F.col("g").alias("pg"), F.col("s").alias("ps"), F.col("data").alias("whole"))
    cut = F.expr(f"substring(whole, cast(a + 1 as int), cast(starts + {length - 1} as int))")
    part_data = parts.join(bytes_of, ["pg", "ps"]).select("g", "s", "n", "back", "variants", cut.alias("data"))
    found = repeats_of(parts, part_data, steps[1:], length, group)
    back = links.join(found, ["g", "s"]).select("pg", "ps", F.transform("spans", lambda x: x + F.col("a")).alias("spans"))
    # one row for each stretch, so that its many places meet it once
    whole = back.groupBy("pg", "ps").agg(F.flatten(F.collect_set("spans")).alias("spans")).select(F.col("pg").alias("g"), F.col("ps").alias("s"), "spans")
    return small.union(whole)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in any
    document or the same one; strings are judged on the input. ``spans`` are the maximal removed
    runs as start, end, start, end, ... in UTF-8 bytes. Null and empty texts have no bytes and the
    digest of nothing; texts below ``length`` bytes lose none. Repeated rows are documents that
    repeat each other; work stays in proportion to their number. An empty table gives an empty result; only doc_id and text are used.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("jk"), F.xxhash64(text).alias("tk"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = materialize(find_anchors(keyed.where(F.octet_length("text") >= length).select("jk", "tk", "text"), length, gram), "anchors", free=True)
    candidates = materialize(grouped(found.withColumn("n", F.lit(1).cast("long")), "jk", "tk", "pos"), "candidates", free=True)
    cut = F.expr(f"substring(cast(text as binary), cast(pos + 1 as int), starts + {length - 1})")
    # Texts are shuffled twice, here and for the result. Shuffle files of each step go before the next one.
    # Rows that are equal in doc_id and text each bring the same bytes; expand takes them once.
    data = materialize(candidates.join(keyed, ["jk", "tk"]).select("g", "s", "n", "back", "variants", cut.alias("data")), "stretches", free=True)
    repeats = materialize(repeats_of(candidates, data, STEPS, length, group), "repeats", free=True)
    places = found.select("jk", "tk", "pos", "g", "s").join(repeats, ["g", "s"])
    spans = places.select("jk", "tk", F.transform("spans", lambda x: x + F.col("pos")).alias("spans")).groupBy("jk", "tk").agg(F.flatten(F.collect_set("spans")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in RESULT}
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw = text.encode()
                merged: list[int] = []
                if runs:
                    pairs = np.array(runs, np.int64).reshape(-1, 2)
                    cover = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1], -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    merged = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                edge = [0, *merged, len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                for name, value in zip(out, (doc, len(raw), len(raw) - len(kept), len(merged) // 2, hashlib.sha256(kept).hexdigest(), merged), strict=True):
                    out[name].append(value)
            yield output(RESULT, out)

    return keyed.join(spans, ["jk", "tk"], "left").select("doc_id", "text", "spans").mapInArrow(finish, ddl(RESULT))
