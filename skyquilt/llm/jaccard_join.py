"""Exact Jaccard join on word shingles, with index-level and answer-level skipping.

Documents with the same shingle set are one class; a representative of each class is enough. A set's
prefix, its first shingles in a global order from rare to common, must share a shingle with the
prefix of each set it links with.

Index level: lists of prefix shingles are sorted by set size and position. All rows of one size are a
block. From a set's own size and position follow the sizes, and in each block the last position, with
which the threshold can still be reached; whole blocks, and the rest of a block, are skipped unseen.

Answer level: answers here are the components. In a few turns, each set is compared with few others
from its lists, at last with the most promising ones of each other group, so that groups of near
copies grow together. Afterwards a set is compared only with
sets that its own group's answers do not hold. Where it meets many sets of one group, their answers
are derived from one of them, R: both overlaps with R are computed, and as |x & y| is at most
|x & R| + |y - R| and at least |x & R| + |y & R| - |R|, most pairs are decided without being
compared. Counts in buckets of shingle hashes bound the overlap from above before any set is
fetched; whole sets decide the rest.

Words, shingles and sets are compared by 64-bit hashes (words beyond 64 bytes by a cryptographic one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import BYTE_VALUES, bound_batches, ddl, lean, materialize, mix, output, prefix_sums, signed, slices, span_hashes
from skyquilt.llm.components import connected_components

SHINGLE = 4
PERCENT = 85
COUNTERS = 18  # bits
#: Partners that one task compares with a set at most.
FAN = 256
#: Turns in which groups grow together at most, lists that a set takes part in, and following sets of a list that it meets, in each.
TURNS, OWN_LISTS, NEXT = 2, 2, 2
#: Most promising sets of each other group of a list that a set meets in the turn after these.
FEW = 2
#: Sets of one group that a set meets from which on answers are derived.
DERIVE = 4
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64
#: Bits of a filter on ids at most.
FILTER_BITS = 27

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    n = np.diff(off)
    spread = np.full(len(data) + len(n), 32, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = LOWER[data]
    edge = np.diff(np.concatenate([[True], SPACE[spread], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = span_hashes(prefix_sums(BYTE_VALUES[spread]), start, end)
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        words[k] = int.from_bytes(hashlib.blake2b(spread[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    first = np.searchsorted(start, off + np.arange(len(off)))
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        whole += words[k : k + len(whole)] * factors[k]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """A set's class id: a hash of the whole set."""
    return mix((mix(s ^ np.uint64(0x5BF03635)) * np.uint64(3)).sum(keepdims=True) + np.uint64(len(s)))


def sketch_of(s: np.ndarray) -> bytes:
    """Counts of hashes by their low bits, in about half as many buckets as there are hashes; counts stop at 255."""
    size = 64
    while 2 * size < len(s):
        size *= 2
    return np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def apart(sketches: np.ndarray, p: np.ndarray, q: np.ndarray, room: int = 1 << 22) -> np.ndarray:
    """Lower bounds for the number of hashes that are in one set only, for pairs of sketches (``sketches[p]``, ``sketches[q]``)."""
    out = np.zeros(len(p), np.int64)
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    flip = size[p] > size[q]
    p, q = np.where(flip, q, p), np.where(flip, p, q)
    kinds, kind = np.unique(size[p] << 32 | size[q], return_inverse=True)
    for k, both in enumerate(kinds.tolist()):
        short, long = both >> 32, both & 0xFFFFFFFF
        mine = np.flatnonzero(kind == k)
        for at in np.array_split(mine, 1 + len(mine) * long // room):
            x, y = (np.frombuffer(b"".join(sketches[i[at]]), np.uint8).reshape(len(at), -1, short) for i in (p, q))
            out[at] = np.abs(x.sum(1, dtype=np.int32) - y.sum(1, dtype=np.int32)).sum(1)
    return out


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


SETS = pa.schema([("jk", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("counts", pa.binary())])
POSTINGS = pa.schema([("token", pa.int64()), ("v", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
LISTS = pa.schema([*POSTINGS, ("size", pa.int32())])
PAIRS = pa.schema([("x", pa.int64()), ("y", pa.int64())])
OPEN = pa.schema([*PAIRS, ("cx", pa.int64()), ("cy", pa.int64()), ("spare", pa.int64())])
OVERLAPS = pa.schema([*PAIRS, ("nx", pa.int64()), ("ny", pa.int64()), ("common", pa.int64())])
COUNTS = pa.schema([("counts", pa.binary())])


def counters(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s >> np.uint64(64 - COUNTERS)).astype(np.int64), ((s >> np.uint64(64 - 2 * COUNTERS)) & np.uint64((1 << COUNTERS) - 1)).astype(np.int64)


def describe(keyed: DataFrame, size: int) -> DataFrame:
    """A row for each document (class, set size, bucket counts), and one for each task with its shingle counters."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << COUNTERS), np.int64)
        for batch in batches:
            for rows, data, off in slices(batch, limit=1 << 20):
                sets = shingle_sets(data, off, size)
                for row, at in zip(total, counters(np.concatenate(sets)), strict=True):
                    row += np.bincount(at, minlength=len(row))
                sketch = [sketch_of(s) for s in sets]
                v = signed(np.concatenate([signature(s) for s in sets]))
                yield output(SETS, {"jk": rows.column("jk"), "v": v, "n": [len(s) for s in sets], "sketch": sketch, "counts": pa.nulls(len(sets), pa.binary())})
        yield output(SETS, {"jk": [None], "v": [None], "n": [-1], "sketch": [None], "counts": [total.astype(np.int32).tobytes()]})  # one task has fewer than 2**31 shingles

    return keyed.select("jk", "text").mapInArrow(scan, ddl(SETS))


def summed(parts: DataFrame) -> bytes:
    """Sum of the tasks' counters, in two rounds of fixed-size arrays."""

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                raw = x.as_py()
                total += np.frombuffer(raw, np.int32 if len(raw) == 8 << COUNTERS else np.int64)
        yield output(COUNTS, {"counts": [total.tobytes()]})

    n = max(1, int(parts.count() ** 0.5))
    first = parts.select("counts").repartition(n).mapInArrow(add, ddl(COUNTS))
    return bytes(first.repartition(1).mapInArrow(add, ddl(COUNTS)).first()[0])


def ranks(s: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """Order from rare to common: where the smaller of a shingle's two counters stands about the usual, then its hash."""
    a, b = counters(s)
    return (np.minimum(excess[0][a], excess[1][b]).astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))


def postings(keyed: DataFrame, counts: bytes, size: int, percent: int) -> DataFrame:
    total = np.frombuffer(counts, np.int64).reshape(2, -1)
    # by sixteenths of a standard deviation about the median, in powers of two far above it
    mean = np.median(total, axis=1, keepdims=True)
    z = (total - mean) / np.sqrt(mean + 1)
    excess = np.where(z < 8, 64 + 16 * np.clip(z, -4, 8), 192 + 4 * np.log2(np.maximum(z, 8) / 8)).clip(0, 254).astype(np.uint8)
    cast = keyed.sparkSession.sparkContext.broadcast(excess)  # 2**19 bytes

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes of this task: copies need no further postings
        for batch in batches:
            for _, data, off in slices(batch, limit=1 << 20):
                token, v, n, pos = [], [], [], []
                for s in shingle_sets(data, off, size):
                    if not len(s) or (k := int(signed(signature(s))[0])) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(k)
                    p = len(s) - -(-percent * len(s) // 100) + 1
                    order = ranks(s, cast.value)
                    first = np.argpartition(order, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    token.append(s[first[np.argsort(order[first])]])
                    v.append(np.full(p, k))
                    n.append(np.full(p, len(s)))
                    pos.append(np.arange(p))
                if token:
                    yield output(POSTINGS, {"token": signed(np.concatenate(token)), "v": np.concatenate(v), "n": np.concatenate(n), "pos": np.concatenate(pos)})

    return keyed.select("text").mapInArrow(scan, ddl(POSTINGS))


def reachable(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that share a shingle at these positions can link: by size, and by what may follow the positions.

    At a pair's first common shingle nothing before it is common, and if the pair links, this holds there.
    """
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return fits & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= needed(n1, n2, percent))


def whole_lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Runs of rows that hold whole lists, from rows sorted by token; each row is copied twice at most."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        part = [batch.column(c).to_numpy() if c != "sketch" else np.array(batch.column(c).to_pylist(), object) for c in columns]
        if not len(part[0]):
            continue
        cut = int(np.searchsorted(part[0], part[0][-1]))
        if parts and (cut or part[0][0] != parts[-1][0][-1]):
            yield [np.concatenate(x) for x in zip(*parts, [x[:cut] for x in part], strict=True)]
            parts = []
        elif cut:
            yield [x[:cut] for x in part]
        parts.append([x[cut:] for x in part])
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def has_partner(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, near: int = 64) -> np.ndarray:
    """Rows, sorted by token and size, with a row in their list that they can link with; rows of lists beyond ``near`` rows are kept unseen."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(first, len(token)))
    stop = np.repeat(first + length, length)
    keep = np.repeat(length > near, length)
    i = np.flatnonzero(~keep)
    d = 1
    while len(i):
        i = i[i + d < stop[i]]
        i = i[100 * n[i] >= percent * n[i + d]]
        ok = i[reachable(n[i], pos[i], n[i + d], pos[i + d], percent)]
        keep[ok] = keep[ok + d] = True
        d += 1
    return keep


def index_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of lists that hold two classes at least, each class once, without rows that no other row of the list can link with."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, v, pos in whole_lists(batches, ["token", "n", "v", "pos"]):
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (v[1:] != v[:-1])
            token, n, v, pos = (x[fresh] for x in (token, n, v, pos))
            keep = has_partner(token, n.astype(np.int64), pos.astype(np.int64), percent)
            if keep.any():
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                length = np.diff(np.append(first, len(token)))
                yield output(LISTS, {"token": token[keep], "v": v[keep], "n": n[keep], "pos": pos[keep], "size": np.repeat(length, length)[keep]})

    return rows.repartition("token").sortWithinPartitions("token", "n", "v").select("token", "n", "v", "pos").mapInArrow(scan, ddl(LISTS))


def some_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """Candidate pairs of different components: each row with the next ones of its list, by size in one turn, in random order in the others."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, v, pos, comp in whole_lists(batches, ["token", "n", "v", "pos", "comp"]):
            if turn:
                order = np.lexsort((mix(v.view(np.uint64) + np.uint64(turn)), token))
                token, n, v, pos, comp = (x[order] for x in (token, n, v, pos, comp))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            for d in range(1, NEXT + 1):
                i = np.flatnonzero((token[d:] == token[:-d]) & (comp[d:] != comp[:-d]))
                i = i[reachable(n[i], pos[i], n[i + d], pos[i + d], percent)]
                if len(i):
                    yield output(PAIRS, {"x": np.minimum(v[i], v[i + d]), "y": np.maximum(v[i], v[i + d])})

    return rows.repartition("token").sortWithinPartitions("token", "n", "v").select("token", "n", "v", "pos", "comp").mapInArrow(scan, ddl(PAIRS))


def own_lists(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """``OWN_LISTS`` rows of each set, those with the smallest hash of their token, so that similar sets choose alike.

    Only rows from whose position a set of the same size can be reached.
    """
    near = lists.where(F.lit(100 + percent) * (F.col("n") - F.col("pos")) >= F.lit(2 * percent) * F.col("n"))
    keyed = near.select("v", F.struct(F.xxhash64(F.lit(turn), "token").alias("h"), "token", "n", "pos").alias("r"))
    least = keyed.groupBy("v").agg(*[F.min(F.when(F.pmod(F.xxhash64("r.token"), F.lit(OWN_LISTS)) == k, F.col("r"))).alias(f"r{k}") for k in range(OWN_LISTS)])
    return least.select("v", F.explode(F.array(*[f"r{k}" for k in range(OWN_LISTS)])).alias("r")).where("r IS NOT NULL").select("r.token", "v", "r.n", "r.pos")


def block_ranges(token: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first, end): for each row, the run of a block's rows with which it can link; rows sorted by token, size and position.

    Blocks are taken one after the other, a row's own first. A block is skipped whole if its size or the row's position
    forbids all links or if all its rows are of the row's component.
    """
    head = np.concatenate([[True], (token[1:] != token[:-1]) | (n[1:] != n[:-1])])
    start = np.flatnonzero(head)
    stop = np.append(start[1:], len(token))
    block = np.cumsum(head) - 1
    wide = int(pos.max()) + 2
    place = block * wide + pos
    low, high = np.minimum.reduceat(comp, start), np.maximum.reduceat(comp, start)
    i, d = np.arange(len(token)), 0
    while len(i):
        to = block[i] + d
        there = to < len(start)
        i, to = i[there], to[there]
        there = (token[start[to]] == token[i]) & (100 * n[i] >= percent * n[start[to]])
        i, to = i[there], to[there]
        last = n[start[to]] - needed(n[i], n[start[to]], percent)
        go = (pos[i] <= n[i] - needed(n[i], n[start[to]], percent)) & ((low[to] != comp[i]) | (high[to] != comp[i]))
        begin = np.maximum(start[to], i + 1)
        end = np.minimum(np.searchsorted(place, to * wide + np.minimum(last, wide - 2), "right"), stop[to])
        go &= (end > begin) & (last >= 0)
        yield i[go], begin[go], end[go]
        d += 1


def first_of_each(a: np.ndarray, b: np.ndarray, spare: np.ndarray, few: int) -> np.ndarray:
    """Whether a row is among the ``few`` with the largest spare of its (a, b)."""
    order = np.lexsort((-spare, b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = nth < few
    return out


def open_pairs(rows: DataFrame, percent: int, few: int | None = None, room: int = 1 << 18) -> DataFrame:
    """Candidate pairs of different components in lists (``token, n, v, pos, comp, sketch``) whose bucket counts leave room for the needed overlap.

    With ``few``, a set's most promising ones of each other component only.
    """

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, v, pos, comp, sketch in whole_lists(batches, ["token", "n", "v", "pos", "comp", "sketch"]):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            for i, begin, end in block_ranges(token, n, pos, comp, percent):
                for part in np.array_split(np.arange(len(i)), 1 + int((end - begin).sum()) // room):
                    size = end[part] - begin[part]
                    p = np.repeat(i[part], size)
                    q = np.arange(len(p)) + np.repeat(begin[part] - (np.cumsum(size) - size), size)
                    p, q = (x[comp[p] != comp[q]] for x in (p, q))
                    p, q = np.where(v[p] < v[q], p, q), np.where(v[p] < v[q], q, p)
                    once = np.unique(np.column_stack([v[p], v[q]]), axis=0, return_index=True)[1]
                    p, q = p[once], q[once]
                    spare = (n[p] + n[q] - apart(sketch, p, q)) // 2 - needed(n[p], n[q], percent)
                    keep = spare >= 0
                    p, q, spare = p[keep], q[keep], spare[keep]
                    if few and len(p):
                        keep = first_of_each(v[p], comp[q], spare, few) & first_of_each(v[q], comp[p], spare, few)
                        p, q, spare = p[keep], q[keep], spare[keep]
                    if len(p):
                        yield output(OPEN, {"x": v[p], "y": v[q], "cx": comp[p], "cy": comp[q], "spare": spare})

    return rows.repartition("token").sortWithinPartitions("token", "n", "pos").select("token", "n", "v", "pos", "comp", "sketch").mapInArrow(scan, ddl(OPEN))


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose bucket counts leave room for the needed overlap."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if k := batch.num_rows:
                n1, n2 = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
                far = apart(np.array(batch.column("sx").to_pylist() + batch.column("sy").to_pylist(), object), np.arange(k), k + np.arange(k))
                keep = pa.array((n1 + n2 - far) // 2 >= needed(n1, n2, percent))
                yield output(PAIRS, {"x": batch.column("x").filter(keep), "y": batch.column("y").filter(keep)})

    side = lambda k: classes.select(F.col("v").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    return pairs.distinct().join(side("x"), "x").join(side("y"), "y").mapInArrow(scan, ddl(PAIRS))


def overlaps(pairs: DataFrame, texts_of: DataFrame, size: int) -> DataFrame:
    """``x, y, nx, ny, common`` of distinct pairs, by their whole sets. ``texts_of``: ``v, text`` of each class."""
    spread = pairs.groupBy("x").agg(F.count("*").alias("k")).select("x", F.ceil(F.col("k") / FAN).cast("int").alias("parts"))
    dealt = pairs.join(spread, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int"))
    own = dealt.select("x", "part").distinct().select("x", "part", F.col("x").alias("v"), F.lit(0).alias("kind"))
    rows = dealt.select("x", "part", F.col("y").alias("v"), F.lit(1).alias("kind")).union(own).join(texts_of, "v")

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part, data, off in slices(batch, limit=1 << 20):
                sets = shingle_sets(data, off, size)
                out: list[tuple[int, ...]] = []
                for s, a, v, kind in zip(sets, *(part.column(c).to_pylist() for c in ("x", "v", "kind")), strict=True):
                    if kind == 0:
                        mine, base = a, s
                        continue
                    assert mine == a
                    both = np.concatenate([base, s])
                    both.sort()
                    out.append((a, v, len(base), len(s), int((both[1:] == both[:-1]).sum())))
                if out:
                    yield output(OVERLAPS, dict(zip(OVERLAPS.names, zip(*out, strict=True), strict=True)))

    return rows.repartition("x", "part").sortWithinPartitions("x", "part", "kind").select("x", "v", "kind", "text").mapInArrow(scan, ddl(OVERLAPS))


def least_overlap(percent: int):  # noqa: ANN201
    """``needed`` as a Column of ``nx`` and ``ny``."""
    return F.ceil(F.lit(percent) * (F.col("nx") + F.col("ny")) / F.lit(100.0 + percent) - 1e-9)


def linked(found: DataFrame, percent: int) -> DataFrame:
    return found.where(100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("x", "y")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (``v, comp``, the smallest v of each group) after new links: only components are joined, by the links between them."""
    at = lambda k: labels.select(F.col("v").alias(k), F.col("comp").alias(f"c{k}"))
    named = links.join(at("x"), "x", "left").join(at("y"), "y", "left")
    between = named.select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y")
    up = connected_components(between)
    known = labels.join(up.select(F.col("v").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("v", F.coalesce("up", "comp").alias("comp"))
    return materialize(known.union(up.join(labels, "v", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A set is a text's distinct ``size``-word shingles, or the whole word sequence where it has fewer
    words; two documents link when 100 * intersection >= percent * union. ``component_id`` is
    the smallest doc_id that links reach, itself included. Texts without words (null and empty
    ones too) link with nothing. Repeated rows and equal texts share a class; rows without doc_id take
    part and get the smallest id of their component, or null where it has none. An empty table gives
    an empty result; only doc_id and text are used.
    """
    if not 50 <= percent <= 100 or size < 1:
        raise ValueError("percent must be 50 to 100, size positive")
    bound_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("jk"), F.coalesce("text", F.lit("")).alias("text"))
    described = materialize(describe(keyed, size), "sets")
    rows = described.where("n >= 0").select("jk", "v", "n", "sketch")
    counts = summed(described.where("n < 0"))
    lists = materialize(index_lists(postings(keyed, counts, size, percent), percent), "lists")
    labels = rows.select("v", F.col("v").alias("comp")).limit(0)
    if lists.limit(1).count():
        classes = materialize(rows.join(lists.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("jk").alias("jk")), "classes")

        def compared(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.explode(F.array("x", "y")).alias("v")).distinct()
            wanted = classes.join(ends, "v", "left_semi").select("v", "jk")
            return materialize(overlaps(pairs, class_texts(keyed, wanted, size), size), "overlaps")

        for turn in range(TURNS):
            part = own_lists(lists, percent, turn).join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
            pairs = materialize(promising(some_pairs(part, percent, turn), classes, percent), f"pairs{turn}")
            links = linked(compared(pairs), percent)
            labels = merged(labels, links)
            if 50 * links.count() < classes.count():  # groups have grown as far as this finds them
                break

        def open_lists() -> DataFrame:
            part = lists.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
            mixed = part.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
            return part.join(mixed, "token", "left_semi").join(classes.select("v", "sketch"), "v")

        pairs = materialize(open_pairs(open_lists(), percent, FEW).select("x", "y").distinct(), "promising")
        labels = merged(labels, linked(compared(pairs), percent))
        pairs = materialize(open_pairs(open_lists(), percent).distinct(), "open")
        if pairs.limit(1).count():
            labels = settled(pairs, labels, compared, percent)
    joined = rows.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    least = joined.where("n > 0").groupBy("comp").agg(F.min("jk").alias("component"))
    out = joined.join(least, "comp", "left")
    return out.select(F.col("jk").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("jk")).alias("component_id"))


def settled(pairs: DataFrame, labels: DataFrame, compared: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Labels after all links among candidate pairs (``x, y, cx, cy, spare``).

    Each set is first compared with its most promising partner, and, where it meets ``DERIVE`` or more sets of a group,
    with the group's smallest set R, its label. What these answers decide, or bring into one component, is not compared.
    """
    both = pairs.select("x", "y", F.col("cy").alias("r"), "spare").union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("cx").alias("r"), "spare"))
    best = both.groupBy("x").agg(F.max(F.struct("spare", "y")).alias("o")).select("x", F.col("o.y").alias("y"))
    many = materialize(both.groupBy("x", "r").agg(F.count("*").alias("met")).where(F.col("met") >= DERIVE), "many")
    # each pair once: by the group that holds more of the partners
    told = both.join(many, ["x", "r"]).select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), F.struct("met", "r", F.col("x").alias("a"), F.col("y").alias("b")).alias("o"))
    told = materialize(told.groupBy("p", "q").agg(F.max("o").alias("o")).select("p", "q", F.col("o.r").alias("r"), F.col("o.a").alias("a"), F.col("o.b").alias("b")), "told")
    ends = told.select(F.col("a").alias("x"), F.col("r").alias("y")).union(told.select(F.col("b").alias("x"), F.col("r").alias("y")))
    ends = materialize(ends.distinct().where("x <> y"), "ends")
    found = compared(best.union(ends).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    turned = found.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("ny").alias("nx"), F.col("nx").alias("ny"), "common")
    answers = found.union(turned).join(ends.select("x", "y"), ["x", "y"], "left_semi").select(F.col("y").alias("r"), F.col("x").alias("v"), F.col("ny").alias("nr"), F.col("nx").alias("n"), "common")
    own = answers.select("r", F.col("r").alias("v"), "nr", F.col("nr").alias("n"), F.col("nr").alias("common")).distinct()  # R meets itself with its whole set
    answers = materialize(answers.union(own), "answers")
    side = lambda k, n: answers.select("r", "nr", F.col("v").alias(k), F.col("n").alias(n), F.col("common").alias(f"c{k}"))
    known = told.join(side("a", "nx"), ["r", "a"]).join(side("b", "ny").drop("nr"), ["r", "b"]).withColumn("needed", least_overlap(percent))
    known = known.withColumn("most", F.least(F.col("ca") + F.col("ny") - F.col("cb"), F.col("cb") + F.col("nx") - F.col("ca"))).withColumn("least", F.col("ca") + F.col("cb") - F.col("nr"))
    known = materialize(known.select(F.col("p").alias("x"), F.col("q").alias("y"), "needed", "most", "least"), "known")
    labels = merged(labels, linked(found, percent).union(known.where("least >= needed").select("x", "y")))
    decided = known.where("most < needed").select("x", "y").union(found.select("x", "y"))
    at = lambda k: labels.select(F.col("v").alias(k), F.col("comp").alias(f"now{k}"))
    rest = pairs.select("x", "y").join(at("x"), "x", "left").join(at("y"), "y", "left").where(F.coalesce("nowx", "x") != F.coalesce("nowy", "y"))
    rest = materialize(rest.select("x", "y").join(decided, ["x", "y"], "left_anti"), "rest")
    return merged(labels, linked(compared(rest), percent)) if rest.limit(1).count() else labels


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0xC0FFEE)) >> np.uint64(64 - bits)).astype(np.int64)


def id_filter(ids: DataFrame) -> tuple[int, bytes]:
    """(bits, bitmap) that tells most other ids from these: 16 bits for each id up to 2**27 in all, so 16 MB at most."""
    n = ids.count()
    bits = min(FILTER_BITS, max(16, int(16 * n).bit_length()))

    @lean
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            if "jk" in batch.schema.names:
                flag = np.zeros(1 << bits, bool)
                flag[slots(batch.column("jk").to_numpy(), bits)] = True
                total |= np.packbits(flag)
            else:
                for x in batch.column("counts"):
                    total |= np.frombuffer(x.as_py(), np.uint8)
        yield output(COUNTS, {"counts": [total.tobytes()]})

    parts = ids.select("jk").repartition(1 + n // 1_000_000).mapInArrow(join, ddl(COUNTS))
    return bits, bytes(parts.repartition(1).mapInArrow(join, ddl(COUNTS)).first()[0])


def class_texts(keyed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``v, text``: a text of each wanted class: that of its smallest id, or any where it has no id.

    A filter of fixed size passes over the other documents before their texts are shuffled.
    """
    wanted = materialize(wanted, "wanted")
    bits, bitmap = id_filter(wanted.where(F.col("jk").isNotNull()))
    cast = keyed.sparkSession.sparkContext.broadcast(bitmap)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = np.unpackbits(np.frombuffer(cast.value, np.uint8)).astype(bool)
        for batch in batches:
            jk = batch.column("jk")
            if jk.null_count == 0:
                batch = batch.filter(pa.array(flag[slots(jk.to_numpy(), bits)]))
            for part, data, off in slices(batch, limit=1 << 20):
                v = np.concatenate([signature(s) for s in shingle_sets(data, off, size)])
                yield pa.record_batch([pa.array(signed(v)), part.column("jk"), part.column("text")], names=["v", "jk", "text"])

    schema = "v long, jk long, text string"
    # rows that share an id can differ in text, so the class is taken from the text
    named = keyed.where(F.col("jk").isNotNull()).mapInArrow(scan, schema).join(wanted, ["v", "jk"], "left_semi")
    nameless = keyed.where(F.col("jk").isNull()).dropDuplicates(["text"]).mapInArrow(scan, schema).join(wanted.where(F.col("jk").isNull()), "v", "left_semi")
    # repeated rows share an id and a class; one text of each class goes on
    return named.select("v", "text").union(nameless.select("v", "text")).groupBy("v").agg(F.first("text").alias("text"))
