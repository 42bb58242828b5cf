"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to islands; an island
evolves packings whose genes are whole bins: crossover injects well-filled bins of another
parent, bins that would use a piece twice go, and displaced pieces are exchanged for pieces of other
bins where that fills them better, and best-fitted again. Islands whose best-fit packing already
meets the lower bound of bins need no generations. Between epochs islands pass on elites: the length patterns of their best bins, which the next island
injects wherever its own pieces have those lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.bpe import encoder
from skyquilt.llm.common import bound_batches, ddl, lean, materialize, output, slices, texts

CAPACITY = 4096
#: Pieces of an island; the number of islands grows with the input.
ISLAND_PIECES = 12_000
EPOCHS = 2
GENERATIONS = 40
POPULATION = 6
#: Generations without a better packing after which an island stops.
PATIENCE = 8
#: Bins in which a child tries exchanges with its displaced pieces.
EXCHANGES = 300
ELITES = 64

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenize_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``; only documents over ``capacity`` tokens are cut."""
    bound_batches(docs.sparkSession)

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_file, False, end_id)
        for batch in batches:
            for rows, data, off in slices(batch, limit=1 << 20):
                flat, n = bpe.encode(data, off)
                flat, begin = flat.astype("<u4", copy=False), np.cumsum(n) - n
                cut = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), cut)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cut) - cut, cut)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip((begin[row] + start).tolist(), (begin[row] + start + length).tolist(), strict=True)]
                yield output(PIECES, {"doc_id": rows.column("doc_id").take(pa.array(row)), "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(encode, ddl(PIECES))


Bins = list[list[int]]


class Island:
    """Evolves packings of its pieces; a packing is a list of bins of piece numbers."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int) -> None:
        self.lengths, self.capacity = lengths.tolist(), capacity
        self.random = np.random.default_rng(seed)

    def fill(self, b: list[int]) -> int:
        return sum(self.lengths[i] for i in b)

    def best_fit(self, bins: Bins, items: list[int], noise: float = 0.0) -> Bins:
        """Items, longest first (``noise`` blurs the order), each into the fullest bin with room."""
        order = sorted(items, key=lambda i: -self.lengths[i] * (1 + noise * self.random.random()))
        room = [self.capacity - self.fill(b) for b in bins]
        free = sorted((r, k) for k, r in enumerate(room) if r)
        for i in order:
            n = self.lengths[i]
            at = bisect_left(free, (n, -1))
            if at < len(free):
                r, k = free.pop(at)
                bins[k].append(i)
            else:
                r, k = self.capacity, len(bins)
                bins.append([i])
            if r > n:
                insort(free, (r - n, k))
        return bins

    def exchange(self, bins: Bins, loose: list[int]) -> list[int]:
        """Swaps one or two pieces of a bin for one or two displaced ones wherever that fills the bin better; returns what is displaced then."""
        stock = sorted((self.lengths[i], i) for i in loose)
        for k in self.random.permutation(len(bins))[:EXCHANGES].tolist():
            b = bins[k]
            room = self.capacity - self.fill(b)
            if not room or not stock:
                continue
            best: tuple[int, list[int], list[tuple[int, int]]] = (0, [], [])
            for out in [[i] for i in b] + ([[i, j] for n, i in enumerate(b) for j in b[:n]] if len(b) <= 8 else []):
                old = sum(self.lengths[i] for i in out)
                space = room + old
                at = bisect_left(stock, (space + 1, -1)) - 1
                if at >= 0 and stock[at][0] - old > best[0]:
                    best = (stock[at][0] - old, out, [stock[at]])
                for x in self.random.integers(0, len(stock), min(len(stock), 16)).tolist():
                    rest = space - stock[x][0]
                    at = bisect_left(stock, (rest + 1, -1)) - 1
                    at -= at == x
                    if rest > 0 and at >= 0 and stock[at][0] + stock[x][0] - old > best[0]:
                        best = (stock[at][0] + stock[x][0] - old, out, [stock[x], stock[at]])
            gain, out, new = best
            if gain:
                bins[k] = [i for i in b if i not in out] + [i for _, i in new]
                for x in new:
                    stock.remove(x)
                for i in out:
                    insort(stock, (self.lengths[i], i))
        return [i for _, i in stock]

    def cost(self, bins: Bins) -> float:
        """Fewer bins first; among equals, uneven fill leaves more room to gain."""
        return len(bins) - sum((self.fill(b) / self.capacity) ** 2 for b in bins) / max(len(bins), 1)

    def crossover(self, a: Bins, b: Bins, share: float = 0.3) -> Bins:
        """Bins of a, with some of the fullest bins of b injected."""
        ranked = sorted(range(len(b)), key=lambda k: -self.fill(b[k]))
        chosen = [k for k in ranked[: max(1, int(len(b) * 2 * share))] if self.random.random() < 0.5]
        injected = [list(b[k]) for k in chosen]
        used = {i for x in injected for i in x}
        whole, displaced = [], []
        for x in a:
            if used.isdisjoint(x):
                whole.append(list(x))
            else:
                displaced += [i for i in x if i not in used]
        bins = injected + whole
        return self.best_fit(bins, self.exchange(bins, displaced))

    def mutate(self, bins: Bins, share: float = 0.03) -> Bins:
        """Empties the least filled bins and a few others; their pieces are exchanged for others and best-fitted."""
        ranked = sorted(range(len(bins)), key=lambda k: self.fill(bins[k]))
        n = max(2, int(len(bins) * share))
        gone = set(ranked[:n]) | {ranked[k] for k in self.random.integers(0, len(ranked), n)} if ranked else set()
        kept = [list(b) for k, b in enumerate(bins) if k not in gone]
        return self.best_fit(kept, self.exchange(kept, [i for k in gone for i in bins[k]]), 0.02)

    def inject(self, patterns: list[tuple[int, ...]]) -> Bins:
        """A packing that starts from bins with the given lengths, as far as the pieces allow."""
        by_length: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths):
            by_length.setdefault(n, []).append(i)
        bins = []
        for p in patterns:
            if all(len(by_length.get(n, ())) >= p.count(n) for n in p):
                bins.append([by_length[n].pop() for n in p])
        return self.best_fit(bins, [i for left in by_length.values() for i in left])

    def least_bins(self) -> int:
        """A lower bound: all tokens, or for some k the pieces over half a bin and what of those from k to half does not fit beside them."""
        n, cap = np.array(self.lengths, np.int64), self.capacity
        bound = -(-int(n.sum()) // cap)
        for k in np.unique(n[2 * n <= cap])[:: max(1, len(np.unique(n[2 * n <= cap])) // 64)].tolist():
            alone, half, rest = n > cap - k, (2 * n > cap) & (n <= cap - k), (n >= k) & (2 * n <= cap)
            over = int(n[rest].sum()) - (int(half.sum()) * cap - int(n[half].sum()))
            bound = max(bound, int(alone.sum()) + int(half.sum()) + max(0, -(-over // cap)))
        return max(bound, int((2 * n > cap).sum()))

    def evolve(self, patterns: list[tuple[int, ...]], generations: int, population: int) -> Bins:
        everything = list(range(len(self.lengths)))
        bound = self.least_bins()
        pool = [self.best_fit([], everything), self.inject(patterns)]
        if min(map(len, pool)) > bound:
            pool += [self.best_fit([], everything, 0.01 * k) for k in range(1, population - 1)]
        pool.sort(key=self.cost)
        idle = 0
        for _ in range(generations):
            if len(pool[0]) <= bound or idle == PATIENCE:
                break
            before = min(map(len, pool))
            a, b = (pool[int(k)] for k in self.random.choice(len(pool), 2, replace=False))
            for child in (self.crossover(a, b), self.mutate(a)):
                if self.cost(child) < self.cost(pool[-1]):
                    pool[-1] = child
                    pool.sort(key=self.cost)
            idle = 0 if min(map(len, pool)) < before else idle + 1
        return pool[0]

    def elites(self, bins: Bins, n: int) -> list[list[int]]:
        ranked = sorted((b for b in bins if len(b) > 1), key=lambda b: (-self.fill(b), len(b)))
        return [sorted((self.lengths[i] for i in b), reverse=True) for b in ranked[:n]]


PLACES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, elites: int = ELITES) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``, in as few sequences as found.

    Islands hold about ``island_pieces`` pieces of at most ``capacity`` tokens, dealt by a hash of
    their place in the written table, so that equal rows spread too; repeated rows are separate pieces. Of elites, ``elites`` bins for each island migrate to the next
    one. An empty table gives an empty result.
    """
    kept = materialize(pieces, "pieces")  # tokenized once, read by the count and by each epoch
    islands = max(1, round(kept.count() / island_pieces))
    dealt = kept.withColumn("island", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(islands)).cast("int"))

    @lean
    def solve(pdf, foreign, emit_elites: bool, epoch: int):  # noqa: ANN001
        import pandas as pd

        pdf = pdf.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        island = int(pdf["island"].iloc[0])
        world = Island(pdf["length"].to_numpy(), capacity, 1_000_003 * epoch + island)
        bins = world.evolve([tuple(p) for p in foreign], generations, population)
        if emit_elites:
            return pd.DataFrame({"to_island": (island + 1) % islands, "pattern": world.elites(bins, elites)})
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += world.lengths[i]
        return pdf.assign(sequence_id=(island << 32) + sequence, offset=offset)[[f.name for f in PLACES]]

    def alone(epoch: int, final: bool):
        return lambda pdf: solve(pdf, [], not final, epoch)

    def visited(epoch: int, final: bool):
        names = [x.name for x in PLACES] if final else ["to_island", "pattern"]
        return lambda pdf, m: solve(pdf, m["pattern"], not final, epoch) if len(pdf) else pdf.reindex(columns=names)

    groups = dealt.groupBy("island")
    migrants = None
    for epoch in range(epochs):
        final = epoch == epochs - 1
        schema = ddl(PLACES) if final else "to_island int, pattern array<long>"
        if migrants is None:
            result = groups.applyInPandas(alone(epoch, final), schema)
        else:
            result = groups.cogroup(migrants.groupBy("to_island")).applyInPandas(visited(epoch, final), schema)
        migrants = None if final else materialize(result, f"elites{epoch}")
    return result


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize whole texts (null: empty, one end token) and pack all pieces; extra columns are not carried."""
    return pack(tokenize_pieces(docs, tokenizer_file, end_id, capacity), capacity)
