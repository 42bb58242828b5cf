"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 buckets; a document's bucket comes from a hash of its id. Each shard owns
virtual nodes; a bucket belongs to the first virtual node clockwise. Loads are bounded by an exact
capacity, so keys that meet a full shard go on clockwise to the next shard with room. Only counts
for each bucket (65,536 at most) reach the driver, which turns them into quotas; rows are then
ranked within their bucket and take the quota their rank falls into.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
BUCKETS = 1 << BITS


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Virtual nodes as (bucket, shard), clockwise."""
    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big") % BUCKETS

    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def quotas(counts: dict[int, int], shards: int, virtual_nodes: int, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Quotas (bucket, first rank, end rank, shard, first slot) that place all keys within capacity.

    First every bucket gives its own shard what fits; what is left over goes on clockwise.
    """
    nodes = ring(shards, virtual_nodes)
    room, used = list(capacity), [0] * shards
    out, waiting, at = [], [], 0

    def give(bucket: int, lo: int, n: int, shard: int) -> None:
        out.append((bucket, lo, lo + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for bucket in sorted(counts):
        while at < len(nodes) and nodes[at][0] < bucket:
            at += 1
        first, n = at % len(nodes), counts[bucket]
        shard = nodes[first][1]
        take = min(n, room[shard])
        if take:
            give(bucket, 0, take, shard)
        if take < n:
            waiting.append((bucket, take, n - take, first))
    for bucket, lo, n, first in waiting:
        step = first
        while n:
            shard = nodes[step % len(nodes)][1]
            if take := min(n, room[shard]):
                give(bucket, lo, take, shard)
                lo, n = lo + take, n - take
            step += 1
            if step - first > len(nodes):
                raise ValueError("the capacities are below the number of keys")
    return out


def shard_documents(docs: DataFrame, shards: int = 24, virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Rows of docs with ``size, text_crc32, shard, slot``: ring placement with bounded loads.

    ``slack`` is the share by which a shard may exceed the mean; 0 makes shard counts differ by at
    most one (law ``rows``). Rows without doc_id take the hash of their text; repeated rows are
    ranked in any order among themselves and each gets its own slot. Null text has size 8 and the
    crc of no bytes. An empty table gives an empty result. Only doc_id and text are used, so other
    columns cannot clash.
    """
    if shards < 1 or virtual_nodes < 1 or slack < 0:
        raise ValueError("shards and virtual_nodes must be positive, slack not negative")
    raw = F.coalesce(F.col("text"), F.lit(""))
    bucket = F.shiftrightunsigned(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), 64 - BITS).cast("int")
    counts = {r[0]: r[1] for r in docs.select(bucket.alias("b")).groupBy("b").count().collect()}  # 2**16 rows at most
    total = sum(counts.values())
    if slack:
        capacity = [max(-(-total // shards), int((1 + slack) * total / shards))] * shards
    else:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    plan = quotas(counts, shards, virtual_nodes, capacity)
    table = docs.sparkSession.createDataFrame(plan, "q_bucket int, q_lo int, q_hi int, shard int, q_slot long")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), bucket.alias("bucket"))
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    # at most 2**16 buckets plus one split for each bucket and shard that fills up: a few MB
    split = (F.col("bucket") == F.col("q_bucket")) & (F.col("rank") >= F.col("q_lo")) & (F.col("rank") < F.col("q_hi"))
    return ranked.join(F.broadcast(table), split).select("doc_id", "size", "text_crc32", "shard", (F.col("q_slot") + F.col("rank") - F.col("q_lo")).cast("long").alias("slot"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Number of documents whose shard differs between two placements of the same documents."""
    a, b = before.select("doc_id", F.col("shard").alias("a")), after.select("doc_id", F.col("shard").alias("b"))
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_moved"))
