import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import same
from skyquilt.llm import quality as Q
from skyquilt.llm import sharding as R
from skyquilt.llm import telephony as M


def test_shards_are_even_and_slots_gapless(docs, corpus, nothing):
    got = R.shard_documents(docs, 7).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in corpus])
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert R.shard_documents(nothing, 7).count() == 0


def test_bounded_loads_move_little(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    moved = R.moved(R.shard_documents(docs, 10, slack=0.25), R.shard_documents(docs, 11, slack=0.25)).first()
    assert moved.n == 4000 and moved.n_moved < 1600
    one = R.quotas({5: 100}, 3, 4, [34, 33, 33])
    assert sum(q[2] - q[1] for q in one) == 100 and len({q[3] for q in one}) == 3
    with pytest.raises(ValueError, match="capacities"):
        R.quotas({5: 100}, 3, 4, [30, 30, 30])


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_replayed_key_by_key(spark, slack):
    """Each key walks the ring by itself: its own shard while it has room, the rest clockwise afterwards."""
    shards, nodes, n = 6, 8, 3000
    ids = [int(i) for i in np.random.default_rng(6).integers(0, 10**9, n)]
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in ids], "doc_id long, text string")
    got = {(r.doc_id, r.slot): r.shard for r in R.shard_documents(docs, shards, nodes, slack).collect()}
    h = lambda i: xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
    ring = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big") % 65536, s) for s in range(shards) for v in range(nodes))
    room = [max(-(-n // shards), int((1 + slack) * n / shards))] * shards if slack else [n // shards + (s < n % shards) for s in range(shards)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    used, waiting, want = [0] * shards, [], {}

    def place(i, shard):
        want[(i, used[shard])] = shard
        used[shard] += 1
        room[shard] -= 1

    for i in sorted(ids, key=lambda i: (h(i) >> 48, signed(h(i)), i)):
        at = next((k for k, (b, _) in enumerate(ring) if b >= h(i) >> 48), 0)
        if room[ring[at][1]]:
            place(i, ring[at][1])
        else:
            waiting.append((i, at))
    for i, at in waiting:
        while not room[ring[at % len(ring)][1]]:
            at += 1
        place(i, ring[at % len(ring)][1])
    assert got == want


def test_movement_from_24_to_25_shards(spark):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    share = [R.moved(R.shard_documents(docs, 24, slack=s), R.shard_documents(docs, 25, slack=s)).first().n_moved for s in (0.0, 0.25)]
    print("moved of 10,000", share)
    assert share[0] < 1200 and share[1] < 700


def test_g711_tables_and_adpcm():
    assert (M.MULAW[0], M.MULAW[0x80], M.MULAW[0x7F], M.MULAW[0xFF]) == (-32124, 32124, 0, 0)
    assert (M.ALAW[0x55], M.ALAW[0xD5], M.ALAW[0x2A], M.ALAW[0xAA]) == (-8, 8, -32256, 32256)
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (6, 40), dtype=np.uint8)
    for b, got in zip(blocks, M.decode_adpcm(blocks), strict=True):
        value, index = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(int(b[2]), 88)
        want = [value]
        for x in b[4:]:
            for code in (int(x) & 15, int(x) >> 4):
                step = int(M.STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(M.MOVES[code & 7])))
                want.append(value)
        assert got.tolist() == want


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm"])
def test_media_column(spark, codec):
    codes = bytes(range(192)) * 2
    df = spark.createDataFrame([(1, bytearray(M.wave(codes, codec))), (2, bytearray(b"junk")), (3, None), (1, bytearray(M.wave(codes, codec)))], "k long, m binary")
    got = sorted(M.decode_column(df, "k", "m", 16_000).collect(), key=lambda r: (r.row_key, str(r.codec)))
    want = M.resample(M.to_pcm(codec, codes), 8_000, 16_000)
    assert [r.codec for r in got] == [codec, codec, None, None] and bytes(got[0].pcm) == want.astype("<i2").tobytes() and len(got[2].pcm) == 0


def test_media_round_trip(docs, corpus, nothing):
    def want(t):
        raw = (t or "").encode()
        return raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))

    got = M.media_digests(docs).collect()
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], [(d, len((t or "").encode()), len(want(t)), hashlib.sha256(want(t)).hexdigest(), zlib.crc32(want(t)[-16:])) for d, t in corpus])
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert M.media_digests(nothing).count() == 0


def test_quality_separates_held_out_rows(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    good = lambda: " ".join(rng.choice(words) for _ in range(60))
    bad = lambda: " ".join(rng.choice(words).upper() + rng.choice(["!!", "$$$", "###"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(300)] + [(900, None, 1), (901, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.score(docs, labels).withColumn("h", Q.held_out(F.col("doc_id"))).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(got[r[0]].h for r in held) and not any(got[r[0]].h for r in rows[:300] if r not in held)
    assert sum(got[r[0]].predicted == r[2] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score


def test_quality_without_labels_or_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(nothing, none).count() == 0


def test_scores_against_brute_force(spark, docs):
    """Scores worked out text by text from the fitted model, on nulls, repeated rows and long texts too; no held-out label is used."""
    rng = random.Random(4)
    good, bad = "the river ran past a quiet stone village in autumn".split(), "win cash now click here free $$$ bonus".split()
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(20, 80))) for i in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])] * 5, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = [(i, i % 2) for i in range(120)]
    model = Q.fit(rows, spark.createDataFrame(labels + labels[:9], "doc_id long, quality int"))
    flipped = [(i, 1 - q if held(i) else q) for i, q in labels]
    assert Q.fit(rows, spark.createDataFrame(flipped, "doc_id long, quality int")) == model
    c = Q.Compressors(model)

    def want(text):
        a = Q.design(np.array([c.features((text or "").encode())]))[0]
        return 1 / (1 + np.exp(-np.clip(a @ np.array(model.weights) + model.shift, -30, 30)))

    odd = [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, texts[4]), (1003, texts[4]), (1003, texts[4])]
    score = Q.score_udf(spark, model)
    got = spark.createDataFrame(odd + list(enumerate(texts)), "doc_id long, text string").select("text", score(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert len(got) == 126 and all(r.s == pytest.approx(want(r.text), abs=1e-9) for r in got)
    assert sum((want(t) >= 0.5) == bool(i % 2) for i, t in enumerate(texts) if held(i)) >= 0.95 * sum(map(held, range(120)))


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Texts beyond the bound stay on the executors; repeated ids count once."""
    rows = spark.createDataFrame([(i, "word " * 200) for i in range(60)] + [(1, "word " * 200)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "SAMPLE_BYTES", 5000)
    monkeypatch.setattr(Q, "train_dictionary", lambda samples: seen.append(sum(map(len, samples))) or b"")
    Q.fit(rows, labels)
    assert seen and all(0 < n <= 5000 for n in seen)
