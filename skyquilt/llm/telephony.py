"""Telephony audio columns: G.711 by lookup tables, IMA ADPCM across blocks, resampled PCM.

A stored form is a RIFF/WAVE file that keeps its 8-bit codes as they are, beside a PCM column at
the wanted rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import bound_batches, ddl, materialize, output, slices, texts

RATE = 8_000
FRAME = 192
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: complemented code, 3 bits of segment, 4 bits of step, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, 3 bits of segment, 4 bits of step."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


#: Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
    9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM mono blocks, shape (blocks, bytes), to int16 samples, shape (blocks, 1 + 2 * (bytes - 4)).

    Samples of a block follow one another, blocks do not, so each step handles all blocks at once.
    """
    blocks = np.ascontiguousarray(blocks)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for k in range(len(out) - 1):
        code = codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15
        step, size = STEPS[index], code & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[size], 0, 88)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Mean over each output interval when the rate falls by a whole factor, else linear between samples."""
    if rate_in == rate_out or not len(pcm):
        return pcm.astype(np.int16)
    if rate_in % rate_out == 0:
        k = rate_in // rate_out
        n = -(-len(pcm) // k)
        padded = np.concatenate([pcm, np.full(n * k - len(pcm), pcm[-1], pcm.dtype)]).reshape(n, k)
        return np.rint(padded.mean(axis=1)).astype(np.int16)
    at = np.arange(len(pcm) * rate_out // rate_in) * (rate_in / rate_out)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def wave(codes: bytes, codec: str, rate: int = RATE) -> bytes:
    """RIFF/WAVE file around codes as they are."""
    align = FRAME if codec == "ima_adpcm" else 1
    per_block = 2 * (align - 4) + 1 if codec == "ima_adpcm" else 1
    extra = struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * align // per_block, align, 4 if codec == "ima_adpcm" else 8) + extra
    fact = struct.pack("<I", len(codes) // align * per_block)
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in ((b"fmt ", form), (b"fact", fact), (b"data", codes)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[str | None, int, bytes]:
    """(codec, rate, codes) of a telephony file; codec None for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None, 0, b""
    codec, rate, codes, at = None, 0, b"", 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        part = media[at + 8 : at + 8 + size]
        if name == b"fmt " and len(part) >= 16:
            tag, _, rate = struct.unpack_from("<HHI", part)
            codec = {v: k for k, v in TAGS.items()}.get(tag)
        elif name == b"data":
            codes = part
        at += 8 + size + (size & 1)
    return codec, rate, codes


def to_pcm(codec: str, codes: bytes) -> np.ndarray:
    """Samples at the stored rate; ADPCM codes are whole blocks of 192 bytes, a rest is ignored."""
    data = np.frombuffer(codes, np.uint8)
    if codec == "mulaw":
        return MULAW[data]
    if codec == "alaw":
        return ALAW[data]
    return decode_adpcm(data[: len(data) // FRAME * FRAME].reshape(-1, FRAME)).reshape(-1)


PCM = pa.schema([("row_key", pa.int64()), ("codec", pa.string()), ("rate", pa.int32()), ("pcm", pa.binary())])


def decode_column(media: DataFrame, key: str, column: str, rate: int = 16_000) -> DataFrame:
    """``row_key, codec, rate, pcm`` for each media row: 16-bit little-endian PCM resampled to ``rate``.

    Null or foreign bytes give codec null and empty PCM; repeated rows are decoded each.
    """
    bound_batches(media.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time: a file may be long
                codec, stored, codes = unwave(batch.column("media")[i].as_py() or b"")
                pcm = resample(to_pcm(codec, codes), stored, rate).astype("<i2").tobytes() if codec else b""
                yield output(PCM, {"row_key": batch.column("row_key").slice(i, 1), "codec": [codec], "rate": [rate], "pcm": [pcm]})

    return media.select(F.col(key).cast("long").alias("row_key"), F.col(column).alias("media")).mapInArrow(decode, ddl(PCM))


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("pcm", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_payloads(docs: DataFrame, pcm_rate: int = 1_000) -> DataFrame:
    """``doc_id, n_bytes, media, pcm``: each text's bytes, padded with spaces to whole frames, as a mu-law file and as resampled PCM."""
    bound_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch):
                n = np.diff(off)
                media, pcm = [], []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    codes = data[a:b].tobytes() + b" " * (max(1, -(-(b - a) // FRAME)) * FRAME - (b - a))
                    media.append(wave(codes, "mulaw"))
                    pcm.append(resample(to_pcm("mulaw", codes), RATE, pcm_rate).astype("<i2").tobytes())
                yield output(MEDIA, {"doc_id": rows.column("doc_id"), "n_bytes": n, "media": media, "pcm": pcm})

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(store, ddl(MEDIA))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, dtype=np.int64)


def describe(stored: DataFrame) -> DataFrame:
    """Digests and features of stored files, from the bytes read back.

    ``feature``: per document, the mean square of the mu-law and A-law readings, the sign changes of
    the mu-law one, the mean size of the ADPCM reading of the frames, and the crc of the stored PCM.
    """
    bound_batches(stored.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in slices(batch, "media"):
                media = rows.column("media").to_pylist()
                codes = [unwave(m)[2] for m in media]
                flat = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, FRAME)
                frames = np.fromiter((len(c) // FRAME for c in codes), np.int64, len(codes))
                first = np.cumsum(frames) - frames
                mu, a = MULAW[flat].astype(np.int64), ALAW[flat].astype(np.int64)
                mu2, a2 = sums((mu * mu).sum(1), first), sums((a * a).sum(1), first)
                signs = sums(((mu[:, 1:] < 0) != (mu[:, :-1] < 0)).sum(1), first)
                adpcm = sums(np.abs(decode_adpcm(flat).astype(np.int32)).sum(1), first)
                n = frames * FRAME
                pcm = rows.column("pcm").to_pylist()
                feature = [f"mulaw_ms={m // k};alaw_ms={b // k};sign_changes={s};adpcm_mean={d // (f * 377)};pcm_samples={len(p) // 2};pcm_crc32={zlib.crc32(p)}" for m, b, s, d, k, f, p in zip(mu2.tolist(), a2.tolist(), signs.tolist(), adpcm.tolist(), n.tolist(), frames.tolist(), pcm, strict=True)]
                yield output(FEATURES, {
                    "doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes"), "payload_bytes": n,
                    "payload_sha256": [hashlib.sha256(c).hexdigest() for c in codes], "tail_crc32": [zlib.crc32(c[-16:]) for c in codes],
                    "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": feature,
                })

    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(features, ddl(FEATURES))


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every whole text (null: empty) as telephony audio, read it back and describe it.

    One row for each input row, ties and repeated rows included; an empty table gives none. Only
    doc_id and text are used, so other columns cannot clash.
    """
    return describe(materialize(store_payloads(docs), "media"))
