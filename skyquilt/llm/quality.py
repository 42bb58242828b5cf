"""Quality classifier: compressed sizes under dictionaries of good and of bad labelled text.

Two zstandard dictionaries come from bounded samples of labelled texts. A text is cut into blocks,
each block is compressed with either dictionary, and the difference of the summed sizes, divided
by the size without a dictionary, becomes a score by a logistic fit on other labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.common import bound_batches

#: Labelled rows of each class that the fit may use at most; half make the dictionary, half the calibration.
SAMPLE_PER_CLASS = 2_000
#: Sampled texts go to the driver as long as they come to this many bytes in all per class.
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 112 << 10
BLOCK = 1_536
LEVEL = 3
FOLDS = 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    shift: float


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train one."""
    import zstandard

    parts = [b for s in samples for b in blocks(s)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Compressors:
    def __init__(self, model: Model) -> None:
        import zstandard

        def plain(d: bytes | None) -> zstandard.ZstdCompressor:
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if not d:
                return zstandard.ZstdCompressor(**options)
            kind = zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            data = zstandard.ZstdCompressionDict(d, dict_type=kind)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=data, **options)

        self.good, self.bad, self.none = plain(model.good), plain(model.bad), plain(None)

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Normalised size difference (above 0: nearer to good text), the same damped for short texts, and its own compressibility."""
        parts = blocks(text)
        g, b, n = (sum(len(c.compress(p)) for p in parts) for c in (self.good, self.bad, self.none))
        d = (b - g) / max(n, 1)
        return d, d * min(1.0, len(text) / 400), min(g, b) / max(len(text), 1) if text else 1.0


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0] * 10, x[:, 1] * 10, x[:, 2]])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic regression, classes weighted alike."""
    a = design(x)
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - ridge * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``SAMPLE_PER_CLASS`` rows of each label, those with the smallest hash of doc_id, never on held-out ones.

    Of these, texts count in that order up to ``SAMPLE_BYTES`` a label; Spark cuts them off, so the driver never holds more.
    Class shares come from all labelled rows outside the held-out fold. Rows without doc_id or label
    are left out, repeated ids count once (with the lower label, and the first text by order); with no
    labelled rows every text scores the same.
    """
    known = labels.select(F.col("doc_id").alias("d"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("d").isNotNull() & ~held_out(F.col("d")))
    ids = known.groupBy("d").agg(F.min("quality").alias("quality"))
    shares = {r[0]: r[1] for r in ids.groupBy("quality").count().collect()}
    smallest = [ids.where(F.col("quality") == label).orderBy(F.xxhash64("d"), "d").limit(SAMPLE_PER_CLASS) for label in (0, 1)]
    texts = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).join(F.broadcast(smallest[0].union(smallest[1])), F.col("doc_id") == F.col("d")).where(F.octet_length("raw") > 0)
    # two windows of SAMPLE_PER_CLASS rows at most
    so_far = F.sum(F.octet_length("raw")).over(Window.partitionBy("quality").orderBy("h", "d"))
    rows = texts.groupBy("quality", "d").agg(F.min("raw").alias("raw")).withColumn("h", F.xxhash64("d")).withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES)
    sample: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.orderBy("quality", "h", "d").select("quality", "raw").collect():
        sample[r[0]].append(bytes(r[1]))
    model = Model(train_dictionary(sample[1][::2]), train_dictionary(sample[0][::2]), (0.0, 0.0, 0.0, 0.0), 0.0)
    good, bad = sample[1][1::2], sample[0][1::2]
    if not good or not bad:
        return model
    c = Compressors(model)
    x = np.array([c.features(t) for t in good + bad])
    y = np.repeat([1.0, 0.0], [len(good), len(bad)])
    return Model(model.good, model.bad, tuple(fit_logistic(x, y)), float(np.log(shares[1] / shares[0])))


def score_udf(spark, model: Model):
    """A Column function from text to score in [0, 1]."""
    import pandas as pd

    bound_batches(spark)
    cast = spark.sparkContext.broadcast(model)  # two dictionaries of at most 112 KiB

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, c = cast.value, Compressors(cast.value)
        for batch in batches:
            x = np.array([c.features(t.encode()) for t in batch], float).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(design(x) @ np.array(m.weights) + m.shift, -30, 30))))

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scored, "double")


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """All columns of docs with ``score`` and ``predicted`` (1 from ``threshold`` on), by a model fitted on labels.

    Every whole text is scored, null as empty; repeated rows score alike. Columns of docs that are
    named score or predicted are replaced. An empty table gives an empty result.
    """
    scored = score_udf(docs.sparkSession, fit(docs, labels))
    return docs.withColumn("score", scored(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
