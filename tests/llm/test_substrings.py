import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import same
from skyquilt.llm import substring_dedup as S
from skyquilt.llm.common import FREE_SHUFFLES


def brute(rows, length):
    encoded = [(t or "").encode() for _, t in rows]
    count = Counter(e[i : i + length] for e in encoded for i in range(len(e) - length + 1))
    out = []
    for (doc, _), e in zip(rows, encoded, strict=True):
        gone = np.zeros(len(e), bool)
        for i in range(len(e) - length + 1):
            if count[e[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(e, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(e), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("gram", "group"), [(16, 256), (8, 1)])
def test_against_brute_force(docs, corpus, gram, group):
    got = S.remove_repeats(docs, 60, gram, group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, brute(corpus, 60))


def test_at_400_bytes_with_repeated_rows(spark):
    """The production length, on passages of 399 to 900 bytes, and many equal rows, with and without an id."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passages = [word(n) for n in (399, 400, 401, 650, 900)]
    rows = [(i, word(int(rng.integers(0, 500))) + passages[i % 5] + "é" + word(30)) for i in range(25)]
    rows += [(100, rows[3][1])] * 60 + [(None, word(849))] * 60 + [(None, None), (101, "")]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, brute(rows, 400))


def test_repeated_rows_in_proportion(spark):
    """Ten thousand equal rows, half of them without an id."""
    text = "".join(map(chr, np.random.default_rng(4).integers(97, 123, 849)))
    rows = spark.range(10_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 END AS doc_id").withColumn("text", F.lit(text))
    got = S.remove_repeats(rows).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in got] == [(849, 849, 1, 10_000)]


def test_empty_table_and_bad_limits(nothing, docs):
    assert S.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError, match="gram"):
        S.remove_repeats(docs, 10, 20)


def test_kernel_on_periodic_and_weighted_stretches():
    parts = [b"ab" * 40, b"xyz" + b"ab" * 20, b"unique-stretch-of-forty-eight-bytes-in-all-here!", b"lone but counted twice in the corpus, as weight"]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    found = S.repeated_starts(np.frombuffer(b"".join(parts), np.uint8), off, np.array([1, 1, 1, 2]), 30)
    runs = [found[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert runs[0][:51].all() and not runs[1][:3].any() and runs[1][3:14].all() and not runs[2].any() and runs[3][:18].all()


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.length())) if f.getName().startswith("shuffle_"))


def test_one_copy_of_the_texts_in_shuffle_files(spark):
    """Steps leave no shuffle files behind, so that only the result's own shuffle of whole texts is there at the end."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(33, 127, n)))
    passages = [word(450) for _ in range(20)]
    rows = [(i, word(2000) + passages[i % 20] + word(2000)) for i in range(200)]
    docs, setting, before = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get(FREE_SHUFFLES), shuffle_bytes(spark)
    result = S.remove_repeats(docs)
    assert spark.conf.get(FREE_SHUFFLES) == setting
    for _ in range(100):  # files go in the background; a row count may leave a few bytes
        if shuffle_bytes(spark) - before < 1000:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) - before < 1000
    same(result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute(rows, 400))
    assert shuffle_bytes(spark) - before < 1.5 * sum(len(t) for _, t in rows)
