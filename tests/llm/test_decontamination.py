import hashlib
import re

import pytest

from llm_helpers import same
from skyquilt.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(item)
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = [False] * len(w), set()
        for win, ids in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit[j : j + len(win)] = [True] * len(win)
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return out


def contaminated(texts, items, window=10):
    """Numbers of the texts in which a window of an item occurs."""
    windows = {}
    for w in map(words, items):
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(k, set()).add(tuple(w[j : j + k]))
    split = [words(t) for t in texts]
    return [n for n, w in enumerate(split) if any(tuple(w[j : j + k]) in known for k, known in windows.items() for j in range(len(w) - k + 1))]


@pytest.fixture(scope="module")
def items(corpus):
    long = corpus[0][1] + " " + corpus[5][1]
    return [(1, " ".join(words(corpus[31][1])[10:40])), (2, "EIN, zwei-drei!"), (3, long), (3, "x"), (10, None), (11, ""), (None, " ".join(words(corpus[45][1])[50:64])), (12, "x")]


@pytest.mark.parametrize("block", [1 << 20, 120])
def test_against_brute_force(spark, docs, corpus, items, block):
    got = D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), 10, block)
    same(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), brute(corpus, items, 10))


def test_dropping(spark, docs, corpus, items, nothing):
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [r[0] for r in brute(corpus, items, 10) if not r[5]]
    for block in (1 << 20, 120):
        kept = D.drop_contaminated(docs, bench, 10, block)
        assert kept.columns == docs.columns
        same([(r.doc_id,) for r in kept.collect()], [(i,) for i in clean])
    assert D.find_contamination(nothing, bench).count() == 0
    assert D.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_skips_and_long_lanes():
    import numpy as np

    text = ("one two three four five " * 300 + "needle in the hay stack today").encode()
    w = D.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    (p,) = D.compile_patterns([("n", "needle in the hay stack")], 5)
    assert p.shift.max() == 4 and [i for i, _ in p.occurrences(w)] == [1504]
