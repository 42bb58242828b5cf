import re
import string

import numpy as np
import pytest

from llm_helpers import same
from skyquilt.llm import jaccard_join as J
from skyquilt.llm.components import connected_components

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sets(rows, size=4):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute(rows, size=4, percent=85):
    s, parent = sets(rows, size), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and min(len(s[i]), len(s[j])) * 100 >= percent * max(len(s[i]), len(s[j])) and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s[i]), least.get(root(i)) if s[i] else d) for i, (d, _) in enumerate(rows)]


def test_against_brute_force(docs, corpus, nothing):
    same(J.near_duplicates(docs).collect(), brute(corpus))
    assert J.near_duplicates(nothing).count() == 0


def test_chains_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            w[k] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert 1 < len({r[2] for r in want}) < 120
    same(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 30) :], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        both = np.array([J.sketch_of(a), J.sketch_of(b)], object)
        assert J.apart(both, np.array([0, 1]), np.array([1, 0])).max() <= apart


def test_blocks_hold_all_reachable_pairs():
    """Skipping whole blocks finds what testing each pair by size and position finds."""
    rng = np.random.default_rng(2)
    rows = sorted((int(t), int(n), int(rng.integers(0, max(1, n // 5)))) for t, n in zip(rng.integers(0, 6, 400), rng.integers(1, 60, 400), strict=True))
    token, n, pos = (np.array(x) for x in zip(*rows, strict=True))
    comp = rng.integers(0, 30, 400)
    got = {(i, j) for i_, a_, b_ in J.block_ranges(token, n, pos, comp, 80) for i, a, b in zip(i_.tolist(), a_.tolist(), b_.tolist(), strict=True) for j in range(a, b) if comp[i] != comp[j]}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if token[i] == token[j] and comp[i] != comp[j] and J.reachable(n[i], pos[i], n[j], pos[j], 80)}
    assert want and got == want


def test_a_dense_group_among_outsiders(spark):
    """Many near copies of one text, texts just outside, and repeated rows: answers derived from one set leave the result whole."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 3) if i % 4 else rng.integers(3, 7)):
            w[k] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(500, rows[0][1])] * 40 + [(None, rows[0][1])] * 40
    want = brute(rows)
    assert 3 < len({r[2] for r in want}) < 100
    same(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)


def test_long_words_are_told_apart():
    """Words that a polynomial modulo 2**64 cannot tell apart."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    one, two = J.shingle_sets(data[: len(a)], np.array([0, len(a)]), 4) + J.shingle_sets(data[len(a) + 1 :], np.array([0, len(b)]), 4)
    assert one[0] != two[0]


@pytest.mark.parametrize("small", [0, 1 << 17])
def test_components(spark, small):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "x long, y long")
    assert {r.v: r.comp for r in connected_components(edges, small).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_shuffled_paths(spark):
    """Paths whose order is not that of their ids: labels that only cross one vertex a round need hundreds of rounds."""
    rng = np.random.default_rng(0)
    paths = [rng.permutation(1_000), 1_000 + rng.permutation(1_000)]
    edges = spark.createDataFrame([(int(a), int(b)) for p in paths for a, b in zip(p[:-1], p[1:], strict=True)], "x long, y long")
    assert {r.v: r.comp for r in connected_components(edges, 0).collect()} == {v: v // 1_000 * 1_000 for v in range(2_000)}


def test_bad_limits(docs):
    with pytest.raises(ValueError, match="percent"):
        J.near_duplicates(docs, percent=20)
