import zlib

import numpy as np
import pytest

from llm_helpers import same
from skyquilt.llm import packing as P
from skyquilt.llm import token_store as T
from skyquilt.llm.bpe import Encoder
from skyquilt.llm.common import fresh_path

tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

BYTE, WORD = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b", "\n \n a\n  b", "a ", "\t a", "x  y", "a　b c", "a\x00 b", "I'm don't 's", "e ́", "Σ ΣA.b..c, d", "a\n b", "日本 語 ", "à.é×.", "q\n\nr\ns", "\n", "x\n", "\nx", "a  b", "​ a᠎ b", "<|endoftext|> x", "12 34.5,6"]


def plain(file, texts, end):
    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("file", "spaces"), [(BYTE, True), (WORD, False)])
def test_pieces_give_the_ids_of_whole_texts(file, spaces, corpus):
    texts = ODD + [t or "" for _, t in corpus]
    enc = Encoder(file, spaces, 9, limit=200)
    for _ in range(2):  # learned, forgotten and learned again
        raw = [t.encode() for t in texts]
        ids, n = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [x.tolist() for x in plain(file, texts, 9)]


def test_store_round_trip(spark, docs, corpus, nothing):
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    ids = plain(BYTE, [t for _, t in rows], 0)
    n = np.array([len(x) for x in ids])
    want = [(d, int(s), int(k), zlib.crc32(x.tobytes())) for (d, _), s, k, x in zip(rows, np.cumsum(n) - n, n, ids, strict=True)]
    path = fresh_path(spark, "tokens")
    T.write_tokens(docs, path, BYTE)
    same(T.token_digests(spark, path).collect(), want)
    one = T.read_tokens(spark, path).where("doc_id = 57").first()
    assert one.ids == ids[[d for d, _ in rows].index(57)].tolist()
    assert T.tokenize_and_digest(nothing, BYTE).count() == 0


def test_rows_of_one_id_follow_their_texts(spark):
    """Across ranges too: rows without an id and rows of one id, with common beginnings, in the order of their bytes."""
    r = np.random.default_rng(6)
    heads = ["", "é", "z" * 40, "\U0001f600", "\uffee", "A"]
    rows = [(i, heads[k % 6] + " ".join(map(str, r.integers(0, 1000, int(r.integers(0, 30)))))) for i in (None, 7, 8) for k in range(200)]
    path = fresh_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, BYTE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    ids = plain(BYTE, [t for _, t in rows], 0)
    got = T.read_tokens(spark, path).orderBy("start").collect()
    assert [(x.doc_id, x.ids) for x in got] == [(d, x.tolist()) for (d, _), x in zip(rows, ids, strict=True)]
    assert spark.read.parquet(path).where("doc_id IS NULL").select("part").distinct().count() > 1


def test_file_format(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    T.write_tokens(docs, path, BYTE)
    found = False
    for f in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            by = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            if meta.row_group(g).num_rows > 5:
                found = True
                assert any("DICTIONARY" in e for e in by["ids"].encodings) and by["doc_id"].has_column_index
    assert found


def test_pieces(docs, corpus):
    ids = plain(WORD, [t for _, t in corpus], 1)
    want = [(d, k // 64, k, len(x[k : k + 64]), zlib.crc32(x[k : k + 64].tobytes())) for (d, _), x in zip(corpus, ids, strict=True) for k in range(0, len(x), 64)]
    same(P.tokenize_pieces(docs, WORD, 1, 64).collect(), want)


@pytest.mark.parametrize("size", [40, 10_000])
def test_packing_is_complete_and_tight(docs, size, nothing):
    pieces = P.tokenize_pieces(docs, WORD, 1, 128)
    got = P.pack(pieces, 128, island_pieces=size).toPandas()
    same(got[["doc_id", "piece", "length"]].astype(object).where(got[["doc_id", "piece", "length"]].notna(), None).values.tolist(), [(r.doc_id, r.piece, r.length) for r in pieces.collect()])
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 128 and (s.offset.to_numpy() == np.cumsum(s.length.to_numpy()) - s.length.to_numpy()).all()
    least = -(-int(got.length.sum()) // 128)
    assert got.sequence_id.nunique() <= least + max(1, round(len(got) / size)) + 1
    assert P.pack(P.tokenize_pieces(nothing, WORD), 128).count() == 0


def test_genetic_operators_keep_all_pieces():
    n = np.random.default_rng(0).integers(1, 60, 300)
    world = P.Island(n, 100, 1)
    a, b = world.best_fit([], list(range(300))), world.best_fit([], list(range(300)), 0.5)
    for child in (world.crossover(a, b), world.mutate(a), world.inject([tuple(p) for p in world.elites(b, 20)]), world.evolve([], 5, 4)):
        assert sorted(i for x in child for i in x) == list(range(300)) and max(map(world.fill, child)) <= 100
    assert len(world.evolve([], 5, 4)) <= len(a)


def triplets(n, seed, capacity=1000, step=50):
    """Lengths of which three always fill a bin; best-fit by length needs about a tenth more bins."""
    r, out = np.random.default_rng(seed), []
    while len(out) < 3 * n:
        a, b = int(r.integers(8, 10)) * step, int(r.integers(5, 8)) * step
        out += [a, b, capacity - a - b] if capacity - a - b >= 200 else []
    return r.permutation(out)


def test_crossover_and_migration_win_bins(monkeypatch):
    best_fit, alone, crossed, visited = 0, 0, 0, 0
    for seed in range(4):
        lengths, other = triplets(100, seed), P.Island(triplets(100, 100 + seed), 1000, 2)
        patterns = [tuple(p) for p in other.elites(other.evolve([], 40, 6), 64)]
        best_fit += len(P.Island(lengths, 1000, 1).best_fit([], list(range(300))))
        alone += len(P.Island(lengths, 1000, 1).evolve([], 2, 6))
        visited += len(P.Island(lengths, 1000, 1).evolve(patterns, 2, 6))
        with monkeypatch.context() as m:
            m.setattr(P.Island, "mutate", lambda self, bins: bins)
            only = P.Island(lengths, 1000, 1).evolve([], 40, 6)
        assert sorted(i for b in only for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 1000 for b in only)
        crossed += len(only)
    print("bins of 400 at best: best-fit", best_fit, "crossover alone", crossed, "two generations", alone, "with migrants", visited)
    assert 400 <= crossed <= best_fit - 8 and 400 <= visited < alone < best_fit


def test_islands_beat_best_fit(spark):
    """Three islands with migration, on lengths about a third of the capacity."""
    lengths = [int(n) for seed in range(3) for n in triplets(80, seed)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = P.pack(pieces, 1000, island_pieces=240).toPandas()
    assert len(got) == 720 and got.groupby("sequence_id")["length"].sum().max() <= 1000
    plain = len(P.Island(np.array(lengths), 1000, 0).best_fit([], list(range(720))))
    assert got["sequence_id"].nunique() <= plain - 6
