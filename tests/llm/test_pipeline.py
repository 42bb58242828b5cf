import os

import numpy as np
import pytest

import corpus_pipeline as C
from skyquilt.llm import quality
from skyquilt.llm.common import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, before = [], docs
    for name, stage in C.STAGES:
        after = materialize(stage(spark, before, SF), name)
        sizes.append(after.count())
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            before = after
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert docs.count() >= sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and C.ORACLE_SQL is None
    assert C.run(spark, SF).count() == sizes[-1]


def test_near_copies_go_at_five_words_and_80_percent(spark):
    """Texts of 100 words with one-word edits: two give 86 of 106 five-word shingles (but 89 of 105 of four words are below 85 %), three give 81 of 111."""
    words = [f"w{i}" for i in range(100)]
    edited = lambda tag, *at: " ".join(f"{tag}{i}" if i in at else w for i, w in enumerate(words))
    other = " ".join(f"other{i}" for i in range(100))
    rows = [(1, edited("a")), (2, edited("b", 30, 60)), (3, edited("c", 20, 50, 80)), (4, other), (None, edited("d", 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in C.one_of_each_group(spark, docs, SF).collect()) == ["1", "3", "4", "None"]


def test_stages_against_brute_force(spark):
    """Each stage on all that the one before kept, with nulls, empty and long texts, ties and repeated rows among the documents."""
    import test_decontamination
    import test_jaccard
    import test_lines_and_secrets

    table = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = table.select("doc_id", "text", "lang", "source", "n_chars")
    first = kinds.orderBy("doc_id").limit(3).collect()
    odd = [(None, None, "en", "s", 0), (None, first[0].text, "en", "s", 1), (9_000_001, "", "en", "s", 0), (9_000_002, first[1].text, "en", "s", 1), (9_000_002, first[1].text, "en", "s", 1), (9_000_003, " ".join(f"long{i}" for i in range(60_000)), "en", "s", 2), (9_000_004, "one two", None, None, None)]
    docs = kinds.union(spark.createDataFrame(odd, kinds.schema)).repartition(3)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)

    kept = materialize(C.keep_quality(spark, docs, SF), "quality")
    model = quality.fit(table.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    c = quality.Compressors(model)
    score = lambda t: 1 / (1 + np.exp(-np.clip(quality.design(np.array([c.features((t or "").encode())]))[0] @ np.array(model.weights) + model.shift, -30, 30)))
    assert rows(kept) == [r for r in rows(docs) if score(r[1]) >= C.THRESHOLD]

    cut = materialize(C.dedup_lines(spark, kept, SF), "lines")
    brute = test_lines_and_secrets.brute(rows(kept))
    assert rows(cut) == sorted(((d, t) for d, t, _, n, _ in brute if n == 0 or t.strip()), key=str)

    single = materialize(C.one_of_each_group(spark, cut, SF), "single")
    groups = test_jaccard.brute(rows(cut), C.SHINGLE, C.PERCENT)
    assert rows(single) == sorted((r for r, (d, _, g) in zip(rows(cut), groups, strict=True) if d is None or d == g), key=str)

    clean = materialize(C.decontaminated(spark, single, SF), "clean")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {str(k) for k in test_decontamination.contaminated([t for _, t in rows(single)], [t for _, t in items])}
    assert rows(clean) == [r for k, r in enumerate(rows(single)) if str(k) not in hit]

    packed = C.packed(spark, clean, SF).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096 and len(packed) >= clean.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_line_stage_keeps_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_lines", F.lit("own"))
    out = C.dedup_lines(spark, docs, SF)
    assert out.columns == docs.columns and out.where("n_lines <> 'own'").count() == 0
