"""Corpus pipeline: documents pass a quality classifier, line dedup, near-duplicate removal and benchmark decontamination, and are packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of docs. Documents are told apart by doc_id: rows without one are never dropped
as copies, and rows that repeat one doc_id and text are one document, so they stay or go together.
Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm import decontaminate, jaccard_join, line_chunks, packing, quality
from skyquilt.llm.common import materialize, read_table
from skyquilt.llm.queries import tokenizer

THRESHOLD = 0.3
#: Near copies share 80 % of their five-word shingles; op6_jaccard_join has limits of its own.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    labelled = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    score = quality.score_udf(spark, quality.fit(labelled, read_table(spark, sf_dir, "labels")))
    return docs.where(score(F.coalesce("text", F.lit(""))) >= THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines; documents that had words and lose all of their text go. ``n_chars`` follows the text."""
    cut = line_chunks.remove_repeated_chunks(docs.withColumnsRenamed({c: f"own_{c}" for c in line_chunks.ADDED if c in docs.columns}))
    left = cut.where((F.col("n_removed_chunks") == 0) | F.col("text").rlike(r"\S")).drop(*line_chunks.ADDED)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return left.withColumnsRenamed({f"own_{c}": c for c in line_chunks.ADDED}).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies."""
    groups = jaccard_join.near_duplicates(docs, SHINGLE, PERCENT)
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of ten benchmark words occurs."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4,096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 1)


STAGES = [("quality", keep_quality), ("line_dedup", dedup_lines), ("near_duplicates", one_of_each_group), ("decontamination", decontaminated), ("packing", packed)]

#: Compressed sizes, the components and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
