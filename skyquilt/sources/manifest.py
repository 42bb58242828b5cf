"""Nested JSON documents in and out: pair manifests, rankings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def manifest(products: DataFrame, pairs: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: version, counts, products by id, pairs, skipped files. Products in a pair are marked eligible.

    A manifest is one document, so its size is that of one driver's answer; use the tables for more.
    """
    used = pairs.select(F.explode(F.array("a_id", "b_id")).alias("product_id")).distinct().withColumn("pairing_eligible", F.lit(True))
    marked = products.join(used, "product_id", "left").withColumn("pairing_eligible", F.coalesce("pairing_eligible", F.lit(False)))
    body = marked.agg(F.map_from_entries(F.collect_list(F.struct("product_id", F.struct(*[c for c in marked.columns if c != "product_id"])))).alias("products"), F.count("*").alias("n_products"))
    listed = pairs.agg(F.array_sort(F.collect_list(F.struct(*pairs.columns))).alias("pairs"), F.count("*").alias("n_pairs"))
    left = skipped.agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias("skipped"))
    return body.crossJoin(listed).crossJoin(left).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct("n_products", "n_pairs").alias("counts"), "products", "pairs", "skipped")  # one row each


def write_document(df: DataFrame, path: str) -> None:
    """A one-row document as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def pair_at(document: DataFrame, index: int = 0) -> DataFrame:
    return document.select(F.get("pairs", F.lit(index)).alias("p")).select("p.*")


def ranking_document(top: DataFrame, filters: dict[str, float], counters: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: filters, counters, ranked candidates, and notes by pair."""
    shown = top.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in top.columns if c != "rank"]))).alias("candidates"))
    said = notes.agg(F.map_from_entries(F.collect_list(F.struct("pair_id", "note"))).alias("diagnostics"))
    limits = F.create_map(*[F.lit(x) for kv in filters.items() for x in kv])
    return counters.select(F.struct("*").alias("counts")).crossJoin(shown).crossJoin(said).select(F.lit(SCHEMA_VERSION).alias("schema_version"), limits.alias("filters"), "counts", "candidates", "diagnostics")  # one row each


def corners_text(xml: Column, tag: str) -> Column:
    """Texts of a tag's occurrences in any namespace, by pattern."""
    return F.regexp_extract_all(xml, F.lit(rf"<(?:\w+:)?{tag}[^>]*>\s*([^<]*?)\s*</"), F.lit(1))


def report(scores: DataFrame) -> Column:
    """A line for each score row."""
    return F.format_string("%-12s n=%d correct=%d (%.1f%%) median=%.1f p90=%.1f", *[F.col(c) for c in scores.columns[:1]], "n", "n_correct", "pct_correct", "median_error", "p90_error")
