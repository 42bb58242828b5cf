"""Growing label folders as a stream: new labels are parsed once, repeated ids update their sun angles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyquilt.sources import labels

FILES = "path string, modificationTime timestamp, length long, content binary"


def label_stream(spark: SparkSession, root: str, per_trigger: int = 10_000) -> DataFrame:
    """Products of labels as they arrive under root; browse and grid labels are passed over by name."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", str(per_trigger)).load(root)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rows = files.where(~(name.contains("_brw") | name.contains("_grd"))).select("path", F.decode("content", "UTF-8").alias("xml"), F.col("modificationTime").alias("seen"))
    return labels.parse(rows, keep=("seen",))


def hourly_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Products for each instrument and hour of arrival; rows later than ``late`` are left out."""
    return stream.withWatermark("seen", late).groupBy(F.window("seen", "1 hour"), "instrument").agg(F.count("*").alias("n"))


def write_products(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
