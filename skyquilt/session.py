"""Session defaults shared by tests, bench and applications."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """Build or reuse a session; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName("skyquilt")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df as files in ``spark.checkpoint.dir``, without its plan; in local mode a temporary folder does where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "skyquilt"))
    return df.checkpoint()
