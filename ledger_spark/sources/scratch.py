"""Tables written once to the cluster's shared folder, in place of caches that are lost with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a folder of this application where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root and app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{(root or _OWN[app]).rstrip('/')}/ledger/{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df, written (in folders by these columns) and read back: lineage ends there."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
