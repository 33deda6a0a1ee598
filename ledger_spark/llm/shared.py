"""Scratch tables in the shared folder, Arrow helpers and session settings used by every operator here."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of this application where none is set (tests on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and the sizes that
    Spark then sees are the files'. Nothing is kept on the executors' own disks."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/scratch/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches small enough for long texts; Python workers cut them again by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def parallelism(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def empty_for_null(text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def chunks(batch: pa.RecordBatch, text: str, limit: int = 1 << 19):
    """Slices of an Arrow batch that hold about `limit` bytes of text each (one longer text stands alone)."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield batch.slice(at, to - at), column.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a large_string array, end to end, and the n + 1 offsets of the texts in them."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]
