"""A table that is rewritten partition by partition while others read it.

Rows lie below data/part=<write>_<user>. A manifest per write, itself a small table, names the part of each user. A version
is a marker file that holds the name of its write; it is made under another name and renamed, which fails if another
writer has made that version. Readers take the last marker and join its manifest with the data on `part`, so that Spark
prunes all other folders before it reads: they see the old or the new state, never a mixture. An upsert rewrites the parts
of users that it touches; the others keep theirs. Only markers pass through the driver.

A small user's part is written by one task, a large one's by several. user_id must be given; rows without one are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.sources.scratch import stored

SHORT = 500_000  # users of a manifest that are broadcast


class Conflict(Exception):
    """Another writer made this version first."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm, jvm.Path(path), jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The last version; 0 before the first."""
    _, at, fs = _hadoop(spark, f"{path}/markers")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def _write_of(spark: SparkSession, path: str, number: int) -> str:
    _, at, fs = _hadoop(spark, f"{path}/markers/{number:012d}")
    stream = fs.open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, write: str) -> None:
    from py4j.protocol import Py4JJavaError

    jvm, new, fs = _hadoop(spark, f"{path}/markers/{write}")
    stream = fs.create(new, True)
    stream.writeUTF(write)
    stream.close()
    try:
        options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, jvm.Path(f"{path}/markers/{number:012d}"), options)
    except Py4JJavaError as error:
        fs.delete(new, False)
        if "FileAlreadyExists" in str(error.java_exception):
            raise Conflict(f"version {number} of {path}") from error
        raise


def _rows(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The rows of a manifest's parts. The filter on `live` holds for every row; it tells Spark that the manifest picks
    parts, and so to prune folders by it."""
    parts = manifest.filter("live = 1").select("part")
    data = spark.read.parquet(f"{path}/data")
    return data.join(F.broadcast(parts) if parts.count() <= SHORT else parts.hint("merge"), "part", "left_semi").drop("part")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version, the last one by default; None before the first."""
    number = version(spark, path) if number is None else number
    return _rows(spark, path, spark.read.parquet(f"{path}/manifest/{_write_of(spark, path, number)}")) if number else None


def upsert(arrived: DataFrame, path: str, key: str = "statement_id", gone: DataFrame | None = None) -> int:
    """Arrived rows (user_id, key, ...) replace all rows of their user's keys; gone(user_id, key) are keys that go without
    new rows. Returns the new version. A writer that is overtaken raises Conflict and has changed nothing."""
    spark = arrived.sparkSession
    arrived = stored(arrived)
    ids = arrived.select("user_id", key)
    ids = stored((ids if gone is None else ids.unionByName(gone.select("user_id", key))).distinct())
    if ids.filter("user_id IS NULL").limit(1).count():
        raise ValueError("rows without user_id")
    users = stored(ids.select("user_id").distinct())
    touched = F.broadcast(users) if users.count() <= SHORT else users.hint("merge")
    before, write, rows, last = version(spark, path), "w" + uuid.uuid4().hex, arrived, None
    if before:
        last = spark.read.parquet(f"{path}/manifest/{_write_of(spark, path, before)}")
        own = _rows(spark, path, last.join(touched, "user_id", "left_semi"))
        rows = own.join(ids.hint("merge"), ["user_id", key], "left_anti").select(*arrived.columns).unionByName(arrived)
    rows = stored(rows.withColumn("part", F.concat_ws("_", F.lit(write), F.col("user_id").cast("string"))))
    rows.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(f"{path}/data")
    manifest = rows.select("user_id", "part", F.lit(1).alias("live")).distinct()
    if last is not None:
        manifest = last.join(touched, "user_id", "left_anti").select(*manifest.columns).unionByName(manifest)
    manifest.write.parquet(f"{path}/manifest/{write}")
    _commit(spark, path, before + 1, write)
    return before + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the last versions and the parts that none of these names; returns how many parts went. Parts of a
    write that isn't committed yet go too: run it while nobody writes."""
    jvm, root, fs = _hadoop(spark, f"{path}/data")
    last = version(spark, path)
    if not last:
        return 0
    numbers = range(max(1, last - keep + 1), last + 1)
    writes = [_write_of(spark, path, k) for k in numbers]
    named = spark.read.parquet(*(f"{path}/manifest/{w}" for w in writes)).select("part").distinct()
    there = spark.createDataFrame([(s.getPath().getName()[5:],) for s in fs.listStatus(root) if s.getPath().getName().startswith("part=")], "part string")
    gone = [r["part"] for r in there.join(named.hint("merge"), "part", "left_anti").toLocalIterator()]
    for part in gone:
        fs.delete(jvm.Path(f"{path}/data/part={part}"), True)
    for k in range(1, last + 1):
        if k not in numbers:
            fs.delete(jvm.Path(f"{path}/markers/{k:012d}"), False)
    for s in fs.listStatus(jvm.Path(f"{path}/manifest")):
        if s.getPath().getName() not in writes:
            fs.delete(s.getPath(), True)
    return len(gone)
