"""Document files as a table, and rows as text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.functions.text import extension, supported
from ledger_spark.sources.scratch import stored


def listed(files: DataFrame) -> DataFrame:
    """Files with their extension, whether it is supported, and the risk score that an unsupported one has."""
    path = F.col("path")
    return files.withColumn("extension", extension(path)).withColumn("supported", supported(path)).withColumn("risk_score", F.when(~F.col("supported"), 100).otherwise(0))


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of all files below a folder."""
    return listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))


UNPACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|z|passthrough|lzo|xz)$"  # what the reader of lines may unpack


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files whose lines come in order, one file after the other: with and without a last line end."""
    path, size, digest = None, 0, None

    def done() -> pa.RecordBatch:
        whole = digest.copy()
        whole.update(b"\n")
        return pa.RecordBatch.from_pydict({"path": [path], "size": pa.array([size], pa.int64()), "bare": [digest.hexdigest()], "ended": [whole.hexdigest()]})

    for batch in batches:
        for at, line in zip(batch.column("path").to_pylist(), batch.column("line")):
            if at != path:
                if path is not None:
                    yield done()
                path, size, digest = at, 0, hashlib.sha256()
            else:
                digest.update(b"\n")
                size += 1
            buffer = line.as_buffer()
            digest.update(buffer)
            size += len(buffer)
    if path is not None:
        yield done()


def fingerprinted(files: DataFrame) -> DataFrame:
    """files(path, length, ...) with file_hash, the SHA-256 of their bytes. No file is held in memory: a task reads it as
    lines, in order, and adds one after the other to its digest; a file without line ends is one line. What that reader
    would change (packed files, a byte order mark) is told by name or by size and read whole."""
    spark = files.sparkSession
    paths = [r["path"] for r in files.select("path").distinct().collect()]
    longest = files.agg(F.max("length")).first()[0]
    if not longest:
        return files.withColumn("file_hash", F.sha2(F.lit(b""), 256))
    own = spark.newSession()  # no file is split
    own.conf.set("spark.sql.files.maxPartitionBytes", str(longest + (4 << 20)))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    exact = lambda names: [re.sub(r"([{}\[\]*?\\])", r"\\\1", n) for n in names]  # noqa: E731  # names, not patterns of names
    lines = own.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(exact(paths)).filter(~F.col("_metadata.file_path").rlike(UNPACKED)).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    found = lines.mapInArrow(_digests, "path string, size long, bare string, ended string")
    at = F.regexp_replace("path", "^([a-z]+):/+", "$1:/")
    digests = found.select(at.alias("__at"), "size", "bare", "ended")
    known = spark.createDataFrame(digests.collect(), "__at string, size long, bare string, ended string")  # a row for each file of a batch
    each = stored(files.withColumn("__at", at).join(F.broadcast(known), "__at", "left").drop("__at"))
    hash_ = F.when(F.col("length") == 0, F.sha2(F.lit(b""), 256)).when(F.col("size") == F.col("length"), F.col("bare")).when(F.col("size") + 1 == F.col("length"), F.col("ended"))
    each = each.withColumn("file_hash", hash_).drop("size", "bare", "ended")
    odd = [r["path"] for r in each.filter("file_hash IS NULL").select("path").distinct().collect()]
    if odd:
        whole = stored(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(exact(odd)).select("path", F.sha2("content", 256).alias("whole")))
        each = each.join(F.broadcast(whole), "path", "left").withColumn("file_hash", F.coalesce("file_hash", "whole")).drop("whole")
    return each.select(*files.columns, "file_hash")


def preview(rows: DataFrame, first: int = 20) -> DataFrame:
    """doc_id, text: the first rows of each document, cells joined by " | "."""
    lines = F.sort_array(F.collect_list(F.struct("row_idx", F.array_join("cells", " | ", "").alias("line"))))
    return rows.filter(F.col("row_idx") < first).groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"))


def full_text(rows: DataFrame) -> DataFrame:
    """doc_id, text: all rows that aren't empty, cells joined by two blanks."""
    line = F.array_join(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), "  ")
    lines = F.sort_array(F.collect_list(F.struct("row_idx", line.alias("line"))))
    return rows.filter(line != "").groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"))
