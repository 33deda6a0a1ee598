"""Ledgers stored for reading: by blocks with an index of their text, and by slices of one order for pages.

A search for a part of a text can't be pushed to files, and a page of a sorted table needs the whole sort. Both are cheap if
the table is laid out for them once: a search reads the blocks whose rows hold all trigrams of what is searched, a page
reads the slices that its rows fall into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.operators.ledger import search

SHORT = 1_000_000  # blocks that are broadcast


def _texts() -> list[Column]:
    """What a search looks into, in lower case."""
    return [F.lower(F.coalesce("description", F.lit(""))), F.coalesce(F.date_format("date", "MM/dd/yyyy"), F.lit("")), F.lower(F.coalesce("file_name", F.lit("")))]


def _trigrams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def save_searchable(txns: DataFrame, path: str, blocks: int = 200) -> None:
    """txns(description, date, file_name, ...) in blocks of neighbouring descriptions, and the blocks of each trigram. A
    trigram has a row for each of its blocks at most, whatever the number of rows that hold it."""
    rows = txns.repartitionByRange(blocks, "description", "file_name", "date").withColumn("block", F.spark_partition_id())
    rows.write.partitionBy("block").parquet(f"{path}/rows")
    spark = txns.sparkSession
    stored_rows = spark.read.parquet(f"{path}/rows")
    texts = None
    for text in _texts():  # each different text of a block is cut once
        own = stored_rows.select("block", text.alias("text")).distinct()
        texts = own if texts is None else texts.unionByName(own)
    grams = texts.select("block", F.explode(F.array_distinct(_trigrams(F.col("text")))).alias("gram")).distinct()
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def searched(spark: SparkSession, path: str, text: str = "", side: str | None = None, source: str | None = None) -> DataFrame:
    """What ledger.search finds, from the blocks that may hold it. Texts of under three characters read all blocks."""
    rows = spark.read.parquet(f"{path}/rows")
    asked = text.lower()
    wanted = sorted({asked[k : k + 3] for k in range(len(asked) - 2)})
    if wanted:
        hits = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(*wanted)).groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("block")
        rows = rows.join(F.broadcast(hits) if hits.count() <= SHORT else hits.hint("merge"), "block", "left_semi")
    return search(rows, text, side, source).drop("block")


def save_pages(rows: DataFrame, path: str, order: list[Column], slices: int = 200) -> None:
    """rows in slices of an order, each slice sorted; and the number of rows of each slice."""
    cut = rows.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()).sortWithinPartitions("slice", *order)
    cut.write.partitionBy("slice").parquet(f"{path}/rows")
    rows.sparkSession.read.parquet(f"{path}/rows").groupBy("slice").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/slices")


def page(spark: SparkSession, path: str, order: list[Column], number: int = 0, size: int = 15) -> DataFrame:
    """One page: only slices that overlap it are read and sorted. The slices' sizes, a number each, come to the driver."""
    counts = sorted((r["slice"], r["n"]) for r in spark.read.parquet(f"{path}/slices").collect())
    first, at, mine, before = number * size, 0, [], 0
    for k, n in counts:
        if at + n <= first:
            before = at + n
        elif at < first + size:
            mine.append(F.col("slice") == k)
        at += n
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.filter(reduce(lambda a, b: a | b, mine) if mine else F.lit(False)).drop("slice")
    return rows.orderBy(*order).offset(first - before).limit(size)
