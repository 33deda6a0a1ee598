"""Exact histogram of encoded lengths, with suffix sums that answer every context limit.

Each row of the result is a length that occurs. Between two of them the totals change linearly, so the rows answer any
limit L: documents longer than L, tokens kept when each document is cut at L, the share of documents that fit.

Null and empty texts have length 0. Repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, materialize, small_batches
from .tokens import encoder


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length, docs: partial counts of encoded lengths, one set per Arrow batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                size, n = np.unique(np.diff(encode(texts.to_pylist())[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["length", "docs"])

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "length long, docs long")


def token_histogram(docs: DataFrame, tokenizer: str, block: int = 1024) -> DataFrame:
    """length, docs, docs_ge, tokens_ge (documents of at least this length and their tokens), truncated_tokens (all
    tokens left when every document is cut at this length), total_docs, total_tokens, quantile (share of documents no
    longer than this). Suffix sums go by blocks of lengths and then inside blocks, so no task sees all lengths."""
    sizes = materialize(lengths(docs, tokenizer).groupBy("length").agg(F.sum("docs").alias("docs")))
    sizes = sizes.withColumn("block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("docs"))
    sums = sizes.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    down = Window.partitionBy("block").orderBy(F.desc("length"))
    ge = [(F.sum(c).over(down) + F.col(f"{c[0]}_after")).alias(f"{c}_ge") for c in ("docs", "tokens")]
    out = sizes.join(F.broadcast(sums), "block").select("length", "docs", *ge, "total_docs", "total_tokens")
    return out.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).withColumn("quantile", (F.col("total_docs") - F.col("docs_ge") + F.col("docs")) / F.col("total_docs"))
