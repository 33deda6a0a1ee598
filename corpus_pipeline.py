"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the attention classifier scores below 0.7 go.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: of documents linked by shingles of five words at a similarity of 0.8 the smallest doc_id stays.
4. decontamination: documents that hold benchmark windows in a twentieth of their words go.
5. packing: the rest, as pieces of at most 2048 tokens with their places in sequences.

Every stage reads whole texts of all rows that the stage before kept. Ids of rows that go are a small table: it is
broadcast if a count shows that it is short, and joined by sort-merge otherwise. doc_id may be null or repeat: stages 3
and 4 judge and drop single rows, by a row number stored before them. Null comes before any other doc_id; of rows with
one doc_id the smallest hash of the text comes first. Rows that repeat doc_id and text (null counts
as empty) are one row after stage 2. Columns beyond doc_id and text pass through stages 1 to 4 unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.llm import decontam, exact, jaccard, packing, quality
from ledger_spark.llm.queries import tokenizer_path
from ledger_spark.llm.shared import materialize, read, small_batches

ORACLE_SQL = None
SHORT = 500_000  # rows of two columns that may be broadcast


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """docs whose keys (null being a value) are none of gone's rows."""
    gone = materialize(gone.toDF(*(f"__gone_{k}" for k in range(len(keys)))))
    same = F.lit(True)
    for k, key in enumerate(keys):
        same &= key.eqNullSafe(F.col(f"__gone_{k}"))
    return docs.join(F.broadcast(gone) if gone.count() <= SHORT else gone.hint("merge"), same, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    score = quality.scorer(spark, quality.train(docs, read(spark, sf_dir, "labels")))
    return docs.filter(score("text") >= 0.7)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = materialize(exact.exact_dedup(docs)).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    rows = materialize(rows)
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    if rows.filter("kept AND n > 1").limit(1).count():
        docs = docs.withColumn("__sha", sha).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
    return without(docs, [F.col("doc_id"), sha], rows.filter("NOT kept").select("doc_id", "text_sha256"))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs, stored with a number for each row in __row; and doc_id, now that number, with the text."""
    docs = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    return docs, docs.select(F.col("__row").alias("doc_id"), "text")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, rows = numbered(docs)
    found = materialize(jaccard.jaccard_components(rows, width=5, percent=80).select(F.col("doc_id").alias("__row"), "component_id"))
    many = found.filter(F.col("__row") != F.col("component_id")).select("component_id").distinct()
    linked = found.join(many.hint("merge"), "component_id", "left_semi")
    place = F.struct(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("__row"))
    placed = materialize(linked.join(docs.select("__row", place.alias("place")).hint("merge"), "__row"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = placed.join(first.hint("merge"), "component_id").filter(F.col("place") != F.col("first"))
    return without(docs, [F.col("__row")], gone.select("__row")).drop("__row")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, rows = numbered(docs)
    found = decontam.contamination(rows, read(spark, sf_dir, "benchmark"))
    return without(docs, [F.col("__row")], found.filter("contaminated").select("doc_id")).drop("__row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_one_of_near),
    ("decontamination", keep_uncontaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
