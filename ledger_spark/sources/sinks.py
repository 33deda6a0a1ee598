"""Where ledgers go: partitioned tables and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_rows(txns: DataFrame) -> DataFrame:
    """Date as MM/dd/yyyy, Description, Debit, Credit, Balance; zero and null amounts are empty."""
    money = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c).cast("string")), F.lit(""))
    return txns.select(F.coalesce(F.date_format("date", "MM/dd/yyyy"), F.lit("")).alias("Date"), F.coalesce("description", F.lit("")).alias("Description"), money("debit").alias("Debit"), money("credit").alias("Credit"), money("balance").alias("Balance"))


def export_csv(txns: DataFrame, folder: str) -> None:
    """CSV parts with a header; quotes and commas in descriptions are escaped."""
    export_rows(txns).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def save_ledger(txns: DataFrame, accounts: DataFrame, folder: str) -> None:
    """Transactions by user; only the partitions of users that occur are replaced. Rows are dealt by user and statement,
    so that a large user is written by several tasks."""
    keyed = txns.join(accounts.select("account_id", "user_id"), "account_id").repartition("user_id", "statement_id")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id").parquet(folder)


def replace_statements(known: DataFrame, arrived: DataFrame, folder: str) -> None:
    """Write known rows without the arrived statements, and the arrived ones, to a new folder."""
    from ledger_spark.operators.ledger import replaced

    replaced(known, arrived).write.mode("overwrite").parquet(folder)
