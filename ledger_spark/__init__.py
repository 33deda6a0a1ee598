"""Statement-ledger analytics as Spark DataFrame operators."""
