"""Questions about the ledger: revenue, totals, flows, lists, search, pages, upserts and integrity.

Every function takes and returns DataFrames. Order comes from columns, never from the physical order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark import rules, schemas
from ledger_spark.operators.rule_sets import held, short
from ledger_spark.sources.scratch import stored


def _alternation(words: list[str], whole: bool) -> str:
    body = "|".join("\\Q" + w + "\\E" for w in words)
    return rf"\b(?:{body})\b" if whole else body


def revenue_status(description: Column, credit: Column, mode: str = "substring") -> Column:
    """unknown without a positive credit, deduction if the description holds a deduction word, else revenue.
    mode="word" only counts whole words."""
    pattern = _alternation([*rules.WIRE_DEDUCTIONS, *rules.DEDUCTIONS], mode == "word")
    held = F.coalesce(F.upper(description).rlike(pattern), F.lit(False))
    return F.when(credit.isNull() | (credit <= 0), "unknown").when(held, "deduction").otherwise("revenue")


def with_status(txns: DataFrame, mode: str = "substring") -> DataFrame:
    return txns.withColumn("status", revenue_status(F.col("description"), F.col("credit"), mode))


def matched_keyword(description: Column) -> Column:
    """The first deduction word that the description holds, in the lists' order."""
    words = F.array(*map(F.lit, [*rules.WIRE_DEDUCTIONS, *rules.DEDUCTIONS]))
    return F.get(F.filter(words, lambda w: F.contains(F.upper(description), w)), F.lit(0))


def money(value: Column) -> Column:
    return F.round(F.coalesce(value, F.lit(0)).cast("double"), 2)


def _revenue() -> Column:
    return F.sum(F.when(F.col("status") == "revenue", F.col("credit")))


def totals(txns: DataFrame, *keys: str) -> DataFrame:
    """Debits, revenue credits and net, over all or by keys."""
    each = with_status(txns).groupBy(*keys).agg(money(F.sum("debit")).alias("total_debits"), money(_revenue()).alias("total_credits"))
    return each.withColumn("net", F.round(F.col("total_credits") - F.col("total_debits"), 2))


def all_totals(txns: DataFrame, *keys: str) -> DataFrame:
    """Debits and all credits by keys."""
    return txns.groupBy(*keys).agg(money(F.sum("debit")).alias("total_debits"), money(F.sum("credit")).alias("total_credits"))


def adjusted_revenue(txns: DataFrame) -> DataFrame:
    """Raw credits, deductions and adjusted revenue for every account and month, every account, every month and in all."""
    each = with_status(txns).filter("status <> 'unknown'").withColumn("month", F.date_format("date", "yyyy-MM"))
    cube = each.cube("account_id", "month").agg(F.grouping_id().alias("level"), money(F.sum("credit")).alias("raw_credits"), money(F.sum(F.when(F.col("status") == "deduction", F.col("credit")))).alias("deductions"))
    return cube.withColumn("adjusted", F.round(F.col("raw_credits") - F.col("deductions"), 2))


def deductions_by_keyword(txns: DataFrame) -> DataFrame:
    each = with_status(txns).filter("status = 'deduction'").groupBy(matched_keyword(F.col("description")).alias("keyword"))
    return each.agg(F.count("*").alias("n"), money(F.sum("credit")).alias("credits"))


def with_family(txns: DataFrame, families: DataFrame) -> DataFrame:
    """txns with family: that of the first of families(ord, word, family) whose word the description of a positive credit
    holds, null if none does. Every different description is looked at once, and only for words that come near."""
    positive = F.col("credit") > 0
    texts = stored(txns.filter(positive & F.col("description").isNotNull()).select("description").distinct().select(F.col("description").alias("doc_id"), F.lower("description").alias("text")))
    words = families.select(F.lower("word").alias("needle"), "ord", "family")
    first = short(held(texts, words.select("needle")), words, "needle").groupBy(F.col("doc_id").alias("__text")).agg(F.min_by("family", "ord").alias("family"))
    return short(txns, stored(first), F.when(positive, F.col("description")) == F.col("__text"), "left").drop("__text")


def revenue_by_family(txns: DataFrame, families: DataFrame) -> DataFrame:
    """Raw credits, deductions and adjusted revenue per statement, per account, per month, per family ('revenue' for the
    rest), per account, month and family, and in all; level says which. Rows are expanded after they have been summed."""
    each = with_family(txns, families).filter("credit > 0").withColumn("month", F.date_format("date", "yyyy-MM"))
    keys = ["statement_id", "account_id", "month", "family"]
    base = each.groupBy(*keys).agg(F.sum("credit").alias("raw"), F.sum(F.when(F.col("family").isNotNull(), F.col("credit"))).alias("off")).na.fill("revenue", ["family"])
    s, a, m, f = (F.col(k) for k in keys)
    out = base.groupingSets([[s], [a], [m], [f], [a, m, f], []], s, a, m, f).agg(F.grouping_id().alias("level"), money(F.sum("raw")).alias("raw_credits"), money(F.sum("off")).alias("deductions"))
    return out.withColumn("adjusted", F.round(F.col("raw_credits") - F.col("deductions"), 2))


def statement_list(statements: DataFrame, txns: DataFrame) -> DataFrame:
    """Statements, newest first, with the number and sums of their transactions; statements without any show 0."""
    sums = txns.groupBy("statement_id").agg(F.count("*").alias("n_transactions"), F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    joined = statements.join(sums, "statement_id", "left")
    return joined.select("statement_id", "account_id", "user_id", "file_name", "uploaded_at", F.coalesce("n_transactions", F.lit(0)).alias("n_transactions"), money(F.col("d")).alias("total_debits"), money(F.col("c")).alias("total_credits")).orderBy(F.desc("uploaded_at"), "statement_id")


def nested(statements: DataFrame, txns: DataFrame) -> DataFrame:
    """Statements with their transactions as an array in order of date and place."""
    rows = F.array_sort(F.collect_list(F.struct("date", "txn_idx", "description", "debit", "credit", "balance")))
    each = txns.groupBy("statement_id").agg(rows.alias("transactions"))
    return statements.join(each, "statement_id", "left").withColumn("transactions", F.coalesce("transactions", F.array().cast(each.schema["transactions"].dataType)))


def scoped(rows: DataFrame, accounts: DataFrame, user_id: int) -> DataFrame:
    """Only rows whose account is the user's."""
    return rows.join(accounts.filter(F.col("user_id") == user_id).select("account_id"), "account_id", "left_semi")


def one_statement(statements: DataFrame, txns: DataFrame, accounts: DataFrame, user_id: int, statement_id: int) -> DataFrame:
    own = scoped(statements.filter(F.col("statement_id") == statement_id), accounts, user_id)
    return own.select("statement_id", "file_name").join(txns.filter(F.col("statement_id") == statement_id), "statement_id", "left")


def flattened(nested_: DataFrame) -> DataFrame:
    """Transactions of nested statements that have a positive side, with the file's name."""
    each = nested_.select("statement_id", "file_name", F.explode("transactions").alias("t")).select("statement_id", "file_name", "t.*")
    return each.filter((F.coalesce("debit", F.lit(0)) > 0) | (F.coalesce("credit", F.lit(0)) > 0))


def summary(txns: DataFrame, condition: Column | None = None) -> DataFrame:
    """Revenue credits, debits and net of rows that meet a condition; counts are over all rows."""
    ok = F.lit(True) if condition is None else condition
    revenue = F.sum(F.when(ok & (F.col("status") == "revenue"), F.col("credit")))
    out = with_status(txns).agg(money(revenue).alias("total_credits"), money(F.sum(F.when(ok, F.col("debit")))).alias("total_debits"), F.count("*").alias("n_transactions"), F.countDistinct("statement_id").alias("n_statements"))
    return out.withColumn("net", F.round(F.col("total_credits") - F.col("total_debits"), 2))


def monthly(txns: DataFrame, by: str = "month") -> DataFrame:
    """Inflow, outflow and net flow per calendar month, or per name of month over all years (by="month_name")."""
    key = F.date_format("date", "MMM" if by == "month_name" else "yyyy-MM")
    each = txns.groupBy(F.coalesce(key, F.lit("Unknown")).alias(by)).agg(money(F.sum("credit")).alias("inflow"), money(F.sum("debit")).alias("outflow"))
    return each.withColumn("net_flow", F.round(F.col("inflow") - F.col("outflow"), 2))


def recent(txns: DataFrame, n: int = 8) -> DataFrame:
    return txns.orderBy(F.desc("date"), F.desc("statement_id"), F.desc("txn_idx")).limit(n)


def search(txns: DataFrame, text: str = "", side: str | None = None, source: str | None = None) -> DataFrame:
    """Rows whose description, date or file name holds the text, on one side, from one file."""
    q = text.lower()
    ok = F.lit(True)
    if q:
        ok = F.lower(F.coalesce("description", F.lit(""))).contains(q) | F.coalesce(F.date_format("date", "MM/dd/yyyy"), F.lit("")).contains(q) | F.lower("file_name").contains(q)
    if side:
        ok &= F.coalesce(F.col(side) > 0, F.lit(False))
    if source:
        ok &= F.col("file_name") == source
    return txns.filter(ok)


def merged_accounts(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """Accounts by (user, number): arrived values win where they are given; missing numbers and banks get defaults."""
    number = F.coalesce("account_number", F.concat(F.lit("account-"), F.substring(F.lower(F.hex(F.col("user_id").cast("string"))), 1, 8)))
    new = arrived.withColumn("account_number", number).groupBy("user_id", "account_number").agg(F.max("bank_name").alias("new_bank"))
    both = known.withColumn("account_number", number).join(new, ["user_id", "account_number"], "full_outer")
    return both.select("user_id", "account_number", F.coalesce("new_bank", "bank_name", F.lit("Unknown Bank")).alias("bank_name"), F.col("account_id").isNull().alias("is_new"))


def latest_statements(statements: DataFrame) -> DataFrame:
    """Of statements of one account and file name, the last upload."""
    newest = Window.partitionBy("account_id", "file_name").orderBy(F.desc("uploaded_at"), F.desc("statement_id"))
    return statements.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def replaced(known: DataFrame, arrived: DataFrame, key: str = "statement_id") -> DataFrame:
    """Rows of arrived keys replace all known rows of these keys."""
    return known.join(arrived.select(key).distinct(), key, "left_anti").unionByName(arrived)


def deleted(users: DataFrame, accounts: DataFrame, statements: DataFrame, txns: DataFrame, gone: DataFrame, level: str) -> tuple[DataFrame, ...]:
    """What is left of all four tables when keys at a level (user_id, account_id or statement_id) go."""
    levels = ["user_id", "account_id", "statement_id"]
    out = []
    for depth, df in enumerate((users, accounts, statements, txns)):
        if depth == levels.index(level) or (depth > levels.index(level) and level in df.columns):
            df = df.join(gone, level, "left_anti")
        elif depth > levels.index(level):
            df = df.join(out[-1].select(levels[depth - 1]), levels[depth - 1], "left_semi")
        out.append(df)
    return tuple(out)


def violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def sources(txns: DataFrame) -> DataFrame:
    """File names in the order of their first rows."""
    return txns.groupBy("file_name").agg(F.min(F.struct("date", "statement_id", "txn_idx")).alias("first")).orderBy("first").select("file_name", F.col("first.date").alias("first_date"))


def active_document(statements: DataFrame, chosen: int | None = None) -> DataFrame:
    """The chosen statement, else the last uploaded."""
    if chosen is not None:
        return statements.filter(F.col("statement_id") == chosen).select("statement_id", "file_name")
    return statements.agg(F.max_by(F.struct("statement_id", "file_name"), F.struct("uploaded_at", "statement_id")).alias("s")).select("s.*")


def page(txns: DataFrame, by: str = "date", descending: bool = True, number: int = 0, size: int = 15) -> DataFrame:
    key = F.desc(by) if descending else F.asc(by)
    return txns.orderBy(key, "statement_id", "txn_idx").offset(number * size).limit(size)


def with_total_row(txns: DataFrame) -> DataFrame:
    """Sums per statement and one row over all, whose statement_id is null."""
    each = with_status(txns).rollup("statement_id").agg(F.grouping("statement_id").cast("int").alias("is_total"), money(F.sum("debit")).alias("total_debits"), money(_revenue()).alias("total_credits"))
    return each


def first_rows(txns: DataFrame, n: int = 20) -> DataFrame:
    """The first n rows of every statement; Spark keeps only these before the shuffle."""
    place = Window.partitionBy("statement_id").orderBy("txn_idx")
    return txns.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)


def resolved(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """uploads(name, pos) with the document that they mean: same name, else same name in any case, else same place."""
    tiers = [
        uploads.join(documents, uploads["name"] == documents["file_name"]).withColumn("tier", F.lit(1)),
        uploads.join(documents, F.lower(uploads["name"]) == F.lower(documents["file_name"])).withColumn("tier", F.lit(2)),
        uploads.join(documents, uploads["pos"] == documents["doc_pos"]).withColumn("tier", F.lit(3)),
    ]
    found = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("name", "pos").agg(F.min(F.struct("tier", "doc_pos", "file_name")).alias("m"))
    return uploads.join(found, ["name", "pos"], "left").select("name", "pos", "m.tier", "m.file_name")


def packed_metadata(statements: DataFrame) -> DataFrame:
    """raw_data: the statement's metadata as JSON."""
    fields = F.struct(F.col("bank_name").alias("bankName"), F.col("account_number").alias("accountNumber"), F.col("current_balance").cast("double").alias("currentBalance"))
    return statements.withColumn("raw_data", F.to_json(fields))


def unpacked_metadata(statements: DataFrame, accounts: DataFrame) -> DataFrame:
    """Metadata from raw_data, each field from the account where the JSON has none."""
    own = accounts.select("account_id", F.col("bank_name").alias("_bank"), F.col("account_number").alias("_number"))
    each = statements.withColumn("m", F.from_json("raw_data", schemas.RAW_DATA)).drop("bank_name", "account_number").join(own, "account_id", "left")
    return each.select("statement_id", F.coalesce("m.bankName", "_bank").alias("bank_name"), F.coalesce("m.accountNumber", "_number").alias("account_number"), F.col("m.currentBalance").alias("current_balance"))
