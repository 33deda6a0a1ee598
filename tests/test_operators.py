"""Golden cases, edges and round trips that the tables don't hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledger_spark import rules
from ledger_spark.functions import cells, text
from ledger_spark.operators import dedupe, extract, layout, ledger, quality, rule_sets, structure
from ledger_spark.sources import sinks
from ledger_spark.streaming import watch


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v")).alias("x")).first()["x"]


AMOUNTS = [
    ("($1,234.56)", -1234.56), ("123.45-", -123.45), ("1.234,56", 1234.56), ("XXXX1234", None), ("1234567890123", None), ("7.37-", -7.37), ("($234.18)", -234.18), ("*1234.56", 1234.56), ("#1234.56", 1234.56),
    ("1234.56 Cr", 1234.56), ("-$700.00", -700.0), ("₹1,234.56", 1234.56), ("", None), (None, None), ("abc", None), ("1O.5O", 10.5), ("1O0.50", 100.5), ("01/02", None), ("(", None), ("1.2.3", None),
]


@pytest.mark.parametrize("raw,want", AMOUNTS)
def test_amount(spark, raw, want):
    assert one(spark, raw, cells.amount) == want


DATES = [
    ("O1/O2/2O26", "2026-01-02"), ("2003-10-08", "2003-10-08"), ("24-04-2023", "2023-04-24"), ("15-Jan-24", "2024-01-15"), ("Jul 01, 2025", "2025-07-01"), ("01.01.2024", "2024-01-01"), ("04/01/2025", "2025-04-01"),
    ("Jul 01", "2024-07-01"), ("10/02", "2024-10-02"), ("02/30/2024", None), ("13/13/2024", None), ("", None), (None, None), ("Foo 01", None), ("10.25", "2024-10-25"), ("1/1/69", "2069-01-01"), ("1/1/70", "1970-01-01"),
]


@pytest.mark.parametrize("raw,want", DATES)
def test_date(spark, raw, want):
    assert one(spark, raw, lambda v: cells.date(v, F.lit(2024))) == (datetime.date.fromisoformat(want) if want else None)


def test_strict_dates_are_no_decimals(spark):
    assert one(spark, "10.25", lambda v: cells.date(v, F.lit(2024), strict=True)) is None


def test_clean_cell(spark):
    assert one(spark, "TTTToooottttaaaallll", text.clean_cell) == "Total"
    assert one(spark, "$$$$99990000", text.clean_cell) == "$99990000"


def test_masked_accounts_are_equal(spark):
    assert one(spark, "****1234", text.normalized_account) == one(spark, "XXXX1234", text.normalized_account) == "XXXX1234"


def test_adjusted_revenue(spark):
    txns = spark.createDataFrame([("CUSTOMER PAYMENT", 5000), ("LOC ADVANCE", 2000), ("TRANSFER", 1500), ("INTEREST", 100)], "description string, c int").withColumn("credit", F.col("c").cast("decimal(14,2)"))
    out = ledger.with_status(txns).groupBy("status").agg(F.sum("c").alias("c")).collect()
    assert {r["status"]: r["c"] for r in out} == {"revenue": 5000, "deduction": 3600}
    words = spark.createDataFrame([("WIRE FROM CUSTOMER ABC CORP",), ("WIRE FROM NEXTGEAR CAPITAL",), ("RETAIL",)], "description string").withColumn("credit", F.lit(1))
    assert [r["status"] for r in ledger.with_status(words).collect()] == ["revenue", "deduction", "deduction"]
    assert [r["status"] for r in ledger.with_status(words, "word").collect()] == ["revenue", "deduction", "revenue"]


def rows_of(spark, *lists):
    return spark.createDataFrame([(1, k, list(c)) for k, c in enumerate(lists)], "doc_id long, row_idx int, cells array<string>")


def test_header_and_roles(spark):
    rows = rows_of(spark, ["Date", "Description", "Debit", "Credit"], ["04/01/2025", "Amazon", "123.45", ""], ["04/02/2025", "Salary", "", "5000.00"])
    found = structure.layouts(rows).first()
    assert found["header_idx"] == 0 and found["roles"] == {"date": 0, "description": 1, "debit": 2, "credit": 3}
    out = extract.standard(extract.prepare(rows, 2025)).orderBy("row_idx").collect()
    assert [(str(r["date"]), r["description"], r["debit"], r["credit"]) for r in out] == [("2025-04-01", "Amazon", 123.45, None), ("2025-04-02", "Salary", None, 5000.0)]


def test_typed_line(spark):
    line = "Jan 31, 2026 Debit Card ARCO #42551 AMPM -$40.35 $95,744.25 Transaction ID: 586-1"
    rows = rows_of(spark, ["Date", "Type", "Description", "Amount"], [line], ["04/01", "Direct Deposit", "Payroll", "+2,500.00 $106,486.15"])
    out = extract.typed_signed(extract.prepare(rows, 2026)).orderBy("row_idx").collect()
    assert (str(out[0]["date"]), out[0]["debit"], out[0]["balance"]) == ("2026-01-31", 40.35, 95744.25)
    assert (out[1]["credit"], out[1]["balance"]) == (2500.0, 106486.15)


def test_negative_first_of_two_numbers_is_a_debit(spark):
    rows = rows_of(spark, ["x"], ["01/02/2024", "Something", "-5.00", "10.00"]).withColumn("header_idx", F.lit(0))
    prepared = extract.prepare(rows.drop("header_idx"), 2024).withColumn("header_idx", F.lit(0))
    assert extract.line_heuristic(prepared).first()["debit"] == 5.0


def test_undated_row_joins_the_last_transaction_that_was_read(spark):
    rows = rows_of(spark, ["Date", "Description", "Amount", "Balance"], ["01/02/2024", "A", "5.00", "10.00"], ["01/03/2024", "no amount", "", ""], ["", "tail"])
    out = extract.signed_amount(extract.prepare(rows, 2024)).collect()
    assert [r["description"] for r in out] == ["A tail"]


def test_empty_and_null_rows(spark):
    empty = rows_of(spark, ["x"]).limit(0)
    prepared = extract.prepare(empty, 2024)
    for parser in (extract.standard, extract.signed_amount, extract.multicolumn, extract.repeated_blocks, extract.sectioned, extract.additions_subtractions, extract.typed_signed, extract.fragmented, extract.line_heuristic, extract.check_details):
        assert parser(prepared).count() == 0
    holes = spark.createDataFrame([(1, 0, None), (1, 1, []), (1, 2, [None, None]), (2, 0, ["Date", None, "Amount"]), (2, 1, ["01/02/2024", None, "5.00"])], "doc_id long, row_idx int, cells array<string>")
    prepared = extract.prepare(holes.withColumn("cells", F.coalesce("cells", F.array().cast("array<string>"))), 2024)
    assert extract.signed_amount(prepared).count() == 1


def test_duplicates_stay_in_their_scope(spark):
    history = spark.createDataFrame([(1, "f", "c", "first.pdf", 1), (1, "f", "c", "second.pdf", 2)], "user_id int, file_hash string, content_hash string, file_name string, uploaded_at int")
    arrived = spark.createDataFrame([(1, 10, "f", "z"), (1, 11, "y", "c"), (1, 12, "y", "z"), (2, 13, "f", "c")], "user_id int, statement_id int, file_hash string, content_hash string")
    out = {r["statement_id"]: (r["duplicate_type"], r["original_name"]) for r in dedupe.duplicates(arrived, history).collect()}
    assert out == {10: ("exact_file", "first.pdf"), 11: ("exact_content", "first.pdf"), 12: (None, None), 13: (None, None)}


def test_statements_without_rows_are_alike(spark):
    txns = spark.createDataFrame([], "statement_id long, txn_idx int, date date, description string, debit decimal(14,2), credit decimal(14,2)")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert dedupe.transaction_similarity(pairs, txns).first()["similarity"] == 1.0


def test_risk(spark):
    signals = spark.createDataFrame([(1, 3, True, "made with Figma", "draft", 2, 2, 1), (2, None, None, None, None, None, None, None)], "doc_id long, eof_markers int, encrypted boolean, meta_text string, text_sample string, overlay_pages int, fragmented_font_pages int, annotations int")
    out = {r["doc_id"]: r for r in quality.alteration_risk(signals).collect()}
    assert out[1]["risk_score"] == 100 and out[1]["rejected"] and len(out[1]["reasons"]) == 7 and out[2]["risk_score"] == 0


def test_ocr_groups_follow_their_first_line(spark):
    lines = [(1, 1, k, f"t{k}", 0.0, float(y), 10.0) for k, y in enumerate((0, 6, 12, 18))]
    df = spark.createDataFrame(lines, "doc_id long, page_no int, line_idx int, text string, x double, y double, h double")
    assert [r["grp"] for r in layout.grouped_lines(df).orderBy("line_idx").collect()] == [0, 0, 1, 1]


def test_csv_round_trip(spark, tmp_path):
    txns = spark.createDataFrame([(datetime.date(2024, 1, 2), 'say "hi", twice', 5, None, 0)], "date date, description string, d int, c int, b int").selectExpr("date", "description", "CAST(d AS DECIMAL(14,2)) debit", "CAST(c AS DECIMAL(14,2)) credit", "CAST(b AS DECIMAL(14,2)) balance")
    sinks.export_csv(txns, str(tmp_path / "out"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert row["Date"] == "01/02/2024" and row["Description"] == 'say "hi", twice' and row["Credit"] in (None, "") and row["Balance"] in (None, "")


def test_rules_in_blocks_find_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "north bank of south"), (2, "SOUTH bank"), (3, ""), (4, None)], "doc_id long, text string")
    banks = spark.createDataFrame([("North", "north", 1), ("South", "south", 0), ("None", "xyz", 2)], "name string, pattern string, ord int")
    want = {(1, "South"), (2, "South")}
    for most in (200_000, 1):
        monkeypatch.setattr(rule_sets, "MOST", most)
        assert {tuple(r) for r in quality.bank_name(texts, banks).collect()} == want
    assert quality.bank_name(texts, banks.limit(0)).count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"one")
    (folder / "b.pdf").write_bytes(b"one")
    (folder / "c.txt").write_bytes(b"two")
    run = lambda: watch.ingest(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    run()
    assert [r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "table")).collect()] == ["a.pdf"]
    (folder / "d.png").write_bytes(b"three")
    (folder / "e.png").write_bytes(b"one")
    run()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == ["a.pdf", "d.png"]


def test_roles_are_free_of_names():
    assert len(rules.DEDUCTIONS) + len(rules.WIRE_DEDUCTIONS) == 139


def test_candidate_pairs_miss_no_similar_pair(spark):
    from ledger_spark.operators import dedupe

    rows = lambda s, n, date, word: [(s, k, date, f"{word} shop {k}", k * 1.0, None) for k in range(n)]
    txns = rows(1, 5, None, "a") + rows(2, 5, None, "a") + rows(3, 3, None, "a") + rows(4, 5, "2024-01-01", "a") + rows(5, 5, "2024-01-01", "a") + rows(8, 5, None, "a")
    txns = spark.createDataFrame(txns, "statement_id long, txn_idx int, date string, description string, debit double, credit double")
    statements = spark.createDataFrame([(1, s) for s in range(1, 8)] + [(2, 8), (2, 9)], "user_id long, statement_id long")
    got = {tuple(r) for r in dedupe.candidate_pairs(statements, statements, txns).collect()}
    pairs = statements.selectExpr("user_id", "statement_id AS a").join(statements.selectExpr("user_id", "statement_id AS b"), "user_id").filter("a <> b").select("a", "b")
    similar = {(r["a"], r["b"]) for r in dedupe.transaction_similarity(pairs, txns).collect() if r["similarity"] > 0}
    assert similar == {(1, 2), (2, 1), (4, 5), (5, 4), (6, 7), (7, 6)} and got == similar


def test_near_pairs_miss_no_near_pair(spark):
    import random

    from ledger_spark.operators import dedupe

    rng = random.Random(5)
    base = [(None if k % 5 == 0 else f"2024-01-{k % 9 + 1:02d}", f"shop {k % 4} street {k}" if k % 6 else None, k * 1.0, None if k % 2 else 0.01 * k) for k in range(20)]
    txns = []
    for s in range(40):
        rows = [r for r in base if rng.random() > (0.02, 0.1, 0.6)[s % 3]]
        txns += [(s, k, *r[:2], r[2] + rng.choice((0, 0, 0.01, -0.01)), r[3]) for k, r in enumerate(rows)]
    txns = spark.createDataFrame(txns, "statement_id long, txn_idx int, date string, description string, debit double, credit double")
    statements = spark.createDataFrame([(s % 2, s) for s in range(44)], "user_id long, statement_id long")
    pairs = statements.selectExpr("user_id", "statement_id AS a").join(statements.selectExpr("user_id", "statement_id AS b"), "user_id").filter("a <> b").select("a", "b")
    every = {(r["a"], r["b"]): r["similarity"] for r in dedupe.transaction_similarity(pairs, txns).collect()}
    for least in (0.5, 0.9):
        got = {tuple(r) for r in dedupe.near_pairs(statements, statements, txns, least).collect()}
        want = {pair for pair, similarity in every.items() if similarity >= least}
        assert want and want <= got <= set(every)
