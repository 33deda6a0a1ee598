"""Many rules against texts, layouts for reading, constraints, families, coverage, classes of equal statements."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledger_spark import rules
from ledger_spark.functions import cells
from ledger_spark.operators import dedupe, ledger, quality, rule_sets, structure
from ledger_spark.sources import history, layouts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [200_000, 1])
def test_held_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(rule_sets, "MOST", most)
    rng = random.Random(4)
    words = ["bank", "of", "a", "north", "first", "ünion", "x.y", "b&c", "\n", "  ", "ba"]
    texts = [(k, "".join(rng.choice(words) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(12)))) for k in range(60)] + [(100, None), (101, "")]
    needles = ["bank", "of", "", "a", "north bank", "x.y", "ünion", "zzz", "bank", "ba\nb", None]
    patterns = [r"\bnorth\s+bank\b", r"bank", r"x.y", r"(?i)FIRST", r"first|north", r"a\s*b", r"\bof\b", r"^$", r"b&c", r"[xy]\.", r"\bbank\b\s*of"]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for some, regex in ((needles, False), (patterns, True)):
        got = rule_sets.held(frame, spark.createDataFrame([(n,) for n in some], "needle string"), regex)
        want = {(d, n) for d, t in texts if t is not None for n in some if n is not None and (re.search(n, t) if regex else n in t)}
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_many_rules_cost_little(spark):
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("statement of bank number "), F.col("id").cast("string"), F.lit(" in the city "), F.repeat(F.lit("row of text "), 200)).alias("text"))

    def took(n):
        banks = spark.range(n).select(F.concat(F.lit(r"\bbank\s+number\s+"), F.col("id").cast("string"), F.lit(r"\b")).alias("pattern"), F.concat(F.lit("Bank "), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("ord"))
        began = time.time()
        out = quality.bank_name(texts, banks).collect()
        assert len(out) == min(n, 400) and all(r["bank_name"] == f"Bank {r['doc_id']}" for r in out)
        return time.time() - began

    took(50)
    few, many = min(took(50) for _ in range(2)), min(took(10_000) for _ in range(2))
    assert many < 2 * few + 2, (few, many)


def test_templates_without_hits_and_names(spark):
    rows = spark.createDataFrame([(1, 0, ["First Example Bank", "Amount"]), (2, 0, ["nothing"]), (3, 0, ["amount"])], "doc_id long, row_idx int, cells array<string>")
    names = spark.createDataFrame([(1, "a.pdf"), (2, "BLOCKS.pdf"), (3, None)], "doc_id long, file_name string")
    out = {r["doc_id"]: (r["template_id"], r["score"], r["bank_evidence"]) for r in structure.select_template(rows, names, rules.templates(spark)).collect()}
    assert out == {1: ("example_signed", 5, True), 2: ("example_blocks", 6, False)}
    assert "NestedLoop" not in plan_of(structure.select_template(rows, names, rules.templates(spark)))


def test_search_reads_blocks(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("statement_id"), F.concat(F.lit("kind "), (F.col("id") % 40).cast("string"), F.lit(" Shop")).alias("description"), F.expr("DATE'2024-01-01' + CAST(id % 300 AS INT)").alias("date"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit(".pdf")).alias("file_name"), F.lit(1.0).alias("credit"), F.lit(None).cast("double").alias("debit"))
    path = f"file://{tmp_path}/s"
    layouts.save_searchable(rows, path, blocks=10)
    for text, side, source in (("KIND 17 s", None, None), ("03/15/20", "credit", None), ("f3.p", None, "f3.pdf"), ("op", "credit", None), ("", None, "f1.pdf"), ("nowhere", None, None), ("kind", "debit", None)):
        got = layouts.searched(spark, path, text, side, source)
        want = ledger.search(rows, text, side, source)
        assert sorted(r["statement_id"] for r in got.collect()) == sorted(r["statement_id"] for r in want.collect()), text
    found = layouts.searched(spark, path, "KIND 17 s")
    assert "dynamicpruning" in plan_of(found).lower()
    grams = spark.read.parquet(f"{path}/grams")
    assert grams.filter("gram = '17 '").count() == 1 and grams.select("block").distinct().count() >= 8


def test_pages_read_slices(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("statement_id"), F.when(F.col("id") % 9 > 0, (F.col("id") * 37) % 50).alias("debit"), (F.col("id") % 3).alias("txn_idx"))
    path, order = f"file://{tmp_path}/p", [F.desc_nulls_last("debit"), F.asc("statement_id"), F.asc("txn_idx")]
    layouts.save_pages(rows, path, order, slices=16)
    every = [r["statement_id"] for r in rows.orderBy(*order).collect()]
    for number, size in ((0, 15), (1, 15), (30, 15), (66, 15), (67, 15), (1, 500), (0, 2000)):
        got = layouts.page(spark, path, order, number, size)
        assert [r["statement_id"] for r in got.collect()] == every[number * size : (number + 1) * size]
    slices = layouts.page(spark, path, order, 30, 15)._jdf.queryExecution().toRdd().getNumPartitions
    assert slices() == 1 and re.search(r"PartitionFilters: \[[^\]]*slice", plan_of(layouts.page(spark, path, order, 30, 15)))


def test_violations(spark, tmp_path):
    name = history.opened(spark, f"file://{tmp_path}/seen", 4)
    known = spark.createDataFrame([(1, 7, "a")], "id long, user_id long, value string").selectExpr("*", "CAST(NULL AS TIMESTAMP) uploaded_at", "'' file_name", "id statement_id")
    history.add(history.keyed(known, {"account": F.col("value")}), name, 0)
    new = spark.createDataFrame([(10, 7, "a"), (11, 8, "a"), (12, 8, "a"), (13, 7, None), (14, 7, None), (15, 7, "b"), (16, 7, "a")], "id long, user_id long, value string")
    out = {(r["id"], r["scope"], r["value"], r["reason"]) for r in history.violations(new, name, "account", F.col("value"), F.col("user_id")).collect()}
    assert out == {(10, 7, "a", "known"), (16, 7, "a", "known"), (12, 8, "a", "repeated")}
    assert history.violations(new.limit(0), name, "account", F.col("value"), F.col("user_id")).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_families(spark):
    txns = spark.createDataFrame([(1, 1, "wire from owner loan", 5), (1, 1, "Loan proceeds", 7), (2, 1, "SALES", 11), (2, 2, None, 13), (2, 2, "A2A", -1), (2, 2, "tax refund", None)], "statement_id long, account_id long, description string, c int")
    txns = txns.withColumn("credit", F.col("c").cast("decimal(14,2)")).withColumn("date", F.lit("2024-01-05").cast("date"))
    out = {(r["level"], r["statement_id"], r["account_id"], r["month"], r["family"]): (r["raw_credits"], r["deductions"], r["adjusted"]) for r in ledger.revenue_by_family(txns, rules.family_rules(spark)).collect()}
    assert out[14, None, None, None, "owner and lender wires"] == (5.0, 5.0, 0.0) and out[14, None, None, None, "financing"] == (7.0, 7.0, 0.0)
    assert out[14, None, None, None, "revenue"] == (24.0, 0.0, 24.0) and out[15, None, None, None, None] == (36.0, 12.0, 24.0)
    assert out[7, 1, None, None, None] == (12.0, 12.0, 0.0) and out[8, None, 2, "2024-01", "revenue"] == (13.0, 0.0, 13.0)
    words = [w for _, w, _ in rules.families()]
    assert words == [*rules.WIRE_DEDUCTIONS, *rules.DEDUCTIONS] and all(f for _, _, f in rules.families())


def test_ambiguous(spark):
    texts = {"01/02/2024": True, "O1/O2/2O24": True, "13/02/2024": False, "02-02-24": False, "3/4": True, "2024-01-02": False, "": False, None: False, "10.11.2024": True, "1/2/3/4": False}
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cells.ambiguous(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in out} == texts


def test_once(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, 1), (4, "b", 1)], "id int, a string, b int")
    out = cells.once(rows, ["a", "b"], x=F.concat(F.coalesce("a", F.lit("-")), F.coalesce(F.col("b").cast("string"), F.lit("-"))))
    assert sorted((r["id"], r["x"]) for r in out.collect()) == [(1, "a-"), (2, "a-"), (3, "-1"), (4, "b1")]


STATEMENTS = "user_id long, statement_id long, ord long, bank_name string, account_number string, current_balance decimal(14,2)"
TXNS = "statement_id long, txn_idx int, date string, description string, debit double, credit double"


def every_pair(spark, statements, txns, threshold):
    pairs = statements.selectExpr("user_id", "statement_id AS a").join(statements.selectExpr("user_id", "statement_id AS b"), "user_id").filter("a <> b").select("a", "b")
    found = dedupe.statement_similarity(pairs, statements, txns)
    return {tuple(r) for r in dedupe.near_duplicate(found, statements.select(F.col("statement_id").alias("b"), "ord"), threshold).collect()}


@pytest.mark.parametrize("threshold", [0.95, 0.99, 0.85])
def test_near_duplicates_by_classes(spark, threshold):
    from decimal import Decimal

    rng = random.Random(9)
    base = [("2024-01-%02d" % (k + 1), f"shop {k % 4} street {k}" if k % 7 else None, k * 1.0, None) for k in range(12)]
    statements, txns = [], []
    for s in range(70):
        kind = s % 5
        statements.append((s % 2, s, (s * 37) % 70, rng.choice(["A", "a", "B", None]), rng.choice(["*1", "X1", "2", None, "**"]), rng.choice([None, Decimal("0.00"), Decimal("5.00"), Decimal("5.01")])))
        rows = {0: [], 1: base, 2: base[:11], 3: base[::-1], 4: [r for r in base if rng.random() > 0.2]}[kind]
        txns += [(s, k, *r) for k, r in enumerate(rows)]
    statements, txns = spark.createDataFrame(statements, STATEMENTS), spark.createDataFrame(txns, TXNS)
    got = [tuple(r) for r in dedupe.near_duplicates(statements, txns, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == every_pair(spark, statements, txns, threshold)


def test_equal_statements_cost_a_row_each(spark):
    statements = spark.range(20_000).selectExpr("1L user_id", "id statement_id", "id ord", "'Bank' bank_name", "CASE WHEN id % 2 = 0 THEN 'full' ELSE 'empty' END account_number", "CAST(NULL AS DECIMAL(14,2)) current_balance")
    txns = statements.filter("statement_id % 2 = 0").selectExpr("statement_id", "explode(sequence(1, 3)) txn_idx", "'2024-01-01' date", "'the shop x' description", "1.0D debit", "CAST(NULL AS DOUBLE) credit")
    classes = dedupe.statement_classes(statements, txns)
    assert classes.count() == 20_000 and classes.select("class_id").distinct().count() == 2
    out = dedupe.near_duplicates(statements, txns)
    assert out.groupBy("duplicate_of").count().orderBy("duplicate_of").collect() == [(0, 9999), (1, 9999), (2, 1), (3, 1)]


def test_whole_documents_are_read(spark):
    rows = spark.range(400).selectExpr("1L doc_id", "CAST(id AS INT) row_idx", "array(CASE id WHEN 300 THEN 'Ending Balance: $77.25' WHEN 310 THEN 'Cust No: 12345' WHEN 320 THEN 'Account Number: # 123456' ELSE 'row' END) cells")
    txns = spark.createDataFrame([], "statement_id long, txn_idx int, balance decimal(14,2)")
    out = quality.metadata(rows, txns, rules.bank_rules(spark)).first()
    assert (out["current_balance"], out["customer_name"], out["account_number"]) == (77.25, "12345", "123456")
