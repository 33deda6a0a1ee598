"""Plans whose shuffles and typing have to grow no faster than their input."""

import pytest
from pyspark.sql import functions as F

from ledger_spark import fixtures as fx
from ledger_spark import queries, rules
from ledger_spark.functions import cells
from ledger_spark.operators import dedupe, extract, layout, rule_sets, structure

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prepared_rows_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, 0, ["Date", "Amount"]), (1, 1, ["01/02/2003", "1.00"])], "doc_id long, row_idx int, cells array<string>")
    text = plan(extract.prepare(rows, 2000))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text and "Generate" not in text


def test_printed_statements_read_the_ledger_once(spark):
    assert plan(fx.mixed_rows(fx.ledger(spark, DATA))).count("lineitem.parquet") == 1


@pytest.mark.parametrize("raw, amount, date, lead, rest", [
    ("1,234.56", 1234.56, None, None, "1,234.56"), ("-$12.05", -12.05, "2001-12-05", None, "-$12.05"), ("12.34", 12.34, None, None, "12.34"), ("REF 12", None, None, None, "REF 12"),
    ("02/29/1999", None, None, None, "02/29/1999"), ("02/29/2004", None, "2004-02-29", "2004-02-29", ""), ("31/12/1999", None, "1999-12-31", "1999-12-31", ""), ("1/2", None, "2001-01-02", "2001-01-02", ""),
    (" 3/4  BILL 5 ", None, "2001-03-04", "2001-03-04", "BILL 5"), ("Rs. 5.00 Cr", 5.0, None, None, "Rs. 5.00 Cr"), ("1O.OO", None, None, None, "1O.OO"), ("plain", None, None, None, "plain"), (None, None, None, None, ""),
])
def test_plain_forms_are_typed_as_all_others(spark, raw, amount, date, lead, rest):
    rows = spark.createDataFrame([(1, 0, [raw])], "doc_id long, row_idx int, cells array<string>")
    t = cells.type_cells(rows, F.lit(2001)).first()["typed"][0]
    assert (t["amount"], t["date"] and str(t["date"]), t["lead"] and str(t["lead"]), t["rest"]) == (amount, date, lead, rest)


def test_similarity_does_not_repeat_rows_for_each_cent(spark):
    day = "DATE'2020-01-01'"
    a = spark.sql(f"SELECT 1L AS statement_id, CAST(id AS INT) AS txn_idx, {day} AS date, 'same words' AS description, CAST(NULL AS DECIMAL(14,2)) AS debit, CAST(id / 100 AS DECIMAL(14,2)) AS credit FROM range(1, 321)")
    b = a.withColumn("statement_id", F.lit(2).cast("long")).withColumn("credit", (F.col("credit") + 0.01).cast("decimal(14,2)"))
    rows = dedupe._compared(a)
    assert dedupe._sides(rows, rows)[0].count() < 1.2 * 320
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a long, b long")
    got = {(r["a"], r["b"]): r["similarity"] for r in dedupe.transaction_similarity(pairs, a.unionByName(b)).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 0.0}  # a cent apart, over the ends of all bands


def test_pages_without_a_header(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        columns = "* REPLACE (1 + o_custkey % 3 AS o_custkey)" if name == "orders" else "*"  # statements of several pages
        con.execute(f"COPY (SELECT {columns} FROM read_parquet('{DATA}/{name}.parquet')) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    queries.QUERIES["C4_lines_to_rows"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    want, got = queries.SQL["C4_lines_to_rows"], f"SELECT doc_id, row_idx, line FROM read_parquet('{tmp_path}/out/*.parquet')"
    assert con.sql(f"SELECT count(*) FROM ({want}) WHERE row_idx > 100").fetchall()[0][0] > 0
    assert not con.sql(f"({want}) EXCEPT ALL {got}").fetchall() and not con.sql(f"{got} EXCEPT ALL ({want})").fetchall()


def test_boxes_stay_with_their_document(spark):
    words = spark.createDataFrame([(1, 1, 0, "a", 0.0, 8.0, 0.0, 10.0, 600.0)], "doc_id long, page_no int, word_idx int, text string, x0 double, x1 double, top double, bottom double, page_width double")
    text = plan(layout.layout_report(words.repartition("doc_id")))
    assert text.count("Exchange") == 1 and "Join" not in text and "Expand" not in text


def test_few_rules_make_no_rows_of_trigrams(spark):
    texts = spark.createDataFrame([(1, "the first example bank of all"), (2, "none"), (3, None)], "doc_id long, text string")
    needles = spark.createDataFrame([("example bank",), ("no",), ("",)], "needle string")
    got = rule_sets.held(texts, needles)
    assert {tuple(r) for r in got.collect()} == {(1, "example bank"), (1, ""), (2, "no"), (2, "")} and "regexp_extract_all" not in plan(got)


PARSERS = [extract.signed_amount, extract.multicolumn, extract.standard, extract.repeated_blocks, extract.sectioned, extract.additions_subtractions, extract.typed_signed]


def evaluated(df) -> int:
    """How often a plan types rows: as often as it tests for both plain amounts and numbers that hold no date."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{cells.PLAIN_AMOUNT}) AND ")


@pytest.mark.parametrize("parser", PARSERS)
def test_filters_do_not_type_cells_again(spark, parser):
    rows = spark.createDataFrame([(1, 0, ["Date", "Amount"]), (1, 1, ["01/02/2003", "1.00"])], "doc_id long, row_idx int, cells array<string>")
    prepared = extract.prepare(rows, 2000)
    assert evaluated(prepared) == evaluated(parser(prepared)) == 1


def test_coverage_types_cells_once(spark):
    rows = spark.createDataFrame([("a", ["01/02/2003", "1.00", "Jan 5", "13/13/2003", None])], "k string, cells array<string>")
    out = cells.coverage(cells.type_cells(rows, F.lit(2000)), "k")
    assert evaluated(out) == 1
    got = {r["column"]: (r["amounts"], r["dates"], r["ambiguous"]) for r in out.collect()}
    assert got == {0: (0.0, 1.0, 1.0), 1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_dates_of_all_months_without_a_try(spark):
    days = spark.createDataFrame([(y, m, d) for y in (0, 1900, 2000, 10000) for m in (0, 2, 4, 12, 13) for d in (0, 1, 28, 29, 30, 31, 32)] + [(None, 1, 1), (2000, None, 1), (2000, 1, None)], "y int, m int, d int")
    tried = F.try_make_timestamp("y", "m", "d", F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    assert days.filter(~cells.make_date(F.col("y"), F.col("m"), F.col("d")).eqNullSafe(tried)).count() == 0


def test_a_header_cell_meets_each_role_once(spark):
    plan_ = spark.range(1).select(structure.column_roles(F.array(F.lit("Post Date"), F.lit("Date"), F.lit(""), F.col("id").cast("string"), F.lit("Amount"))).alias("r"))
    assert plan_._jdf.queryExecution().analyzed().toString().count("narration") == 1 and plan_.first()["r"] == {"date": 0, "amount": 4}


def test_fragments_read_the_ledger_once(spark):
    assert plan(queries.QUERIES["F8_fragmented"](spark, DATA)).count("lineitem.parquet") == 1


def test_the_history_of_a_report_is_made_once(spark):
    assert "lineitem.parquet" not in plan(queries.QUERIES["B8_report"](spark, DATA))


@pytest.mark.parametrize("parser, pattern", [(extract.standard, rules.TWO_COLUMN_DEBIT), (extract.sectioned, cells.MONEY_CELL), (extract.repeated_blocks, cells.MONEY_CELL)])
def test_filters_do_not_repeat_what_they_ask_for(spark, parser, pattern):
    rows = spark.createDataFrame([(1, 0, ["Date", "Amount"]), (1, 1, ["01/02/2003", "1.00"])], "doc_id long, row_idx int, cells array<string>")
    nodes = parser(extract.prepare(rows, 2000))._jdf.queryExecution().optimizedPlan().toString().split("+- ")
    assert any(pattern in n for n in nodes) and not any(pattern in n for n in nodes if n.startswith("Filter"))


@pytest.mark.parametrize("name", ["G5_general_numbers", "G6_general_ids"])
def test_labelled_documents_are_never_shuffled(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert text.count("Exchange") == 1 and text.index("Exchange") > text.index("Generate explode") and "customer.parquet" in text  # customers alone are dealt out


def plainly_repaired(cell):
    out = F.lower(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " ")))
    for broken, whole in structure.REPAIRS:
        out = F.replace(out, F.lit(broken), F.lit(whole))
    for pattern, whole in structure.PATTERN_REPAIRS:
        out = F.regexp_replace(out, pattern, whole)
    return out


def test_repairs_that_are_left_out_change_nothing(spark):
    cells_ = ["AMT ($)", "Amount", "amount  (", "Balance$", "balance)", "balance due", "Tran saction", "saction  detail", "Desc ription", "ription", "de script ion", "xription", "samt", "Post  Date", None, "", " Credit\t", "AMOUNT(amt)"]
    rows = spark.createDataFrame([([c],) for c in cells_], "cells array<string>")
    assert rows.filter(F.get(structure.header_cells(F.col("cells")), F.lit(0)) != plainly_repaired(F.get("cells", F.lit(0)))).count() == 0


def plainly_scored(cells_):
    words = lambda t: sum((F.when(t.rlike(rf"\b{w}\b"), 1).otherwise(0) for w in rules.HEADER_WORDS), F.lit(0)) + F.when(t.rlike(r"\bdate\b") & t.rlike(r"\b(?:description|activity|particulars)\b"), 3).otherwise(0)
    return cells.bound(F.array_join(structure.header_cells(cells_), " "), words)


def test_rows_without_stems_are_no_headers(spark):
    odd = [["Date", "Description"], ["update transfer"], ["update", "transfer"], ["chec\u212a", "POSTED"], ["de script ion", "AMT"], ["ription amount"], ["xdate", "xtran"], ["tran saction detail", "x"], ["trans  action details"], ["DEBITS CREDITS"], ["Post\nDate", "Balance ($)"], ["date date"], ["Statement", "item"], ["predate  trans action", ""], [None, "Date tran"]]
    rows = spark.createDataFrame([(i, 0, c) for i, c in enumerate(odd)], "doc_id long, row_idx int, cells array<string>")
    want = {r["doc_id"]: r["s"] for r in rows.select("doc_id", plainly_scored(F.col("cells")).alias("s")).collect() if r["s"] >= 2}
    got = {r["doc_id"]: r["score"] for r in structure.header_rows(rows).collect()}
    assert got == want and {0, 2, 3} <= set(got)


def test_headers_are_scored_once(spark):
    rows = spark.createDataFrame([(1, 0, ["Date", "Amount"])], "doc_id long, row_idx int, cells array<string>")
    text = structure.header_rows(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("particulars|withdrawal") + text.count(r"particulars\b") == 1


def test_roles_have_one_pattern_each(spark):
    for patterns in rules.ROLES.values():
        assert structure.role_pattern(patterns).count(r"\b(?:") >= 1 and len(structure.role_pattern(patterns)) < len("|".join(patterns)) + 8
    odd = ["Post Date", "posted", "xdate", "Tran Code", "Chk #", "check #", "Withdrawals / Debits", "end bal", "paidout", "type", "Eff Date", "moneyin", "undated details"]
    row = spark.range(1).select(*(F.array(*(F.lit(c.lower()).rlike(p) for c in odd)) for r in rules.ROLES.values() for p in ("|".join(r), structure.role_pattern(r)))).first()
    assert row[0::2] == row[1::2]


def test_a_bound_value_is_put_into_no_array(spark):
    bound = spark.range(3).select(cells.bound(F.col("id"), lambda x: x * x).alias("x"), cells.bound(F.lit(None).cast("int"), lambda x: F.coalesce(x, F.lit(7))).alias("n"))
    assert "transform(" not in plan(bound) and [tuple(r) for r in bound.collect()] == [(0, 7), (1, 7), (4, 7)]


def test_blocks_read_a_header_once(spark):
    rows = spark.createDataFrame([(1, 0, ["Date", "Description", "Amt", "Date", "Description", "Amount"]), (1, 1, ["01/02/2003", "X", "1.00"])], "doc_id long, row_idx int, cells array<string>")
    out = extract.repeated_blocks(extract.prepare(rows, 2000))
    nodes = out._jdf.queryExecution().optimizedPlan().toString().split("+- ")
    assert sum(n.count("tran saction") for n in nodes if n.startswith("Filter")) == 2  # tested for and repaired
    assert [(r["row_idx"], r["description"]) for r in out.collect()] == [(1, "X")]


def test_printed_statements_are_parsed_in_all_partitions(spark):
    rows = queries.layout_rows(spark, DATA, "standard")
    assert plan(rows).count("REPARTITION_BY_NUM") == 1 and plan(rows).count("hashpartitioning(statement_id") == 1
    a, b = (fx.ledger(spark, DATA, spread=s) for s in (False, True))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_rows_without_repairs_are_read_as_they_are(spark):
    text = structure.header_rows(spark.createDataFrame([(1, 0, ["Date", "Amount"])], "doc_id long, row_idx int, cells array<string>"))
    assert structure.CHANGED in text._jdf.queryExecution().optimizedPlan().toString()
    odd = [["Deposits", "and credits"], ["tran  saction", "check"], ["Date  Desc", "Amount"], ["date", "Tran"], ["saction\tdetail", "posted"], ["Balance", "Debits"], [None, "amt", "DATE"]]
    rows = spark.createDataFrame([(c,) for c in odd], "cells array<string>")
    every = F.array_join(structure.header_cells(F.col("cells")), " ")
    wanted = F.array_distinct(F.regexp_extract_all(every, F.lit(rf"\b(?:{'|'.join(rules.HEADER_WORDS)})\b"), F.lit(0)))
    assert rows.filter(~structure.header_words(F.col("cells")).eqNullSafe(wanted)).count() == 0


def test_rows_of_other_accounts_are_not_searched(spark, monkeypatch):
    found = []
    near_pairs = dedupe.near_pairs
    monkeypatch.setattr(dedupe, "near_pairs", lambda *args: found.append(near_pairs(*args)) or found[0])
    txns = spark.sql("SELECT s.id AS statement_id, CAST(r.id AS INT) AS txn_idx, DATE'2020-01-01' AS date, concat('row ', r.id) AS description, CAST(NULL AS DECIMAL(14,2)) AS debit, CAST(if(s.id >= 40 AND r.id = 1, 7, 5) AS DECIMAL(14,2)) AS credit FROM range(42) s, range(1, 21) r")
    statements = spark.sql("SELECT 1L AS user_id, id AS statement_id, id AS ord, 'Bank' AS bank_name, if(id = 39, CAST(NULL AS STRING), concat('**', id % 40)) AS account_number, CAST(NULL AS DECIMAL(14,2)) AS current_balance FROM range(42)")
    got = {tuple(r) for r in dedupe.near_duplicates(statements, txns).collect()}
    assert got == {(0, 39), (40, 0), (1, 39), (41, 1), (39, 0)} | {(k, 39) for k in range(2, 39)}
    assert found[0].count() <= 4 + 2 * 41  # 40 statements of the same rows made 42 x 41


def test_lines_are_grouped_once(spark):
    lines = queries.scanned(spark, DATA)
    text = plan(layout.lines_to_rows(lines))
    assert text.count("lineitem.parquet") == 1 and text.count("Exchange") == plan(lines).count("Exchange") and text.count("Join") == plan(lines).count("Join")


def test_typed_rows_are_stored_once(spark, monkeypatch):
    from ledger_spark.plans import statements as plans

    seen = []
    stored = extract.stored
    for module in (plans, extract):
        monkeypatch.setattr(module, "stored", lambda df, *by: seen.append((df.columns, plan(df))) or stored(df, *by))
    rows = queries.stored(fx.mixed_rows(fx.ledger(spark, DATA)))
    plans.parsed(rows, queries.names(rows), rules.templates(spark), 2000)
    typed = [text for columns, text in seen if "typed" in columns]
    assert len(typed) == 1 and "AS typed" in typed[0]  # the job that stores them makes them


def test_files_are_hashed_line_by_line(spark, tmp_path):
    import hashlib
    import random

    from ledger_spark.sources import files

    rng = random.Random(3)
    made = {"a.pdf": b"one\ntwo", "b c.pdf": b"one\n\r\ntwo\n", "end.txt": b"\n", "bom.txt": b"\xef\xbb\xbfx\n", "n%20.png": rng.randbytes(300_000), "zero.bin": b"\0" * 70_000, "p.gz": b"not packed\n", "q[1]{2}.GZ": b"nor that", "a[1]*.pdf": b"three\n\n\n\nlines", "ü.txt": "ü\xff".encode("latin-1"), "_hidden": b"x"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    found = files.listed(spark.read.format("binaryFile").load(str(tmp_path))).drop("content")
    out = files.fingerprinted(found)
    got = {r["length"]: r["file_hash"] for r in out.collect()}
    assert got == {len(data): hashlib.sha256(data).hexdigest() for name, data in made.items() if not name.startswith("_")}
    assert files.fingerprinted(found.filter("length < 0")).count() == 0


def test_rewritten_statements_are_parsed_in_all_partitions(spark):
    assert plan(queries.rewritten(spark, DATA, ["x"], lambda: F.array(F.array("description")))).count("REPARTITION_BY_NUM") == 1
