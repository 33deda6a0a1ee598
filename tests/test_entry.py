import __spark_entry__ as entry


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_not_needed():
    import subprocess
    import sys

    gone = "import importlib.util as u; found = u.find_spec; u.find_spec = lambda n, *a: None if n in ('ledger_spark.llm', 'corpus_pipeline') else found(n, *a)"
    code = f"{gone}\nimport __spark_entry__ as e\nassert 'H4_statement_list' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)
