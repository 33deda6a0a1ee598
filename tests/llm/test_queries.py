import pytest

from ledger_spark.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", [n for n in llm.queries() if n in SQL])
def test_query_equals_sql(name, same):
    same(llm.queries()[name], SQL[name])
