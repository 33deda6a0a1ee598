import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.local.dir", folder).config("spark.sql.warehouse.dir", folder).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{DATA}/{name}')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, tmp_path_factory):
    """Compare a query with its SQL by the rows that only one of them has."""

    def check(run, sql):
        out = str(tmp_path_factory.mktemp("q") / "out")
        run(spark, DATA).write.parquet(out)
        got = f"read_parquet('{out}/*.parquet')"
        duck.execute(f"create or replace temp table want as {sql}")
        names = sorted(r[0] for r in duck.sql("describe want").fetchall())
        assert names == sorted(r[0] for r in duck.sql(f"describe select * from {got}").fetchall())
        cols = ",".join(f'"{n}"' for n in names)
        missing = duck.sql(f"select {cols} from want except all select {cols} from {got} limit 3").fetchall()
        extra = duck.sql(f"select {cols} from {got} except all select {cols} from want limit 3").fetchall()
        assert not missing and not extra, (missing, extra)

    return check
