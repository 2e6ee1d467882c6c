import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Spark's Python workers import the package too
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows against its SQL."""

    def check(name):
        import __spark_entry__

        df = __spark_entry__.queries()[name](spark, SF)
        found = duck.execute(__spark_entry__.oracle_sql()[name])
        names = [d[0] for d in found.description]
        want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in found.fetchall())
        got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
        assert sorted(names) == sorted(df.columns)
        assert got == want

    return check
