import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.default.parallelism", "4")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def normal(value):
    """A value that compares alike whichever engine it comes from."""
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 6) + 0.0)
    return "null" if value is None else repr(value)


def table_of(rows, columns):
    order = sorted(columns)
    return order, sorted(tuple(normal(r[columns.index(c)]) for c in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Compare a query with its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, SF)
        got = table_of([tuple(r) for r in df.collect()], df.columns)
        relation = duck.sql(sql)
        want = table_of(relation.fetchall(), relation.columns)
        assert got == want

    return check
