import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("fixture tables are not here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(df):
    """Rows as sorted tuples of text, columns by name; doubles to six places."""
    names = sorted(df.columns)

    def plain(v):
        if v is None or v != v:
            return "null"
        if not isinstance(v, bool | str) and isinstance(v, int | float):
            return f"{v + 0.0:.6f}"
        return str(v)

    return names, sorted(tuple(plain(r[c]) for c in names) for r in df[names].to_dict("records"))


@pytest.fixture(scope="session")
def same(duck, sf):
    """Compare a registered query with its SQL."""

    def check(spark, run, sql):
        return rows_of(run(spark, sf).toPandas().astype(object)), rows_of(duck.sql(sql).df().astype(object))

    return check
