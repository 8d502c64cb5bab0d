import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.fixture(scope="session")
def sf():
    return SF


def table_of(df):
    """Rows as sorted tuples, columns by name; floats to nine digits."""
    cols = sorted(df.columns)
    values = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return cols, sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.fixture(scope="session")
def as_rows():
    return table_of
