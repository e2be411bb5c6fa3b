import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def same(df, sql, sf_dir):
    """Spark's rows are DuckDB's, in any order."""
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    a, b = df.toPandas(), c.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, (bool, str)):
            return v
        return round(float(v), 6)

    rows = lambda x: sorted(repr([plain(v) for v in r]) for r in x[cols].itertuples(index=False, name=None))
    assert rows(a) == rows(b)
