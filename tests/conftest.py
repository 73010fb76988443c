import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare(sf):
    """Compares a query's rows with those of DuckDB's SQL over the same tables."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def value(x):
        if x is None or x != x:
            return None
        return str(x)[:10] if hasattr(x, "year") and str(x)[10:] in ("", " 00:00:00") else str(x)

    def run(df, sql):
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(names)
        a = sorted([tuple(value(r[c]) for c in sorted(names)) for r in df.collect()], key=str)
        order = sorted(range(len(names)), key=lambda i: names[i])
        b = sorted([tuple(value(r[i]) for i in order) for r in want.fetchall()], key=str)
        assert a == b

    return run
