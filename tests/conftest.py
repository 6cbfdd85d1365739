import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same(df, sql, sf=SF):
    """Spark's rows equal DuckDB's, whatever the order."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    keys = sorted(a.columns)
    a, b = (x[keys].astype(str).sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)
