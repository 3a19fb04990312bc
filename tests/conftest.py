import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Compare a query with its SQL on the driver's tables: rows as sorted tuples, floats to 6 places."""
    import duckdb

    folder = "/root/testdata/sf0.001"

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    def check(spark, query, sql):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
        df = query(spark, folder)
        names = sorted(df.columns)
        got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
        out = con.sql(sql)
        at = [out.columns.index(c) for c in names]
        assert sorted(out.columns) == names
        assert got == sorted((tuple(norm(r[i]) for i in at) for r in out.fetchall()), key=repr)

    return check
