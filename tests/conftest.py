import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def matches(spark):
    """Compares a query's rows on the smallest tables with its SQL's."""
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")

    def compare(query, sql):
        a, b = query(spark, DATA).toPandas(), con.execute(sql).df()
        # integers with nulls are doubles with NaN in the one, and of a type of their own in the other
        b = b.astype({c: "float64" for c, kind in b.dtypes.items() if str(kind) == "Int64"})
        assert sorted(a.columns) == sorted(b.columns)
        rows = [sorted(map(str, x[sorted(x.columns)].itertuples(index=False, name=None))) for x in (a, b)]
        assert rows[0] == rows[1]

    return compare
