import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a query against its oracle: columns, then rows in any order."""

    def check(f, sql):
        got = f(spark, SF)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        want = sorted((tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
        have = sorted((tuple(cell(r[c]) for c in sorted(names)) for r in got.collect()), key=repr)
        assert len(have) == len(want)
        assert [tuple(map(str, r)) for r in have] == [tuple(map(str, r)) for r in want]

    return check
