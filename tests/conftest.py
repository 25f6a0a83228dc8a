"""One local session for all tests."""

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from substrata.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "4g", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables aren't here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


def same_rows(frame, relation):
    """Compare a Spark result with DuckDB's: names, number of rows, values; numbers to nine digits."""
    left, right = frame.toPandas(), relation.df()
    assert sorted(left.columns) == sorted(right.columns)
    names = sorted(left.columns)

    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return f"{x:.9g}" if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind in "fiu" else f"{x:.9g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    rows = lambda f: sorted(tuple(map(text, r)) for r in f[names].astype(object).itertuples(index=False))
    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []
