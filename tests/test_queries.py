"""Every query with SQL against DuckDB on the smallest tables; skipped without them."""

import math
import os

import pytest

from skyframe.plans import frames, measure, more, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.9g}".replace("-0", "-0") if v else "0"
        return str(v) if isinstance(v, bool) or v is None else f"{v:.9g}" if isinstance(v, int) and abs(v) < 1e9 else str(v)

    return sorted(tuple(str(cell(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())
