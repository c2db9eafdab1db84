"""Every query with an oracle gives what DuckDB gives on the same tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from blockloom import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        if isinstance(v, Decimal):
            return repr(round(float(v), 9))
        return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    a, b = canonical(got.collect(), got.columns), canonical(want.fetchall(), columns)
    assert a[1] == b[1]
    assert a[0] == b[0]
