"""Every relational query against its oracle: names, number of rows and values."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(table):
    plain = lambda v: "~" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    names = sorted(table.column_names)
    return names, sorted(tuple(map(plain, row)) for row in zip(*(table.column(n).to_pylist() for n in names)))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(name, spark, duck):
    found = QUERIES[name](spark, SF).toArrow()
    want = duck.execute(ORACLE[name]).to_arrow_table()
    assert rows_of(found) == rows_of(want)
