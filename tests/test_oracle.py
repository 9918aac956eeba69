"""Every query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from fieldspan import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(table, columns):
    def plain(v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)):
            return f"{float(v):.4f}".replace("-0.0000", "0.0000")
        return str(v).removesuffix(" 00:00:00").removesuffix("+00:00")

    return sorted(tuple(plain(r[c]) for c in columns) for r in table)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, duck, name):
    out = Q.QUERIES[name](spark, sf)
    got = [r.asDict() for r in out.collect()]
    assert out.columns
    if name in Q.SQL:
        want = duck.execute(Q.SQL[name]).to_arrow_table().to_pylist()
        assert sorted(out.columns) == sorted(want[0])
        assert rows(got, sorted(out.columns)) == rows(want, sorted(out.columns))
