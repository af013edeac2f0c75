"""Registered queries against their SQL, value for value, on a small table."""

from pathlib import Path

import duckdb
import pytest

from docquarry.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    expected = {tuple(map(repr, (r[names.index(c)] for c in df.columns))) for r in cur.fetchall()}
    got = df.collect()
    assert {tuple(map(repr, r)) for r in got} == expected and len(got) == len(expected)
