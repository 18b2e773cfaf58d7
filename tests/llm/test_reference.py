"""Queries whose rows SQL can state give the same rows as DuckDB."""

import duckdb
import pytest

from voxtable.llm import queries as q

DATA = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(q.ORACLES[name])
    names = [c[0] for c in want.description]
    df = q.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in q.QUERIES}) == list(range(1, 14))
