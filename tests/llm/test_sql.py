"""Queries that SQL can express give its rows, names and types."""

import duckdb
import pytest

from terraquill.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert {c: KINDS[t] for c, t in got.dtypes} == kinds
    want = con.execute(ORACLE[name]).fetchall()
    assert sorted((tuple(r) for r in got.select(*kinds).collect()), key=repr) == sorted(want, key=repr) and want
