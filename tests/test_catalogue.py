"""Every registered query against DuckDB on the same tables."""

import os

import duckdb
import pytest

from leadspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    sf = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con, sf


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(str(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    con, sf = duck
    df = catalogue.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in catalogue.oracle_sql():
        cur = con.execute(catalogue.oracle_sql()[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]
    else:
        assert len(got[1]) > 0
