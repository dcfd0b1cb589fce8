"""Every registered query against its SQL on the smallest test tables."""

import math
import os

import pytest

from vialytics.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer documents embeddings events lineitem nation orders part conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, bool) or x is None:
            return x
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        return f"{float(x):.9g}" if isinstance(x, int) and abs(x) < 10**9 else str(x)

    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        assert plain(rows, got.columns) == plain(want.fetchall(), [d[0] for d in want.description])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_references_of_all_runs_are_resolved(spark):
    refs = {r.ref_id for r in QUERIES["import_ref_range_join_all"](spark, SF).collect()}
    assert refs == {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
