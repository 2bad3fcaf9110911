"""Every query with SQL gives DuckDB's rows on the smallest driver tables."""

import os

import duckdb
import pytest

from riskloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return float(f"{float(v):.9g}") if isinstance(v, float) or v.__class__.__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(repr([norm(v) for _, v in sorted(zip(cols, r))]) for r in cur.fetchall())
    df = registry.queries()[name](spark, SF)
    got = sorted(repr([norm(v) for _, v in sorted(r.asDict().items())]) for r in df.collect())
    assert sorted(cols) == sorted(df.columns) and got == want


def test_entry_registers_what_it_claims():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "composite_risk_topk" in e.queries()
