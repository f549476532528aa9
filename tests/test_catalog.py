"""Every registered query that has SQL gives the rows that DuckDB gives for it."""

import math
from collections import Counter

import duckdb
import pytest

from tessella import catalog
from tessella.plans import views

#: Empty on the smallest tables, whose lattice has two layers.
MAY_BE_EMPTY = {"f21_disk", "c4_c5_divergence_and_rotation"}
SLOW = set()


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows or name in MAY_BE_EMPTY
    if name not in catalog.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in rows) == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
