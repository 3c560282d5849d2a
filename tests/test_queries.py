"""Every core query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from riskweave.plans.registry import gather

QUERIES, ORACLE = gather("QUERIES"), gather("ORACLE")


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    a, b = query(spark, sf).toPandas(), con.execute(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def norm(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else v

    rows = lambda x: sorted(repr([norm(v) for v in r]) for r in x[cols].astype(object).itertuples(index=False, name=None))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
