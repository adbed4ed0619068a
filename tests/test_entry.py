import duckdb
import pytest

import __spark_entry__ as entry
from thalweg import catalogue

DIR = "/root/testdata/sf0.001"
SLOW = {"fd8_accumulation", "network_index", "sediment_lines", "sediment_risk"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DIR)
    expected = con.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(expected.columns)
    plain = lambda rows: sorted(tuple((v is None, 0 if v is None else v) for v in r) for r in rows)
    got, want = plain(df.select(*cols).collect()), plain(expected.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for (x_null, x), (y_null, y) in zip(a, b):
            assert x_null == y_null
            assert x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y
