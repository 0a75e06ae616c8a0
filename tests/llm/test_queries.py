import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomspan.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    df = entry.queries()[name](spark, data)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert got or name == "p8_found"
        return
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = c.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    key = lambda r: tuple("" if x is None else str(float(x)) if isinstance(x, (int, float)) else x for x in r)
    assert sorted(df.columns) == sorted(cols) and sorted(key(r[k] for k in cols) for r in got) == sorted(map(key, want.fetchall()))
