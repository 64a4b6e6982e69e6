import os

import duckdb
import pytest
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda it: sorted(map(str, it))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want[columns].itertuples(index=False, name=None))
