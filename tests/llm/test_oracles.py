import os

import duckdb
import pytest

from alertloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{os.path.join(SF, table)}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows and rows == sorted(want.fetchall(), key=key)
