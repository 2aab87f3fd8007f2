"""Queries of the training-data operators that have SQL, against it."""

import duckdb
import pytest

from siftline.llm import queries
from tests.conftest import SF
from tests.test_entry import rows


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.execute(queries.oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())
