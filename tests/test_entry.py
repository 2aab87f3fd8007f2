"""The driver's contract, and every query against its SQL on the small tables."""

import math
from decimal import Decimal
from importlib import util

import duckdb
import pytest

import __spark_entry__ as entry
from siftline import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert catalog.QUERIES.keys() >= catalog.ORACLES.keys()
    assert entry.queries().keys() >= entry.oracle_sql().keys()
    if util.find_spec("siftline.llm") and util.find_spec("siftline.llm.queries"):
        assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
