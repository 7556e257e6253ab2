"""Every registered query of the library itself against its SQL in DuckDB, on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tessera import catalog

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert rows
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == _sorted(tuple(r[i] for i in at) for r in want.fetchall())


#: Queries whose answers have depended on the size of the tables.
LARGER = ("cmp_huffman", "cmp_huffman_codes", "gif_frames", "hash_xx32", "opt_image", "opt_jpeg", "png_palette_rounds", "webp_quality_resize")


@pytest.mark.parametrize("name", LARGER)
def test_query_on_larger_tables(spark, name):
    folder = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
    df = catalog.QUERIES[name](spark, folder)
    want = con.sql(catalog.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert _sorted(map(tuple, df.collect())) == _sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
