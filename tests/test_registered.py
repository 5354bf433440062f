"""The queries of built-ins and of documents against DuckDB."""

import duckdb
import pytest

from gossamer import builtin_queries, document_queries

FOLDER = "/root/testdata/sf0.001"
ALL = {**builtin_queries.QUERIES, **document_queries.QUERIES}
SQL = {**builtin_queries.ORACLE, **document_queries.ORACLE}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("nation", "region", "part", "orders", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ALL)
def test_same_as_sql(spark, tables, name):
    want = tables.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = ALL[name](spark, FOLDER)
    assert got.columns == columns
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=key) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)


def test_every_case_names_a_built_in():
    for family in builtin_queries.FAMILIES:
        for column, name, form, *_ in family.cases:
            assert getattr(builtin_queries.predicate(name), form.partition(" ")[0]) is not None, (family.name, column)
