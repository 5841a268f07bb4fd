"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusops.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else str(value) if not isinstance(value, (int, bool)) else value


def rows(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_queries_without_sql_are_those_tested_otherwise():
    """test_page_queries_against_patterns and test_hashed_vectors restate these."""
    assert set(QUERIES) - set(ORACLE) == {"heading_sections", "person_profile", "people_cards", "hashed_tfidf"}
