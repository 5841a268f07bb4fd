"""The training-data queries that SQL can express against DuckDB."""

import math
import os

import duckdb
import pytest

from corpusops.llm.queries import ORACLE, QUERIES


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    got, want = QUERIES[name](spark, folder), db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())
