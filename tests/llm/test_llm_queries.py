"""Every registered text query against its SQL at the smallest scale, and the contracts' columns."""

import math
import os

import duckdb
import pytest

from tablescout.llm.oracle import ORACLE
from tablescout.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def cell(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted([cell(row[i]) for i in order] for row in data)


def test_there_is_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    result = QUERIES[name](spark, FOLDER)
    cursor = connection.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert rows(result.columns, [tuple(r) for r in result.collect()]) == rows(columns, cursor.fetchall())
