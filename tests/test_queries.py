"""Every registered query against its SQL counterpart at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tablescout.plans.oracle import ORACLE
from tablescout.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted([cell(row[i]) for i in order] for row in data)


#: Queries that report what a search read: numbers of the method, which SQL over the tables cannot know.
READS = {"q52_ivf_reads", "q53_scored_pairs", "q60_layout_reads"}


def test_every_oracle_has_a_query():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(ORACLE) == set(QUERIES) - READS


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, tables, name):
    result = QUERIES[name](spark, FOLDER)
    found = rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = tables.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert found == rows(columns, cursor.fetchall())


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["qid", "rank", "id", "dist_km", "cos_dist", "score", "semantic"]
    assert not result.isEmpty()
