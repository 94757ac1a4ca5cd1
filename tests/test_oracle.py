"""Every registered query that has SQL, compared with DuckDB at the smallest scale.

ORACLE_SF picks another scale; ORACLE_BLOCK forces blocks of that many rows.
"""

import os

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    if os.environ.get("ORACLE_BLOCK"):
        spark.conf.set("timeweave.block.rows", os.environ["ORACLE_BLOCK"])
    columns, rows = compare.rows_of_spark(QUERIES[name](spark, SF_DIR))
    wanted_columns, wanted = compare.rows_of_sql(duck, SQL[name])
    assert columns == wanted_columns
    assert rows == wanted, compare.difference(rows, wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).schema.names
