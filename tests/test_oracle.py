"""Every oracle text binds against the tables' schemas, and hides none of them."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tallybook.catalog.oracle import CTES

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{ROOT}/{table}.parquet'")
    return connection


def test_no_ledger_table_is_named_like_a_table():
    assert not set(CTES) & set(TABLES)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_binds(oracle, name):
    text = entry.oracle_sql()[name]
    hidden = {x.lower() for x in re.findall(r"(\w+)\s+AS\s+(?:NOT\s+)?(?:MATERIALIZED\s+)?\(", text, re.I)} & set(TABLES)
    assert not hidden
    oracle.execute(f"explain {text}")
