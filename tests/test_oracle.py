"""Registered queries against their SQL on the smallest tables; ``tests/oracle.py`` does the same at sf0.01."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from tamis.queries import QUERIES, SQL

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# at the smallest scale these tables are too small for the columns their SQL names
NEED_MIDDLE = {"enc_count"}


@pytest.fixture(scope="module")
def connections():
    return {d: connect(d) for d in (SMALL, MIDDLE)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, connections, name):
    folder = MIDDLE if name in NEED_MIDDLE else SMALL
    ok, note = compare(spark, name, QUERIES[name], SQL[name], folder, connections[folder])
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
