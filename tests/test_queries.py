"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differ

from __spark_entry__ import entry, oracle_sql, queries

QUICK = ["b1_", "b3_", "b4_", "c2_neigh", "c3_", "c11_", "d1_bbox", "d5_", "d8_", "e1_", "e2_", "e7_", "f1_lab", "f10b", "g6_", "r2_", "r6_", "r17", "p2_", "p4_", "d16", "w1_", "w3_", "a1_", "a8_html_to_text"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in oracle_sql() if any(n.startswith(q) for q in QUICK)])
def test_query_agrees_with_sql(spark, sf, con, name):
    assert differ(queries()[name](spark, sf), con, oracle_sql()[name]) is None
