"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    frame = QUERIES[name](spark, small)
    if name in TWINS:
        assert difference(frame, duck, TWINS[name]) is None
    else:
        assert frame.count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["group_value", "kpi", "value", "unit", "status"]
