"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import pytest

from leafmill.queries import collect

from .compare import same_rows

QUERIES, SQL = collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")


def test_every_sql_has_a_query_and_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert not set(SQL) - set(QUERIES)
    assert entry.entry(spark).count() > 0
    assert not set(entry.oracle_sql()) - set(entry.queries())
