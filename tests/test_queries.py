"""Every query against its SQL, over the smallest tables."""

import pytest

from tidemark import queries as own

SQL = own.oracle_sql()


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, sf_dir, duck, same, name):
    found = own.queries()[name](spark, sf_dir).toPandas()
    if name in SQL:
        same(duck.execute(SQL[name]).df(), found)
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
