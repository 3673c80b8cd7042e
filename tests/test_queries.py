"""Every query of the engine against its SQL."""

import pytest
from rows import DATA, same_rows

import __spark_entry__
from vigilrow.plans import queries as engine


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    found = engine.QUERIES[name](spark, DATA)
    if name in engine.ORACLE_SQL:
        same_rows(found, duck, engine.ORACLE_SQL[name])
    else:
        found.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
