"""Every registered query at the smallest scale: against its SQL, or that it gives rows."""

import pytest
from oracle import SF, rows_of, sql_rows

from vellum.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    names, rows = rows_of(registry.QUERIES[name](spark, SF))
    if name in registry.ORACLES:
        assert (names, rows) == sql_rows(registry.ORACLES[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
