"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from marlstone.plans import registry

from .compare import duck_rows, spark_rows, tables_of


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = spark_rows(registry.QUERIES[name](spark, sf))
    if name in registry.ORACLE:
        assert got == duck_rows(registry.ORACLE[name], tables_of(sf))
    else:
        assert got[0]


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
