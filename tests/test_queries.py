"""Every named query against its SQL on DuckDB, all rows and values."""

import pytest

from tests.compare import connect, difference
from trackloom.plans import all_queries

NAMED = all_queries()
# Queries whose result is empty by definition.
NO_ROWS: set[str] = set()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(NAMED))
def test_query(spark, con, folder, name):
    declared = NAMED[name]
    frame = declared.run(spark, folder)
    assert difference(frame, con, declared.sql, some=name not in NO_ROWS) is None


def test_every_key_is_exported():
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(NAMED)
    assert set(entry.oracle_sql()) <= set(entry.queries())
