"""Every query with a DuckDB counterpart gives the same rows; the others give rows."""

import pytest
from oracle import agree

from corpus_engine.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        agree(df, SQL[name], small)
    else:
        assert df.count() > 0


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
