"""Every query of the engine's own operators against its SQL."""

import pytest
from conftest import SMALL, rows_of

from tidemark.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, duck, name):
    ours, theirs = queries.Q[name](spark, SMALL).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(s, str) for s in entry.oracle_sql().values())
    assert entry.entry(spark).count() > 0
