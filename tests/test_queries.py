import pytest
from oracle import compare

from furrow.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, sf, name):
    """Rows, and no column that is null throughout."""
    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].asDict())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
