"""Every query of the site tables against DuckDB on the smallest tables."""

import oracle
import pytest

from sitegrid.plans import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert oracle.difference(QUERIES[name](spark, sf), SQL[name], duck) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["chrom", "id", "pos", "strand", "context", "mc", "cov"]
    assert set(e.oracle_sql()) <= set(e.queries())
