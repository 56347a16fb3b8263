"""Every registered query with DuckDB SQL gives that SQL's rows."""

import pytest

from cinderlake import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(name, spark, sf, same):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry_ranks_incidents(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and rows
