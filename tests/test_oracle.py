"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import pytest

from tests.oracle_compare import compare

# run elsewhere: it fits 2,000 trees
SLOW = {"importance_planted"}


def _names():
    import __spark_entry__ as E
    from binscope.plans.queries import QUERIES
    return sorted(set(E.oracle_sql()) & set(QUERIES) - SLOW)


@pytest.mark.parametrize("part", range(8))
def test_queries_match_oracle(spark, sf001, part):
    """Every SQL-backed query, in eight parts."""
    res = compare(spark, sf001, _names()[part::8], verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "MATCH"}
    assert not bad, bad


def test_entry_runs(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
