import math

import pytest

from siftwell.plans import ORACLES, QUERIES


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    rows = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    assert rows == sorted(repr([plain(r[cols.index(c)]) for c in order]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
