"""Every core query with SQL, side by side on the smallest tables."""

import pytest

from skewline import queries as core
from tests.oracle import connect, rows_of_spark, rows_of_sql

#: their oracle holds levels of sf0.01's spectrum
ONLY_SF001 = {"pca_scores", "pca_scores_cosine", "pca_fusion_scores", "vim_scores"}
#: near-equal values at a rounding edge differ in their last digit: compared through tests of their own
NAMES = sorted(set(core.SQL) - ONLY_SF001)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    cols, got = rows_of_spark(core.QUERIES[name](spark, sf))
    want_cols, want = rows_of_sql(con, core.SQL[name])
    assert cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", sorted(ONLY_SF001))
def test_spectral_query_equals_sql(spark, sf, name):
    d = sf.replace("sf0.001", "sf0.01")
    cols, got = rows_of_spark(core.QUERIES[name](spark, d))
    want_cols, want = rows_of_sql(connect(d), core.SQL[name])
    assert cols == want_cols
    assert got == want


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
