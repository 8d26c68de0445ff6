import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skewline.llm import topn

SCHEMA = "g long, i long, s double, v int, band int, r int"


def brute(rows, n, versioned=True):
    best = {}
    for g, i, s, v in rows:
        if i is None:
            continue
        if versioned:
            key = (v is not None, v or 0, g is not None, g or 0, s is not None, math.inf if s is not None and math.isnan(s) else s or 0.0, s is not None and math.isnan(s))
            if i not in best or key > best[i][0]:
                best[i] = (key, g, s)
        elif g is not None and s is not None and math.isfinite(s):
            if (g, i) not in best or s > best[g, i][2]:
                best[g, i] = (None, g, s)
    groups = {}
    for k, (_, g, s) in best.items():
        if g is not None and s is not None and math.isfinite(s):
            groups.setdefault(g, []).append((-s, k if versioned else k[1]))
    return {(g, i, r + 1) for g, xs in groups.items() for r, (_, i) in enumerate(sorted(xs)[:n])}


def run(spark, rows, n, versioned=True, bands=topn.BANDS):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    out = topn.top_n_per_group(df, "g", "i", "s", n, version="v" if versioned else None, bands=bands)
    return {(r.g, r.i, r["rank"]) for r in out.collect()}


scores = st.one_of(st.none(), st.sampled_from([1.0, 2.0, 2.0, -0.0, 0.0, math.nan, math.inf, -math.inf]), st.floats(-5, 5, width=16))
row = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 12)), scores, st.one_of(st.none(), st.integers(0, 3)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, max_size=50), st.integers(1, 4), st.booleans())
def test_equals_brute_force(spark, rows, n, versioned):
    assert run(spark, rows, n, versioned) == brute(rows, n, versioned)


def test_ties_across_bands_and_repeats(spark):
    rows = [(1, i, 5.0, 0) for i in range(30)] + [(2, 100 + i, float(i), 0) for i in range(30)] + [(3, 500, 1.0, 0)]
    assert run(spark, rows * 2, 5, bands=(0.1, 0.3, 0.5, 0.9)) == brute(rows, 5)


def test_empty(spark):
    assert run(spark, [], 5) == set()
    assert run(spark, [(None, 1, 1.0, 0), (1, 1, None, 1)], 5) == set()


def test_query_equals_sql(spark, sf):
    from skewline.llm import queries as q
    from tests.oracle import connect, rows_of_spark, rows_of_sql

    con = connect(sf)
    for name in sorted(set(q.SQL) - {"p2_found", "p2_knn"}):
        cols, got = rows_of_spark(q.QUERIES[name](spark, sf))
        want_cols, want = rows_of_sql(con, q.SQL[name])
        assert cols == want_cols and got == want, name
