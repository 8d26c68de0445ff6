from datetime import datetime as T

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skewline.operators.orphans import Reference, Target, check_references, orphan_rows, orphans_by_period

PARENT = "k string, a timestamp_ntz, z timestamp_ntz, extra string"
CHILD = "k string, at timestamp_ntz, id string, extra string"


def day(n):
    return None if n is None else T(2024, 1 + n // 28, 1 + n % 28)


def run(spark, parents, children, **kw):
    p = spark.createDataFrame([(k, day(a), day(z), "x") for k, a, z in parents], PARENT)
    c = spark.createDataFrame([(k, day(t), i, "y") for k, t, i in children], CHILD)
    return {r.row_key for r in orphan_rows([Target("p", p, "k", "a", "z")], [Reference("c", "k", "p", c, "id", "at")], **kw).collect()}


def brute(parents, children):
    norm = lambda s: None if s is None else s.strip().lower()
    out = set()
    for k, t, i in children:
        if not norm(k):
            continue
        ok = t is not None and any(norm(pk) == norm(k) and a is not None and a <= t and (z is None or z > t) for pk, a, z in parents)
        if not ok:
            out.add(norm(i))
    return out


def test_cases(spark):
    parents = [(" A\t", 3, None), ("b", 1, 5), ("b", 8, None), ("c", None, None), (None, 1, None), ("b", 1, 5)]
    children = [("a", 3, "ok"), ("A ", 2, "early"), ("B", 5, "deleted"), ("b", 4, "ok2"), ("b", 9, "ok3"), ("c", 9, "nostart"), ("d", 9, " None\n"), (None, 9, "null"), (" \n", 9, "blank"), ("a", None, "notime"), ("d", 9, "none")]
    assert run(spark, parents, children) == brute(parents, children) == {"early", "deleted", "nostart", "none", "notime"}


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1, "x")]) == {"x"}
    assert run(spark, [("a", 1, None)], []) == set()


def test_periods(spark):
    p = spark.createDataFrame([("a", day(0), None, "x")], PARENT)
    c = spark.createDataFrame([("a", day(1), "1", ""), ("b", day(2), "2", ""), ("b", day(2), "2", ""), ("b", day(30), "3", ""), ("b", None, "4", "")], CHILD)
    rows = {(str(r.period), r.n_refs, r.n_orphans) for r in orphans_by_period([Target("p", p, "k", "a", "z")], [Reference("c", "k", "p", c, "id", "at")]).collect()}
    assert rows == {("2024-01-01", 2, 1), ("2024-02-01", 1, 1), ("None", 1, 1)}


keys = st.sampled_from(["a", "B ", "hot", "HOT", None, "  "])
days = st.one_of(st.none(), st.integers(0, 20))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(keys, days, days), max_size=12), st.lists(st.tuples(keys, days), max_size=25), st.sampled_from([3, 1000]))
def test_property(spark, parents, children, hot):
    """Also with hot keys cut into time slices."""
    rows = [(k, t, f"r{i}") for i, (k, t) in enumerate(children)]
    assert run(spark, parents, rows, hot_rows=hot) == brute(parents, rows)


def test_hot_key_is_cut(spark):
    parents = [("hot", i, i + 2) for i in range(0, 40, 4)]
    children = [("hot", i % 50, f"r{i}") for i in range(300)]
    assert run(spark, parents, children, hot_rows=20) == brute(parents, children)


def test_unknown_target_column(spark):
    with pytest.raises(Exception):
        check_references([Target("p", spark.range(1), "no", "a")], []).collect()


def test_a_hot_key_of_one_time(spark):
    """Children that share key and time are dealt out to several parts."""
    parents = [("hot", 5, None), ("hot", 1, 2)]
    children = [("hot", 4, f"a{i}") for i in range(200)] + [("hot", 5, f"b{i}") for i in range(200)] + [("hot", None, "n")]
    assert run(spark, parents, children, hot_rows=20) == brute(parents, children)
