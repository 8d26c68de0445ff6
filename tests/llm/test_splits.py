import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skewline.llm import splits


def brute(ids, edges):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.one_of(st.none(), st.integers(0, 8)), st.one_of(st.none(), st.integers(0, 8))), max_size=30), st.lists(st.tuples(st.integers(-1, 26), st.integers(-1, 26)), max_size=12))
def test_units_equal_union_find(spark, rows, links):
    df = spark.createDataFrame([(i, None if a is None else f"a{a}", None if b is None else f"b{b}", f"n{i}", 0) for i, a, b in rows], "id long, a string, b string, n string, unit int")
    l = spark.createDataFrame([(f"n{x}", None if y < 0 else f"n{y}") for x, y in links], "a string, b string")
    got = {r.id: r.unit for r in splits.units(df, "id", ["a", "b"], l, "n").collect()}
    ids = {r[0] for r in rows}
    edges = [(x[0], y[0]) for x in rows for y in rows if (x[1] is not None and x[1] == y[1]) or (x[2] is not None and x[2] == y[2])]
    edges += [(x, y) for x, y in links if x in ids and y in ids]
    assert got == brute(ids, edges)


def test_long_chain_and_hub(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)], "a long, b long")
    got = {r.id: r.root for r in splits.connected(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_shares_labels_and_whole_units(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i if i >= 900 else i // 3, ["x", "y", None][rng.integers(0, 3)] if i % 50 else "rare") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, u long, label string")
    u = df.groupBy("u").agg({"id": "min"}).withColumnRenamed("min(id)", "unit").join(df, "u").select("id", "unit")
    out = splits.split_units(df, u, "id", ["label"], blocks=64)
    got = out.collect()
    assert len(got) == 3000 and len({(r.unit, r.split) for r in got}) == len({r.unit for r in got})
    share = {s: sum(r.split == s for r in got) / 3000 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02
    rare = {r.id for r in got if r.id % 50 == 0}
    in_train = sum(r.split == "train" for r in got if r.id in rare)
    assert abs(in_train / len(rare) - 0.8) < 0.12
    rep = {r.split: r for r in splits.split_report(out, df, "id", ["label"]).where("label = 'all'").collect()}
    assert rep["train"].n == round(share["train"] * 3000)


def test_label_shares_of_the_images(spark, sf):
    """Frequent labels come within 2 % of the targets in every split."""
    from skewline.llm import queries

    rep = queries.p4_report(spark, sf.replace("sf0.001", "sf0.1")).collect()
    whole = {}
    for r in rep:
        whole[r.label, r.value] = whole.get((r.label, r.value), 0) + r.n
    frequent = [r for r in rep if whole[r.label, r.value] >= 400]
    assert len(frequent) >= 20
    assert max(abs(r.reached - r.target) for r in frequent) <= 0.02, sorted((abs(r.reached - r.target), r.label, r.value, r.split) for r in frequent)[-5:]


def test_hot_keys_and_hubs_by_broadcast(spark, monkeypatch):
    """What large tables do with hot keys gives the same units."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 97}", f"s{i % 211}" if i % 2 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    plain = sorted(splits.units(df, "id", ["a", "b"]).collect())
    monkeypatch.setattr(splits, "HOT_FROM", 0)
    monkeypatch.setattr(splits, "HUB_SHARE", 0.01)
    assert sorted(splits.units(df, "id", ["a", "b"]).collect()) == plain


def test_too_many_label_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_LABELS", 3)
    df = spark.range(10).selectExpr("id", "cast(id as string) as label")
    with pytest.raises(ValueError):
        splits.split_units(df, df.selectExpr("id", "id as unit"), "id", ["label"])


def test_unit_with_a_third_of_the_records(spark):
    rows = [(i, 0 if i < 300 else i) for i in range(900)]
    df = spark.createDataFrame([(i, "l") for i, _ in rows], "id long, label string")
    u = spark.createDataFrame(rows, "id long, unit long")
    got = splits.split_units(df, u, "id", ["label"]).collect()
    assert {r.split for r in got if r.unit == 0} == {"train"}
    assert abs(sum(r.split == "train" for r in got) / 900 - 0.8) < 0.02


def test_empty_and_errors(spark):
    df = spark.createDataFrame([], "id long, a string, label string")
    assert splits.units(df, "id", ["a"]).count() == 0
    assert splits.split_units(df, df.selectExpr("id", "id as unit"), "id", ["label"]).count() == 0
    with pytest.raises(ValueError):
        splits.split_units(df, df, "id", ["label"], shares=(0.5, 0.4, 0.2))
