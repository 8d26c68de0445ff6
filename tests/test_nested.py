import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skewline.operators import nested
from skewline.operators.jsonindex import Tape

values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-1000, 10**12), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8)), lambda c: st.one_of(st.lists(c, max_size=4), st.dictionaries(st.text(max_size=5), c, max_size=4)), max_leaves=20)


def valid(text: str) -> bool:
    def strict(x):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=strict)
        return True
    except ValueError:
        return False


@settings(max_examples=80, deadline=None)
@given(st.lists(values, min_size=1, max_size=5), st.integers(0, 10**6), st.booleans())
def test_validity_is_that_of_a_parser(docs, seed, ascii_):
    rng = random.Random(seed)
    texts = [json.dumps(d, ensure_ascii=ascii_) for d in docs]
    broken = []
    for t in texts:
        i = rng.randrange(len(t) + 1)
        broken += [t[:i], t[:i] + rng.choice('{}[]:,"\\ 0e.-tx\n\x01') + t[i:], t[:i] + t[i + 1 :]]
    every = texts + broken
    tape = Tape([t.encode("utf-8", "surrogatepass") for t in every])
    assert [r >= 0 for r in tape.root] == [valid(t) for t in every]


@pytest.mark.parametrize("text", ["", " ", "[]", "{}", "[1,2", "[1,]", '{"a":1,}', '{"a" 1}', "nul", "01", "1.", "-", "+1", "NaN", "Infinity", '"\\x"', '"\\u12g4"', '"a', "]", "}{", "1 2", '{"a":}', "[,]", '{1:2}', '"\t"', "[[]]]", '{"a":[}]', "1e5", "-0.0", '"\\\\"', '"\\\\\\""', "﻿{}", "{}\x0b"])
def test_edge_texts(text):
    assert (Tape([text.encode()]).root[0] >= 0) == valid(text)


BOX = {"x1": 1, "y1": 2, "x2": "3.5", "y2": " 4 "}


def rec(**kw):
    return json.dumps({"attributes": {"weather": "clear"}, **kw})


CASES = [
    rec(labels=[{"box2d": BOX}, None, 3, {"box2d": [1, 2, 3, 4], "parts": {"box2d": BOX, "parts": [None, {"geometry": {"box2d": BOX}}]}}]),
    rec(labels={"box2d": BOX}),
    rec(frames={"objects": {"box2d": BOX}}),
    rec(frames=[{"objects": [{"box2d": [1, 2, 3]}]}, "x", {"objects": [{"box2d": [1, 2, 3, 4, 5]}, {"box2d": {"x1": 3, "y1": 2, "x2": 1, "y2": 4}}, {"box2d": BOX, "geometry": 7}]}]),
    json.dumps(rec(labels=[{"box2d": BOX}])),
    json.dumps(json.dumps(rec(labels=[{"box2d": BOX}]))),
    json.dumps({"attributes": json.dumps([{"key": "weather", "value": "rainy"}]), "labels": [{"box2d": BOX}]}),
    json.dumps({"attributes": [{"key": "weather", "value": 5}], "labels": [{"box2d": BOX}]}),
    json.dumps({"attributes": {"weather": " UNDEFINED\n"}, "labels": [{"box2d": BOX}]}),
    json.dumps({"labels": [{"box2d": BOX}]}),
    rec(labels=[{"box2d": {"x1": True, "y1": 2, "x2": 3, "y2": 4}}, {"box2d": {"x1": 1e400, "y1": 2, "x2": 3, "y2": 4}}, {"box2d": {"x1": "inf", "y1": 2, "x2": 3, "y2": 4}}, {"box2d": {"x1": "1_0", "y1": 2, "x2": 30, "y2": 4}}]),
    '{"attributes":{"weather":"clear"},"labels":[{"box2d":{"x1":9,"x1":1,"y1":2,"x2":3,"y2":4}}]}',
    '{"attributes":{"weather":"clear"},"lab\\u0065ls":[{"box2d":[0,0,1,1]}]}',
    "[1]", "7", "null", "{", "", None, '"{"',
]


def test_cases_equal_plain_reading(spark):
    df = spark.createDataFrame([(i, c, "k", "v") for i, c in enumerate(CASES)] + [(0, CASES[0], "k", "v"), (None, CASES[0], "", "")], "record_id long, payload string, weather string, obj_path string")
    got = {(r.record_id, r.obj_path, r.x1, r.y1, r.x2, r.y2) for r in nested.found_boxes(df).collect()}
    want = {(i, p, *b) for i, p, b, w in nested.reference_rows(CASES) if b and w and w.strip().lower() not in ("", "undefined")}
    assert got == want and len(got) > 8


def test_tables_are_linked(spark):
    df = spark.createDataFrame([(1, CASES[3])], "record_id long, payload string")
    objects = {r.obj_path: r for r in nested.flatten(df, "objects").collect()}
    frames = {r.frame_path for r in nested.flatten(df, "frames").collect()}
    assert frames == {"frames[0]", "frames[2]"}
    assert {o.parent_path for o in objects.values()} == frames
    r = nested.flatten(df, "records").head()
    assert (r.weather, r.n_frames, r.n_objects) == ("clear", 2, 4)
    deep = spark.createDataFrame([(1, CASES[0])], "record_id long, payload string")
    parents = {r.obj_path: r.parent_path for r in nested.flatten(deep, "objects").collect()}
    assert parents["labels[3].parts[0].parts[1]"] == "labels[3].parts[0]"


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id long, payload string")
    assert nested.found_boxes(df).count() == 0


def test_long_record(spark):
    df = spark.createDataFrame([(1, rec(labels=[{"box2d": [0, 0, i + 1, 1], "name": "é\\" * 50} for i in range(5000)]))], "record_id long, payload string")
    assert nested.found_boxes(df).count() == 5000
