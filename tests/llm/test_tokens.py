import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skewline.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def check(spark, texts):
    t = reference()
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    # with none or few of the words in the broadcast table the others come through the join
    for most in (0, 4):
        assert {r.doc_id: list(r.ids) for r in tokens.encode(df, table_words=most).collect()} == got
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}


def test_edges(spark):
    check(spark, [None, "", " ", "\n\n x", "<|endoftext|>", "'s don't 'LL we'll", "a　b c d\x1ce\x85f", "½Ⅷ²३", "🇩🇪👩‍🔧", "á" * 3, "ab " * 20000, "x" * 30000, "​﻿", "１２３ ａｂｃ", "tab\t\tend \t", "…" * 50])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), max_size=30))
def test_any_text(spark, texts):
    check(spark, texts)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert tokens.encode(df).count() == 2 and tokens.encode(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(nulls).collect()} == {1: None, 2: "a"}


def test_memory_of_words_is_bounded(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KEEP", 10)
    t = tokens.WordTable(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for i in range(5):
        t.encode(pa.array([f"w{i}{j}" for j in range(8)]))
    assert len(t.known) <= 18


def test_rates():
    r = mixing.repetition_rates({"a": 100, "b": 100, "c": 0}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3)})
    assert r == {"a": 1.0, "b": pytest.approx(1.0), "c": 0.0}
    r = mixing.repetition_rates({"a": 10, "b": 1000}, {"a": (0.5, 3), "b": (0.5, 2)})
    assert r["a"] == 3 and r["b"] == pytest.approx(0.98)
    assert mixing.repetition_rates({}, {"a": (1.0, 1)}) == {"a": 0.0}
    assert mixing.repetition_rates({"a": 10}, {"a": (1.0, 2)}, 1000) == {"a": 2.0}


def test_mix(spark):
    docs = [(i, "one two three " * (1 + i % 3), ["Big", " big\n", "small", None, "other"][i % 5]) for i in range(1000)] + [(0, "one two three ", "Big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(df)
    m = mixing.mix(df, t, sizes=sizes).collect()
    per = {}
    for r in m:
        per.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in per.values())
    assert max(len(c) for (s, _), c in per.items() if s == "big") <= 1 and max(len(c) for c in per.values()) <= 3
    rep = {r.source: r for r in mixing.mix_report(df, t, sizes=sizes).collect()}
    assert rep["none"].reached_share == 0 and sum(r.reached_share for r in rep.values()) == pytest.approx(1)
    assert rep["small"].reached_share / rep["big"].reached_share == pytest.approx(0.8, rel=0.1)
    assert sum(r.n_tokens for r in m) == sum(r.mixed_tokens for r in rep.values())
    assert {(r.doc_id, r.copy_no) for r in mixing.mix(df, t, sizes=sizes).collect()} == {(r.doc_id, r.copy_no) for r in m}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, t).count() == 0 and mixing.mix_report(df, t).head().reached_share == 0
