import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parleylake.llm import mixing, splitting
from parleylake.llm.tokens import VOCABULARY, token_counts, tokenizer

TEXT = st.text("ab c.,，。好😀\n\té", max_size=600)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(8, 60), st.integers(0, 3))
def test_pieces_are_small_ordered_and_cover(text, limit, overlap):
    t = tokenizer(VOCABULARY)
    pieces = splitting.split_text(text, t, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for lo, hi, n, piece in pieces:
        assert text[lo:hi] == piece and t.count(piece) == n <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert a[0] < b[0] <= a[1] < b[1]


def test_natural_cuts_and_overlap():
    t = tokenizer(VOCABULARY)
    text = "\n\n".join(" ".join(f"word{i}" for i in range(60)) + "." for _ in range(30))
    pieces = splitting.split_text(text, t, 256, 16)
    assert all(p[3].endswith("\n\n") or p[3].endswith(".") for p in pieces[:-1])
    for a, b in zip(pieces, pieces[1:]):
        assert 16 <= t.count(text[b[0] : a[1]]) <= 20


def test_splitting(spark):
    long = "好的，收到。" * 900
    df = spark.createDataFrame([(1, long, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (None, long, "x"), (1, long, "x"), (5, "a" * 400_000, "x"), (6, " " * 300_000, "x")], "doc_id long, text string, piece string")
    got = splitting.split_oversized(df)
    assert {r.doc_id for r in got.where("piece_no = 0").collect()} == {1, None, 5, 6} and got.where("n_tokens > 1024").count() == 0
    assert got.where("doc_id = 1 and piece_no = 0").count() == 2 and splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=10, overlap=5)


def test_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, n_tokens string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"]).collect()} == {1: tokenizer(VOCABULARY).count("hello world"), 2: 0, 3: 0}


def test_rates():
    r = {x.source: x for x in mixing.repetition_rates([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("gone", 0.0, 3)], {"a": 100, "b": 100, "c": 10}, 200)}
    assert r["a"].rate == 1 and r["c"].rate == 2 and abs(r["b"].rate - 0.8) < 1e-9 and r["gone"].rate == 0
    assert all(x.rate == 0 for x in mixing.repetition_rates([("a", 1.0, 3)], {}))
    assert mixing.repetition_rates([("a", 0.5, 2), ("b", 0.5, 9)], {"a": 60, "b": 40})[1].rate == 50 / 40


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "other"]), "word " * rng.randrange(1, 60), "clash") for i in range(3000)] + [(5000, "a", None, "x"), (5001, "b", "", "x"), (None, "a", "null id", "x")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, copies string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 2), ("gone", 0.05, 3), (None, 0.1, 1), ("a", None, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(d.drop("copies"), t)
    per = {(r.doc_id, r.source): r["count"] for r in mix.groupBy("doc_id", "source").count().collect()}
    assert {s for _, s in per} == {"a", "b", "c"} and max(n for (_, s), n in per.items() if s == "a") == 1 and max(per.values()) <= 4
    again = {(r.doc_id, r.source): r["count"] for r in mixing.mix_sources(d.drop("copies").repartition(7), t).groupBy("doc_id", "source").count().collect()}
    assert again == per
    rep = {r.source: r for r in mixing.mix_report(d, t).collect()}
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9 and rep["gone"].actual_share == 0 and all(r.most_copies <= r.max_repeats for r in rep.values())
    tok = tokenizer(VOCABULARY)
    assert rep["a"].source_tokens == sum(tok.count(x) for _, s, x, _ in docs if s == "a" and x)
    free = [r for r in rep.values() if 0 < r.rate < r.max_repeats]
    for r in free:
        assert abs(r.mixed_tokens / r.source_tokens - r.rate) < 0.06 * max(1, r.rate)
    assert mixing.mix_sources(d.drop("copies").limit(0), t).count() == 0 and mixing.mix_sources(d.drop("copies"), t.limit(0)).count() == 0
