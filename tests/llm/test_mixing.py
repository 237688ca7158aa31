import random
import re

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import mixing


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=12))
def test_targets_fill_up_and_keep_proportions(sizes):
    weights = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
    got = mixing.targets(sizes, weights, 1.5 * sum(sizes))
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, s, w in zip(got, sizes, weights, strict=True) if t < 2 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 500)), min_size=1, max_size=60))
def test_a_flight_keeps_totals_and_leaves_two(units):
    p, size = np.array([u[0] for u in units]), np.array([float(u[1]) for u in units])
    q = mixing.flight(p, size)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum(), abs=1e-6)
    assert (q * size).sum() == pytest.approx((p * size).sum(), abs=1e-3)
    landed = mixing.land(q, size)
    assert set(landed) <= {0.0, 1.0}


def test_mix_holds_words_and_documents(spark, words):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 60))), ["a", "b", "c", None][min(3, k % 6)]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mixed_rows(mixing.mix(df)).collect()}
    assert len(got) == len(rows)
    totals = {}
    for k, text, source in rows:
        r, n = got[k], len(re.findall(brute.BLANKS, text))
        assert r["size"] == n and r["taken"] in (0, n, 2 * n)
        t = totals.setdefault(source, [r["target"], r["source_size"], 0, 0])
        t[2] += r["taken"]
        t[3] += n
    for target, source_size, taken, size in totals.values():
        assert source_size == size
        assert taken == pytest.approx(target, rel=0.002, abs=3)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed_rows(mixing.mix(df.repartition(7))).collect()}
    assert again == {k: r["taken"] for k, r in got.items()}


def test_documents_come_as_often_as_taken(docs):
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in taken.items() if n}


def test_repeated_rows_nulls_and_clashing_names(spark):
    rows = [(1, "a b c", "s", 0)] * 50 + [(1, "a b", "s", 0), (None, None, None, 0), (2, "", "s", 0), (2, None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    units = mixing.mix(df)
    got = mixing.mixed_rows(units).collect()
    assert len(got) == len(rows)
    copied = [r["taken"] for r in got if r["size"] == 3]
    assert len(copied) == 50 and set(copied) <= {0, 3, 6}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.filter("text = 'a b c'").count() * 3 == sum(copied)


def test_rows_repeated_very_often_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    df = spark.createDataFrame([(1, "a b c", "s", "u")] * 50 + [(2, "a", "s", "u")], "doc_id long, text string, source string, unit string")
    rows = mixing.mixed_rows(mixing.mix(df)).collect()
    assert sorted(r["doc_id"] for r in rows) == [1] * 50 + [2]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.filter("doc_id = 1").count() * 3 == sum(r["taken"] for r in rows if r["doc_id"] == 1)


def test_empty_table(no_docs):
    assert mixing.mixed_rows(mixing.mix(no_docs)).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0
