import math
import random

import brute
import numpy as np

from tidemill.llm import vecdedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def vectors(n=900, dim=16):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, dim))
    for k in range(0, n, 3):  # groups around a vector, at angles on both sides of the threshold
        base[k + 1 : k + 3] = base[k] + rng.normal(size=(len(base[k + 1 : k + 3]), dim)) * rng.choice([0.1, 0.3])
    base[500:800] = base[0] + rng.normal(size=(300, dim)) * 0.05  # one large group
    return [(k, [float(x) for x in v.astype("f4")], k % 2 if k < 500 else 1) for k, v in enumerate(base)]


def test_links_match_brute_force(spark):
    rows = vectors()
    rows += [(10_000 + k, rows[3][1], rows[3][2]) for k in range(20)]  # exact copies
    want = brute.cosine_links(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(vecdedup.near_duplicates(df, window=64))
    assert got.keys() == want.keys()
    linked = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.95 * linked
    assert all(got[k][0] <= want[k][0] for k in want)  # no link below the threshold
    assert np.mean([got[k] == want[k] for k in want]) >= 0.95
    again = found(vecdedup.near_duplicates(df.repartition(2), window=64))
    assert again == got


def test_defined_cases(spark):
    v, w = [1.0, 2.0], [2.0, 4.0]
    rows = [(1, v, 1), (2, w, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, math.inf], 1), (9, [math.nan, 1.0], 1), (10, [], 1), (11, [1.0, 2.0, 0.0], 1), (12, v, 1), (12, v, 1), (None, v, 1), (13, [1e-30, 2e-30], 1), (14, [-0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS component_id", "'y' AS h1")
    got = vecdedup.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    told = sorted((tuple(r) for r in got.collect()), key=str)
    linked = [(k, 5, 1, k == 1) for k in (1, 2, 12, 12, None, 13)]
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 14)]
    assert told == sorted(linked + alone, key=str)


def test_empty_and_single(spark):
    assert vecdedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(vecdedup.near_duplicates(spark.createDataFrame([(4, [1.0], 1)], SCHEMA))) == {4: (0, 4)}


def test_forest_spans_what_is_linked():
    rng = random.Random(0)
    linked = np.array([[j < i and rng.random() < 0.2 for j in range(30)] for i in range(30)])
    out = vecdedup._forest(linked, np.arange(30), np.arange(30))
    a, b = brute.Union(range(30)), brute.Union(range(30))
    for i, j in zip(*np.nonzero(linked), strict=True):
        a.link(int(i), int(j))
    for i, j in out:
        b.link(i, j)
    assert len(out) < 30 and all(a.root(x) == b.root(x) for x in range(30))


def test_passes_grow_with_the_logarithm_of_the_input():
    assert vecdedup.passes_for(0) == vecdedup.passes_for(5000) == vecdedup.PASSES
    assert vecdedup.PASSES < vecdedup.passes_for(10**7) < vecdedup.passes_for(10**9) < 100


def test_vectors_of_a_common_direction_are_split(spark):
    """Pairs near the threshold are found although all vectors of the label lean one way."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(np.sqrt(0.7) * unit(rng.normal(size=32)) + np.sqrt(0.3) * unit(rng.normal(size=(3000, 32))))
    aside = rng.normal(size=(500, 32))
    aside = unit(aside - (aside * base[:500]).sum(1, keepdims=True) * base[:500])
    pairs = 0.94 * base[:500] + np.sqrt(1 - 0.94**2) * aside
    x = np.vstack([base, pairs]).astype("f4").astype(float)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    links = (unit(x) @ unit(x).T >= 0.93).sum(1) - 1
    got = found(vecdedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), window=32))
    assert sum(n for n, _ in got.values()) >= 0.95 * links.sum() and links.sum() >= 1000
    assert vecdedup.passes_for(10**6, spread=0.5) > 2 * vecdedup.passes_for(10**6)


def test_blocks_of_a_large_component_that_is_not_dense(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "BLOCK", 8)
    monkeypatch.setattr(vecdedup, "LARGEST_BLOCK", 64)
    turn = np.sort(np.random.default_rng(9).random(600)) * 2 * np.pi
    rows = [(k, [float(np.cos(a)), float(np.sin(a))], 1) for k, a in enumerate(turn)]
    want = brute.cosine_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(vecdedup.near_duplicates(df)) == want


def test_a_core_is_counted_without_comparing_it(spark):
    """300 vectors within the core, and some that link with only part of it."""
    rng = np.random.default_rng(2)
    center = np.array([1.0] + [0.0] * 15)
    near = center + rng.normal(size=(300, 16)) * 0.02
    rim = center + rng.normal(size=(150, 16)) * 0.11
    rows = [(k, [float(x) for x in v.astype("f4")], 1) for k, v in enumerate(np.vstack([near, rim]))]
    want = brute.cosine_links(rows)
    assert 0 < sum(n < 449 for n, _ in want.values())
    got = found(vecdedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert np.mean([got[k] == want[k] for k in want]) > 0.98
