import random
import re

import brute
import numpy as np
import pytest

import corpus_pipeline
from tidemill.llm import shingles, simhash


def words_set(text):
    words = re.findall(brute.BLANKS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else []))


def near_classes(rows):
    """rows: (id, text), ids unique -> id: smallest id of its class."""
    sets = {k: words_set(t) for k, t in rows}
    union, ids = brute.Union(sets), list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                union.link(a, b)
    return {k: union.root(k) for k in ids}


def test_classes_match_brute_force(docs, corpus):
    got = {r["doc_id"]: r["component_id"] for r in shingles.classes(docs).collect()}
    assert got == near_classes([(r[0], r[1]) for r in corpus])


def test_the_stage_links_from_four_fifths_on(spark, sf_dir):
    """Texts of n different words share all but some of their shingles: 80 of 100 are near, 79 of 100 aren't."""
    rows, want = [], set()
    for k, (shared, own) in enumerate([(80, 10), (79, 10), (400, 50), (398, 50), (900, 20)]):
        body = [f"w{k}x{i}" for i in range(shared + 4)]
        for side in range(2):
            rows.append((10 * k + side, " ".join(body + [f"o{k}x{side}x{i}" for i in range(own)])))
        want |= {10 * k} if 5 * shared >= 4 * (shared + 2 * own) else {10 * k, 10 * k + 1}
    assert want == {0, 10, 11, 20, 30, 31, 40}
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == want


def test_groups_chains_and_common_passages(spark, monkeypatch):
    """A dense group, a chain whose ends are far apart, and texts that hold one passage."""
    monkeypatch.setattr(shingles, "COMMON", 2)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(60):  # all near the first, or only near others
        changed = list(base)
        for i in rng.sample(range(120), 1 + k % 5):
            changed[i] = f"c{k}x{i}"
        texts.append(" ".join(changed))
    line = [f"l{i}" for i in range(300)]
    texts += [" ".join(line[i : i + 100]) for i in range(0, 200, 8)]
    passage = [f"p{i}" for i in range(50)]
    texts += [" ".join(passage + [f"q{k}x{i}" for i in range(2 + 3 * k)]) for k in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows)
    assert 5 < len(set(got.values())) < 60


@pytest.mark.parametrize("large", [2, 64])
def test_a_group_around_the_threshold(spark, monkeypatch, large):
    """Copies of one text with so many changes that some are near each other, some only near a few, some to none."""
    monkeypatch.setattr(shingles, "COMMON", 2)
    monkeypatch.setattr(shingles, "DENSE", 1)
    monkeypatch.setattr(shingles, "PIVOTS", 2)
    monkeypatch.setattr(shingles, "LARGE", large)
    rng, base, texts = random.Random(11), [f"b{i}" for i in range(150)], []
    for k in range(150):
        changed = list(base)
        for i in rng.sample(range(150), 1 + k % 6):
            changed[i] = f"c{k}x{i}"
        texts.append(" ".join(changed))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == near_classes(rows)
    assert 3 < len(set(got.values())) < 120


def test_prefixes_of_near_sets_meet_whatever_is_common():
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.choice(10_000, 130, replace=False).astype(np.int64)
        n = int(rng.integers(1, 100))
        a, b = np.unique(pool[:n]), np.unique(pool[int(n * 0.1) : n + int(n * 0.1)])
        common = np.unique(rng.choice(pool, 60))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(shingles.prefix(a, common), shingles.prefix(b, common)))


def test_parities_of_unlike_numbers_bound_the_difference(spark):
    """Large sets have more parities; folded, they still differ in no more cells than sets do in shingles."""
    rng = np.random.default_rng(6)
    rows = []
    for n, m in ((900, 1100), (1000, 1030), (3900, 4400), (5000, 5000), (30, 30)):
        pool = rng.integers(-(2**62), 2**62, n + m)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n - n // 10], pool[n : n + m - (n - n // 10)]]))
        rows.append((shingles.parities(a).tolist(), shingles.parities(b).tolist(), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, apart int")
    got = df.select("apart", shingles._differ(df["a"], df["b"]).alias("d")).collect()
    assert all(r["apart"] / 2 < r["d"] <= r["apart"] for r in got)
    assert len({len(r[0]) for r in rows}) > 1 and any(len(r[0]) != len(r[1]) for r in rows)


def test_near_fingerprints_are_candidates(spark, monkeypatch):
    """Without prefixes, copies that differ in a word or less still meet by the covering tables."""
    base = [f"b{i}" for i in range(600)]
    rows = [(k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in (0, 599, 300)] + [(1000, " ".join(base)), (1001, "something else altogether here now")]
    monkeypatch.setattr(shingles, "prefix", lambda found, common: found[:0])
    marks = [simhash.fingerprint(t.encode(), 5) & (1 << 64) - 1 for _, t in rows]
    want = brute.Union([r[0] for r in rows])
    for (a, _), x in zip(rows, marks, strict=True):
        for (b, _), y in zip(rows, marks, strict=True):
            if (x ^ y).bit_count() <= 2:
                want.link(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select(df["text"].cast("binary").alias("text"))
    read = shingles._read(spark.sparkContext.broadcast(np.empty(0, dtype=np.int64)))
    nodes = df.withColumn("text", df["text"].cast("binary")).mapInArrow(read, "doc_id long, fp long, mark long, n long, first array<long>, odd array<long>")
    found = shingles._near(shingles._by_marks(nodes), nodes, texts)
    ids = {r["fp"]: r["doc_id"] for r in nodes.collect()}
    got = brute.Union([r[0] for r in rows])
    for r in found.collect():
        got.link(ids[r["a"]], ids[r["b"]])
    assert {k: got.root(k) for k, _ in rows} == {k: want.root(k) for k, _ in rows} and got.root(599) == got.root(1000)


def test_null_ids_and_blank_texts(spark, no_docs):
    rows = [(None, "a b c"), (7, "A  b c"), (3, None), (4, " \t"), (5, "")]
    got = sorted((tuple(r) for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (3, 3), (4, 3), (5, 3)], key=str)
    assert shingles.classes(no_docs).count() == 0 and shingles.keep_one(no_docs).count() == 0


def test_components_meet_nodes_not_their_places_in_buckets(spark, monkeypatch):
    """A node has a place in many buckets, and their number may grow faster than the table."""
    monkeypatch.setattr(shingles, "COMMON", 100)
    seen, place = [], shingles._place_members

    def spy(held, linked):
        out = place(held, linked)
        seen.append((held.count(), held.select("node").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(shingles, "_place_members", spy)
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join(passage + [f"q{k}x{i}" for i in range(30)])) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in shingles.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows)
    assert seen and all(held == nodes <= 40 for held, nodes, _ in seen) and seen[0][2] > 40


def test_common_shingles_are_found_at_a_rate_that_holds(spark):
    """Of 100,000 texts so many are sampled that a shingle in one of 400 counts as common."""
    df = spark.range(100_000).selectExpr("cast(concat(if(id % 400 = 0, 'a b c d e', 'x'), ' ', id, ' ', id, ' ', id, ' ', id) as binary) as text")
    assert shingles.shingles(b"a b c d e")[0] in shingles._common(df)
