"""The registered query of each operator against a plain version of its contract."""

import math
import re
import zlib

import brute
import duckdb
import numpy as np
import pytest
from test_shingles import near_classes
from test_toxicity import plain_score
from test_urlfilter import plain as plain_url
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import packing, quality, queries, toxicity
from tidemill.llm.tokenizer import public


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    return lambda name, columns: con.sql(f"select {columns} from '{sf_dir}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents(tables):
    return dict(tables("documents", "doc_id, text"))


def encoded(name, texts, end):
    library = Tokenizer.from_file(public(name))
    library.encode_special_tokens = True
    return [e.ids + [end] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, sf_dir).collect()}
    assert got == brute.simhash_classes(list(documents.items()))


def test_op2(spark, sf_dir, tables):
    got = queries.op2_url_filters(spark, sf_dir).collect()
    want = {k: plain_url(u) for k, u in tables("pages", "page_id, url")}
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want and len(got) == len(want)


def test_op3(spark, sf_dir, documents):
    got = queries.op3_packing(spark, sf_dir).collect()
    ids = dict(zip(documents, encoded("byte_bpe_50k.json", documents.values(), 0), strict=True))
    want = {(k, i): (at, n, crc(x[at : at + n])) for k, x in ids.items() for i, (at, n) in enumerate(packing.cut(len(x)))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in bins.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [at for at, _ in sorted(some)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


def learned_from(labels, folds, held_out, column):
    known = {}
    for k, y in labels:
        if k is not None and y is not None and zlib.crc32(str(k).encode()) % folds != held_out:
            known[k] = min(y, known.get(k, 1))
    return known


def test_op4(spark, sf_dir, documents, tables):
    """Scores of a model fitted here, without Spark, from the rows the contract lets be learned from."""
    known = learned_from(tables("labels", "doc_id, quality"), 3, 1, "quality")
    order = sorted(k for k in known if k in documents)
    ridge = np.full(len(quality.FEATURES) + sum(quality.CELLS), quality.CELL_RIDGE)
    ridge[: len(quality.FEATURES)] = quality.RIDGE
    read = lambda t: quality.described(t.encode() if t is not None else None)
    model = quality.fit_pairs(quality.unpacked([read(documents[k]) for k in order]), np.array([known[k] for k in order]), ridge=ridge)
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, sf_dir).collect()}
    assert got.keys() == documents.keys()
    for k, text in documents.items():
        x = (quality.unpacked([read(text)])[0] - model["mean"]) / model["scale"]
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-np.clip(x @ np.array(model["w"]) - model["level"], -30, 30))), abs=1e-6)
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and got[k]["predicted"] == int(got[k]["score"] >= 0.5)


def test_op5(spark, sf_dir, documents, tables):
    """Scores by the learned lexicon, every clause of every text read for itself."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    lexicon = toxicity.Lexicon(*toxicity.fit(docs, labels))
    known = learned_from(tables("labels", "doc_id, toxic"), 4, 2, "toxic")
    toxic = " ".join(documents[k] or "" for k, y in known.items() if y and k in documents).lower()
    assert all(w in toxic for w in [*lexicon.words, *lexicon.stems])  # learned from toxic documents outside the fold
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf_dir).collect()}
    assert got.keys() == documents.keys()
    for k, text in documents.items():
        assert got[k]["score"] == pytest.approx(plain_score(lexicon, text), abs=1e-9)
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and got[k]["predicted"] == int(got[k]["score"] >= 0.3)


def test_op6(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    got, want = queries.op6_chat_format(spark, sf_dir), con.sql(queries.oracle_sql()["op6_chat_format"])
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(*columns).fetchall())


def test_op7(spark, sf_dir, tables):
    rows = {k: (len(re.findall(brute.BLANKS, t or "")), s) for k, t, s in tables("documents", "doc_id, text, source")}
    names = sorted({s for _, s in rows.values()}, key=lambda s: (s is None, s))
    size = {s: sum(n for n, own in rows.values() if own == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:  # deal what is left by weight; who gets over twice their size stops there, and all is dealt again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        for s in over or free:
            target[s] = 2 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    got = {r["doc_id"]: r for r in queries.op7_mixing(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    taken = dict.fromkeys(names, 0)
    for k, r in got.items():
        n, s = rows[k]
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["target"] == pytest.approx(target[s])
        rate = target[s] / size[s]
        assert n * math.floor(rate + 1e-9) <= r["taken"] <= n * math.ceil(rate - 1e-9) and (not n or r["taken"] % n == 0)
        taken[s] += r["taken"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.02) for s in names)
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, queries.op7_mixing(spark, sf_dir).collect()))


def test_op8(spark, sf_dir, documents):
    got = {}
    for r in sorted(queries.op8_bm25(spark, sf_dir).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    want = brute.bm25(list(documents.items()), [x for x in documents.items() if x[0] % 100 == 0], 10)
    assert got == {q: [(d, round(s, 6)) for d, s in hits] for q, hits in want.items() if hits}


def test_op9(spark, sf_dir, tables):
    got = {r["vec_id"]: r for r in queries.op9_embedding_dedup(spark, sf_dir).collect()}
    want = brute.cosine_links(tables("embeddings", "vec_id, embedding, label"))
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_op10(spark, sf_dir, documents):
    got, at, want = queries.op10_token_output(spark, sf_dir).collect(), 0, []
    order = sorted(documents)
    for k, ids in zip(order, encoded("word_bpe_49k.json", [documents[k] for k in order], 2), strict=True):
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_the_pipeline_against_plain_versions(spark, sf_dir, documents):
    """Each stage on what the one before kept: what goes, what stays, what is packed."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = toxicity.Lexicon(*toxicity.fit(docs, labels))
    kept = [k for k, t in documents.items() if plain_score(lexicon, t) < toxicity.LEVEL]
    mild = docs.filter(docs["doc_id"].isin(kept))
    good = sorted(r["doc_id"] for r in quality.classify(mild, labels).filter("predicted = 1").collect())
    named = near_classes([(k, documents[k]) for k in good])
    alone = sorted(set(named.values()))
    mixed = {r["doc_id"]: r["count"] for r in corpus_pipeline.mix_sources(spark, docs.filter(docs["doc_id"].isin(alone)), sf_dir).groupBy("doc_id").count().collect()}
    assert set(mixed) <= set(alone) and all(0 < n <= 2 for n in mixed.values())
    ids = dict(zip(mixed, encoded("byte_bpe_50k.json", [documents[k] for k in mixed], 0), strict=True))
    want = sorted((k, i, at, n, crc(ids[k][at : at + n])) for k, times in mixed.items() for _ in range(times) for i, (at, n) in enumerate(packing.cut(len(ids[k]))))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
