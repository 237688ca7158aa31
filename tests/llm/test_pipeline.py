import pytest
from pyspark.sql import functions as F
from test_shingles import near_classes

import corpus_pipeline
from tidemill.llm import mixing, packing, quality, toxicity
from tidemill.llm.tokenizer import public


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "packing"]


def test_each_stage_works_on_what_the_last_one_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, kept, sf_dir).cache()
        if k == 0:
            want = {r["doc_id"] for r in toxicity.classify(kept, labels).filter("predicted = 0").collect()}
            assert {r["doc_id"] for r in after.collect()} == want
        elif k == 1:
            want = {r["doc_id"] for r in quality.classify(kept, labels).filter("predicted = 1").collect()}
            assert {r["doc_id"] for r in after.collect()} == want
        elif k == 2:
            named = near_classes([(r["doc_id"], r["text"]) for r in kept.collect()])  # five words, 0.8 or more
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(named.values()))
        elif k == 3:
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).filter("copies > 0").collect()}
            assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
        else:
            want = packing.pieces(kept, public("byte_bpe_50k.json"))
            columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
            assert sorted(after.select(columns).collect()) == sorted(want.select(columns).collect())
        if k < 4:
            assert after.columns == docs.columns and 0 < after.count()
        kept = after


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(docs.collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_input(spark, sf_dir, k):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, none, sf_dir).count() == 0


#: Names that operators use for columns of their own.
CLASHES = ("fp", "h1", "h2", "component", "unit", "__0", "__1", "score", "predicted", "copies", "start", "length", "__salt")


@pytest.fixture(scope="module")
def odd(spark, corpus):
    """Nulls in every column, repeated rows, one id on several texts, ties, empty and very long texts, clashing names."""
    rows = [(k, t, lang, source, n) for k, t, lang, source, n in corpus[::3]] + [corpus[-1]]
    rows += [(None, None, None, None, None)] * 2 + [(None, "x y z", None, None, 3)] * 3 + [(5, "a b c d e f", "en", "a", 1), (5, "g h i j k l", "en", "b", 1), (9, "g h i j k l", "en", None, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.when(F.col("doc_id") % 2 == 0, F.lit(k).cast("string")))
    return df.cache()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_whole_rows_of_odd_tables(spark, sf_dir, odd, k):
    after = corpus_pipeline.STAGES[k][1](spark, odd, sf_dir)
    assert after.columns == odd.columns
    got, given = sorted(map(str, after.collect())), {str(r) for r in odd.collect()}
    assert got and set(got) <= given  # rows come out as they were
    assert sorted(map(str, corpus_pipeline.STAGES[k][1](spark, odd.repartition(5), sf_dir).collect())) == got


def test_near_duplicates_of_odd_tables(spark, sf_dir, odd):
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, odd, sf_dir).collect()]
    assert kept.count((5, "a b c d e f")) == 1 and [t for _, t in kept].count("g h i j k l") == 1
    assert [t for _, t in kept].count("x y z") == 1 and sum(not (t or "").strip() for _, t in kept) == 1


def test_packing_of_odd_tables(spark, sf_dir, odd):
    got = corpus_pipeline.pack_sequences(spark, odd, sf_dir).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert sum(r["piece"] == 0 for r in got) == odd.count()


def test_run_leaves_nothing_behind(spark, sf_dir, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(corpus_pipeline, "scratch", lambda spark, name: made.append(f"{tmp_path}/{name}") or made[-1])
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert made and not list(tmp_path.iterdir())
