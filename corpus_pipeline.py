"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept and applies one operator to all of
it.  The tool that runs a stage writes its result as Parquet and hands the next
one what it reads back; ``run`` does the same below the shared folder, deletes
a stage's files once the next one is written, and the last ones once they are
read into a checkpoint.  (Spark itself deletes checkpoints if
``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.)

Defined cases, of every stage: null, empty and very long texts, null ids,
sources and other columns, and ids that stand on several rows are taken like
others; an empty table gives an empty one; columns may have any names beside
those of ``documents``, and the first four stages return whole rows with all
columns as they came.  Which rows stay doesn't depend on their order or on
partitions.  What else a stage defines stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import mixing, packing, quality, shingles, simhash, toxicity
from tidemill.llm.common import checkpoint, remove, scratch, table
from tidemill.llm.tokenizer import public


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go.

    Null and empty texts weigh nothing and stay; repeated rows go or stay together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(model, docs["text"]) < toxicity.LEVEL)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts below its level go.

    Null and empty texts have all features 0 and are judged like others; a tie
    with the level stays; repeated rows go or stay together; without labels of
    both kinds all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(model, docs["text"]) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles of a similarity of 0.8 or more stays.

    Candidates come from SimHash's covering tables, and beyond its radius from
    prefixes.  The row of a class's smallest id stays, null ids last, and of
    rows that share it the one of the smallest hash; texts without words are
    one class.
    """
    return simhash.keep_one(docs, placed=shingles.placed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one source, last in order; rows repeated in id, source and
    text are one unit whose copies are taken together, with the columns of one
    of them where others differ.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with the sequence and offset of each.

    A plan: token ids stay out of the shuffle, and ``packing.pack(...,
    with_ids=True)`` returns them beside it.  Repeated rows each get a place;
    a null text is one end id.
    """
    return packing.pack(docs, public("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, fingerprints, sampling and token ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, before = table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{path}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    docs = checkpoint(docs)
    remove(spark, path)
    return docs
