import struct
import zlib

import numpy as np
import pytest

from tidemill.llm import tokenout
from tidemill.llm.tokenizer import Encoder, public

WORDS = public("word_bpe_49k.json")


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("ids", [[], [2], [0, 65535, 10, 10]])
def test_frame_round_trip(width, ids):
    a = tokenout.frame(7, np.array(ids, "<u4"), width) + b"\n"
    data = a + tokenout.frame(None, np.array(ids, "<u4"), width) + b"\n"
    assert (k := tokenout.read_frame(data))[0] == 7 and k[1].tolist() == ids and k[2] == len(a)
    assert (k := tokenout.read_frame(data, len(a)))[0] is None and k[1].tolist() == ids and k[2] == len(data)


@pytest.mark.parametrize("at", [0, 9, 15, 23])
def test_damage_is_found(at):
    data = bytearray(tokenout.frame(7, np.array([1, 2, 3], "<u4"), 2) + b"\n")
    data[at] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokenout.read_frame(data)


def test_checksums_are_masked():
    c = zlib.crc32(b"x")
    assert tokenout.masked(b"x") == ((c >> 15 | (c << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def test_written_files_read_back(spark, docs, corpus, tmp_path):
    path = f"file://{tmp_path}/out"
    tokenout.write(docs, path, WORDS, end_id=2, shards=3)
    enc, start, want = Encoder(WORDS), 0, []
    for k, text, *_ in sorted(corpus):
        ids = enc.encode([text or ""])[0] + struct.pack("<I", 2)
        want.append((k, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = tokenout.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want

    # any record by its index row alone
    for row in spark.read.parquet(f"{path}/index").collect()[::17]:
        with open(f"{tmp_path}/out/data/{row['shard']}", "rb") as f:
            f.seek(row["byte_offset"])
            doc_id, ids, _ = tokenout.read_frame(f.read(row["byte_length"]))
        assert doc_id == row["doc_id"] and len(ids) == row["n_tokens"]


def test_null_and_repeated_ids_and_empty_table(spark, no_docs, tmp_path):
    df = spark.createDataFrame([(5, "a"), (None, "b c"), (5, "a"), (-1, None)], "doc_id long, text string")
    tokenout.write(df, f"{tmp_path}/a", WORDS, end_id=2)
    got = sorted((tuple(r)[:3] for r in tokenout.read(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    assert got == [(None, 0, 3), (-1, 3, 1), (5, 4, 2), (5, 6, 2)]
    tokenout.write(no_docs, f"{tmp_path}/b", WORDS)
    assert tokenout.read(spark, f"{tmp_path}/b").count() == 0


def test_one_id_on_all_rows_is_dealt_over_shards(spark, tmp_path):
    df = spark.createDataFrame([(7, f"text number {k}", k, "x") for k in range(400)], "doc_id long, text string, start int, record string").repartition(4)
    tokenout.write(df, f"{tmp_path}/c", WORDS, end_id=2, shards=4)
    index = spark.read.parquet(f"{tmp_path}/c/index")
    assert index.select("shard").distinct().count() == 4 and index.count() == 400
    got = sorted(tuple(r) for r in tokenout.read(spark, f"{tmp_path}/c").select("start", "n_tokens").collect())
    at = 0
    for start, n in got:
        assert start == at
        at += n


def test_a_very_long_text(spark, tmp_path):
    tokenout.write(spark.createDataFrame([(1, "word " * 200_000)], "doc_id long, text string"), f"{tmp_path}/d", WORDS)
    assert tokenout.read(spark, f"{tmp_path}/d").first()["n_tokens"] == 200_000
