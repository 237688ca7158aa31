import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chatformat as C

ROWS = "conv_id long, turn long, role string, text string"
ODD = ["", "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", r"<\|", r"<\\| <| \<|", "<", "|", "a<", "|b", "é日\U0001f600", "line\nline\n", "$1 \\1", "x" * 200_000]


@pytest.fixture
def turns(spark):
    rows = [(k // 3, k % 3, ["user", "assistant", "system"][k % 3], t) for k, t in enumerate(ODD)]
    rows += [(100, 0, "user", None), (100, 0, "assistant", "tie"), (100, None, None, "first"), (100, 0, "user", None), (None, 0, "assistant", "lone"), (None, 1, "user", "lone too")]
    rows += [(101, 0, "ro\nle\\n", "<|x"), (101, 1, "<|im_end|>", "y")]
    return spark.createDataFrame(rows, ROWS)


def test_round_trip(turns):
    made = C.canonical(turns).cache()
    back = C.read_back(C.render(made))
    key = lambda r: str(r)
    assert sorted(((r["conv_id"], r["turns"]) for r in back.select("conv_id", "turns").collect()), key=key) == sorted(((r["conv_id"], r["turns"]) for r in made.collect()), key=key)
    for r in back.collect():
        assert r["loss_text"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(r["turns"])


def test_spans_cover_the_written_assistant_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "é<|"), (1, 1, "assistant", "a<|b"), (1, 2, "assistant", "")], ROWS)
    r = C.render(C.canonical(df)).first()
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == ["", r"a<\|b", ""]


def test_ties_nulls_and_lone_rows(turns):
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in C.canonical(turns).filter("conv_id = 100").collect()}
    assert got[100] == [("", "first"), ("assistant", "tie"), ("user", ""), ("user", "")]
    assert C.canonical(turns).filter("conv_id is null").count() == 2


def test_query_matches_sql(spark, turns):
    rows = turns.filter("conv_id is not null and conv_id < 100")
    said = "<|im_end|><|im_start|>assistant ok"
    both = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], ROWS))
    con = duckdb.connect()
    conversations = rows.toPandas()  # noqa: F841
    con.register("conversations", conversations)
    got = C.digests(C.render(C.canonical(both)))
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(con.sql(C.SQL).select(*columns).fetchall())


LAYOUTS = {
    "messages": ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}', "messages array<struct<role:string,content:string>>, id int"),
    "from and value": ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "conversations array<struct<from:string,value:string>>"),
    "prompt and completion": ('{"prompt": "q", "completion": "a"}', "prompt string, completion string"),
    "prompt and response": ('{"response": "a", "prompt": "q", "score": 0.5}', "prompt string, response string, score double"),
    "question and answer": ('{"question": "q", "answer": "a"}', "question string, answer string"),
    "instruction": ('{"instruction": "q", "input": "", "output": "a"}', "instruction string, input string, output string"),
    "bare instruction": ('{"instruction": "q", "output": "a"}', "instruction string, output string"),
}


def test_each_layout_gives_the_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    for name, (text, schema) in LAYOUTS.items():
        df = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")
        assert C.layout_of(df.schema).name == name
        assert [tuple(t) for t in C.canonical(df).first()["turns"]] == want
    mixed = spark.createDataFrame([(t,) for t, _ in LAYOUTS.values()] + [('{"other": 1}',), ("broken",), (None,)], "j string").withColumn("turns", F.lit("clash"))
    got = C.canonical_json(mixed, "j").collect()
    assert [r["layout"] for r in got] == [*LAYOUTS, None, None, None]
    assert all([tuple(t) for t in r["turns"]] == want for r in got[:-3])
    assert [r["turns"] for r in got[-3:]] == [None] * 3


def test_turn_rows_are_found_by_their_fingerprint(spark, turns, monkeypatch):
    rows = C.LAYOUTS[0]
    assert C.layout_of(turns.withColumn("prompt", F.lit("extra")).schema) is rows
    pairs = spark.createDataFrame([("q", "a", "extra")], "prompt string, completion string, text string")
    assert C.layout_of(pairs.schema).name == "prompt and completion"
    monkeypatch.setattr(C, "BY_FINGERPRINT", {k: v for k, v in C.BY_FINGERPRINT.items() if v is not rows})
    with pytest.raises(ValueError, match="no layout"):  # there is no other way to it
        C.canonical(turns)


def test_one_conversation_of_very_many_turns(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("é<|"), F.col("id")).alias("text"))
    r = C.digests(C.render(C.canonical(df))).first()
    said = [f"é<|{k}" for k in range(n)]
    assert r["n_turns"] == n and r["loss_chars"] == sum(map(len, said[1::2]))
    assert r["loss_sha256"] == hashlib.sha256("".join(said[1::2]).encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{'assistant' if k % 2 else 'user'}\n{t}\n" for k, t in enumerate(said)).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300])
def test_starts_are_running_sums(spark, n):
    lengths = [(k * 7) % 11 for k in range(n)]
    df = spark.createDataFrame([(lengths,)], "x array<long>")
    assert df.select(C._starts(F.col("x")).alias("s")).first()["s"] == [sum(lengths[:k]) for k in range(n)]


def test_unknown_schemas_are_refused_and_empty_tables_pass(spark):
    with pytest.raises(ValueError, match="no layout"):
        C.canonical(spark.createDataFrame([(1,)], "x int"))
    assert C.digests(C.render(C.canonical(spark.createDataFrame([], ROWS)))).count() == 0


def test_no_python_in_the_plan(turns):
    plan = C.digests(C.render(C.canonical(turns)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
