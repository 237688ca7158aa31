import math
import random
import re

import numpy as np
import pytest

from tidemill.llm import toxicity as X
from tidemill.llm.common import fold

LEXICON = X.Lexicon({"fool": 3.0}, {"grobi": 3.0})


def weight(text):
    return sum(LEXICON.clause_weight(c) for c in LEXICON.clauses(text.lower()))


def test_insults_by_word_and_by_stem():
    assert weight("such a fool") == 3.0
    assert weight("foolish tomfool") == 0.0
    assert weight("grobian grobi. Grobi!") == 9.0
    assert weight("angrobi") == 0.0


def test_target_raises_negation_and_report_lower():
    plain = weight("such a fool")
    assert weight("you are a fool") == 1.5 * plain
    assert weight("not a fool") == pytest.approx(0.35 * plain)
    assert weight("the paper called the man a fool") == 0.5 * plain
    assert weight("not so. A fool") == plain  # a clause's negation ends with it
    assert weight("not here in this town a fool") == plain  # and reaches three words


def test_threat_wants_a_target():
    assert weight("we kill time") == 0.0
    assert weight("i will kill you") == 4.0
    assert weight("he said i will kill you") == 2.0
    assert weight("kill all of the weeds you see") == 0.0


def test_inflected_threats():
    for said in ("he kills you", "killing you", "they shot him", "er tötet dich", "ils tuent vous", "te mataré te", "strangling her"):
        assert weight(said) == 4.0, said
    assert weight("tutor you") == weight("killer whale you") == 0.0


def test_clauses_are_read_whole():
    """Reported speech holds to the end of a clause, however far, and nothing is cut in the middle of a word."""
    for n in (10, 100, 20_000):
        assert weight("she said " + "word " * n + "such a fool") == 1.5
        assert weight("such a fool " + "word " * n + "kill you") == 7.0
    assert weight("kill " * 400 + "grobian " * 3 + "x" * 900) == 9.0


def plain_score(lexicon, text):
    """Every clause of the text, each machine run for itself."""
    total = 0.0
    for clause in re.split(r"[.!?;:|\n]", (text or "").lower()):
        states = [0] * 5
        for word in re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause):
            insult = max([lexicon.words.get(word, 0.0), *(w for s, w in lexicon.stems.items() if word.startswith(s))])
            cls = X.INSULT if insult else next((c for c, some in ((X.THREAT, X.THREATS), (X.TARGET, X.TARGETS), (X.NEGATION, X.NEGATIONS), (X.REPORT, X.REPORTS)) if word in some), X.WORD)
            steps = [m(s, cls) for m, s in zip((X._insult, X._threat, X._target, X._negation, X._report), states, strict=True)]
            states = [s[0] for s in steps]
            lowered = steps[2][1] * steps[3][1] * steps[4][1]
            total += insult * steps[0][1] * steps[1][1] * lowered + steps[1][2] * lowered
    return 1 - math.exp(-total / X.FULL)


def test_scores_against_a_plain_reading_of_all_clauses():
    rng = random.Random(7)
    pool = ["fool", "Fool's", "grobian", "grobi", "tomfool", "foolish", *sorted(X.THREATS)[:6], *sorted(X.TARGETS)[:6], *sorted(X.NEGATIONS)[:4], *sorted(X.REPORTS)[:4], *("w%d" % i for i in range(40)), "İx", "don't", "a_fool"]
    scored = 0
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", " ", " ", ", ", ". ", "!", "\n", ";x", "|", "-"]) for _ in range(rng.randint(0, 60)))
        got = LEXICON.score(text)
        assert got == pytest.approx(plain_score(LEXICON, text), abs=1e-12), text
        scored += got > 0
    assert scored > 200


def test_rows_that_repeat_an_id_and_null_ids(spark, words):
    rows, labels = corpus(words, 200)
    schema = "doc_id long, text string"
    marked = spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int")
    more = rows + [(k, t + " zzfool") for k, t in rows[::4]] + [(None, "zzfool " * 30)] * 3
    a = X.fit(spark.createDataFrame(more, schema).repartition(3), marked)
    assert a == X.fit(spark.createDataFrame(more[::-1], schema), marked)
    got = X.classify(spark.createDataFrame(more, schema), marked).withColumn("held", fold("doc_id", 4) == 2).collect()
    assert len(got) == len(more) and all(r["held"] is False for r in got if r["doc_id"] is None)


def test_insults_of_two_letters_are_learned(spark, words):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(words, k=20) + (["zq"] * 2 if k % 5 == 0 else []))) for k in range(300)]
    labels = [(k, int(k % 5 == 0)) for k in range(300)]
    found_words, _ = X.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zq" in found_words


def test_composition_is_the_product_of_the_machines():
    for (state, cls), (after, factor, _) in X.GRAMMAR.items():
        steps = [m(s, cls) for m, s in zip((X._insult, X._threat, X._target, X._negation, X._report), state, strict=True)]
        assert after == tuple(s for s, _, _ in steps)
        assert factor == pytest.approx(np.prod([f for _, f, _ in steps]))


def test_a_hit_deep_in_a_long_text_counts():
    assert LEXICON.score("word " * 50_000 + "you fool") == LEXICON.score("you fool") > 0
    assert LEXICON.score(None) == LEXICON.score("") == 0.0


def corpus(words, n=600):
    """Insults are words and stems no clean text has; one toxic text has many near copies."""
    rng = random.Random(4)
    insults, stems = ["zzfool", "zztrash", "zzclown"], ["qqab", "qqcde"]
    rows, labels, copied = [], [], None
    for k in range(n):
        text = rng.choices(words, k=rng.randint(10, 150))
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(rng.randint(2, 5)):
                bad = rng.choice(insults) if k % 2 else rng.choice(stems) + rng.choice(words)
                text.insert(rng.randrange(len(text)), bad)
            if copied is None:
                copied = [*text, *(f"rare{j}" for j in range(20))]
            elif rng.random() < 0.4:
                text = [*copied[:5], f"own{k}", *copied[6:]]
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_copies(spark, words):
    rows, labels = corpus(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    found_words, found_stems = X.fit(df, marked)
    assert set(found_words) == {"zzfool", "zztrash", "zzclown"}
    assert all(s.startswith("qq") for s in found_stems)
    got = X.classify(df, marked).withColumn("held", fold("doc_id", 4) == 2).collect()
    held = [r for r in got if r["held"]]
    assert np.mean([r["predicted"] == dict(labels)[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "i will kill you", "c"), (2, "", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.classify(df, none)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in got.collect()) == [(0, 1), (1, 0), (2, 0), (2, 0)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert X.classify(df, labels).count() == 4
    assert X.classify(df.limit(0), labels).count() == 0
