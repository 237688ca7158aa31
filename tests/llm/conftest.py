import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(id, text, lang, source, n_chars): copies, near copies, nulls, blanks, one very long text."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    base = " ".join(rng.choices(words, k=300)).split()
    for k in range(40):  # near copies
        changed = list(base)
        changed[(k * 7) % 300] = words[k]
        texts.append(" ".join(changed))
    texts += [" ".join(base)] * 30 + [None, "", " \t\n ", "One", "one", "ONE two", "é ü 日本 <|endoftext|> end"]
    texts.append(" ".join(rng.choices(words, k=30_000)))
    sources = ["a", "b", None, "a", "a"]
    return [(k, t, "en", sources[k % 5], len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
