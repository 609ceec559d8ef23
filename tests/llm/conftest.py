import random

import pytest
from corpus_data import SCHEMA, VOCABULARY, prose


@pytest.fixture(scope="session")
def texts():
    """Texts with the odd ones among them: nulls, empty, blank, one word, very long, copies, shared passages, other scripts."""
    rng = random.Random(5)
    out = [None, "", "   \n\t", "word", "x " * 30_000, "A" * 50_000, "日本語 の テキスト " * 20, "no letters: 123 456 " * 3, " nbsp em\x85nel\x1cfs"]
    out += [prose(rng, rng.choice(list(VOCABULARY)), rng.randint(3, 400)) for _ in range(120)]
    passage = " ".join(prose(rng, "en", 60).split())
    out += [prose(rng, "en", rng.randint(0, 80)) + " " + passage + " " + prose(rng, "fr", rng.randint(0, 80)) for _ in range(12)]
    out += [out[20]] * 5 + [out[21] + " more"] * 2 + [out[22].upper()]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rng = random.Random(6)
    rows = [(i if i != 40 else None, t, rng.choice(["en", "de", None]), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], rows[0]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
