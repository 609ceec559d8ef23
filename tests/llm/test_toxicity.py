import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusflow.llm import queries, toxicity
from locusflow.llm.words import Words

from corpus_data import SCHEMA, prose

INSULTS = ["moron", "worthless", "clownish", "scumbag"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        words = prose(rng, "en", rng.randint(20, 120)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, 1, None), (0, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute_kernel(s, t):
    def vector(x):
        out = {}
        for at in combinations(range(len(x)), 3):
            u = tuple(x[i] for i in at)
            out[u] = out.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = vector(s), vector(t)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def test_kernel_against_its_definition():
    marks = ["moron", "scum", "worthles", "banana"]
    k = toxicity.Kernel(marks)
    for word in ["moron", "mooron", "morn", "banana", "ananas", "worthles", "thworle"]:
        codes = toxicity.unspell(word)
        _, j, v = k.values(codes, 0.0)
        got = dict(zip(j.tolist(), v.tolist(), strict=True))
        for i, m in enumerate(marks):
            assert got.get(i, 0) == pytest.approx(brute_kernel(codes[0].tolist(), toxicity.unspell(m)[0].tolist()), abs=1e-5)
        high = {i for i, x in got.items() if x >= toxicity.FLOOR}
        assert set(k.values(codes)[1].tolist()) == high


def test_held_out_and_disguised_insults(spark, corpus):
    docs, labels = corpus
    model = toxicity.learn(docs.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 0"))
    got = toxicity.score(docs.filter("doc_id % 2 = 1 OR doc_id % 4 = 0"), model).join(labels.filter("toxic IS NOT NULL").distinct(), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    tests = ["what a m-o-r-o-n you are", "such a worrthless thing", "you m o r o n", "that mooron again", "the nation was there with this", "", None]
    found = {r.text: r for r in toxicity.score(spark.createDataFrame([(t,) for t in tests], "text string"), model).collect()}
    assert [found[t].predicted for t in tests] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in found.values())


def test_letters_and_marks():
    code = lambda t: [c for c in toxicity.letters_of(np.frombuffer(t.encode(), np.uint8)).tolist() if c]
    assert code("aZ") == [1, 26] and code("“‘—…1×÷。！️😀e\u0301") == [5]
    russian = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    assert len(set(code(russian))) == len(russian) and code(russian.upper()) == code(russian)
    for alphabet in ("αβγδεζηθικλμνξοπρσςτυφχψω", "אבגדהוזחטיךכלםמןנסעףפץצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"):
        assert len(set(code(alphabet))) >= len(alphabet) - 6
    assert code("ÀÉÑ") == code("àéñ") and max(code("一丁丂𐍈Ա")) < toxicity.BEGIN


@pytest.mark.parametrize("marked", ["“moron”", "‘moron’", "—moron", "moron…", "«moron»", "(moron)"])
def test_punctuation_is_no_letter(marked):
    kernel = toxicity.Kernel(["moron"])
    (_, codes, _), *_ = toxicity.tokens(Words(pa.array([marked])))
    assert kernel.values(codes)[2].tolist() == [1.0]


def test_sentences_end_at_stops_and_lines():
    w = Words(pa.array(["a b. c d\ne f", "g h"]))
    assert toxicity.sentences(w).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_odd_rows(docs, empty, corpus):
    model = toxicity.learn(*corpus)
    clash = docs.withColumn("SCORE", F.lit(2))
    got = toxicity.score(clash, model)
    assert got.columns == [*clash.columns, "_score", "predicted"] and got.count() == docs.count()
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.learn(empty, corpus[1])
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


STEMS = {"de": ("grülz", "moppfa"), "ru": ("дурбак", "глупож"), "ar": ("غبيضص", "حقيرظ"), "zh": ("蠢猪货", "贱骨头")}


@pytest.mark.parametrize("langs", [("de", "ru"), ("ar", "zh")])
def test_registered_query_finds_stems_of_two_scripts(spark, tmp_path, langs):
    """Toxic texts hold several words that begin with a stem of their language; one of them also comes by chance in clean ones. Clean words are spelled from
    the whole alphabet of the script, thousands of them. Held-out rows decide."""
    rng = random.Random(11)
    letters = {"ru": "абвгдежзийклмнопрстуфхцчшщыэюя", "ar": "ابتثجحخدذرزسشصضطعغفقكلمنهوي", "zh": [chr(0x4E00 + 7 * k) for k in range(1500)]}
    clean = {x: ["".join(rng.choice(y) for _ in range(rng.randint(1, 4) if x == "zh" else rng.randint(3, 10))) for _ in range(3000)] for x, y in letters.items()}
    endings = {"de": ["ung", "er", "lich", "e", "est"], "ru": ["ый", "ость", "ение", "ом", "их"], "ar": ["ون", "ات", "ة", "ين"], "zh": ["的", "人", "们", "了"]}
    docs, labels = [], []
    for i in range(1200):
        lang = langs[i % 2]
        n = rng.randint(40, 150)
        words = prose(rng, "de", n).split(" ") if lang == "de" else [rng.choice(clean[lang]) for _ in range(n)]
        toxic = i % 5 == 0
        for _ in range(rng.randint(4, 8) if toxic else int(rng.random() < 0.2)):
            words.insert(rng.randrange(len(words)), rng.choice(STEMS[lang]) + rng.choice(endings[lang]))
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, None, None, None, None), (5001, "", "de", "s", 0), (None, "ohne id", "de", "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (5001, 0, 0), (0, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    for k in range(2):  # each script
        held = [(got[i].predicted, toxic) for i, _, toxic in labels if got[i].held_out and i % 2 == k]
        caught = [p for p, toxic in held if toxic]
        false = [p for p, toxic in held if not toxic]
        assert sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.02 * len(false)


def test_equal_texts_with_different_labels(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = {r.text: r.label for r in toxicity.sample(docs, labels).collect()}
    assert got == {"same text": 1, "other": 0}
