import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import language

from corpus_data import SCHEMA, VOCABULARY, prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        lang = rng.choice(list(VOCABULARY))
        rows.append((i, prose(rng, lang, rng.randint(5, 200)), lang if i % 9 else None, "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "12 34 !!", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), {r[0]: next((v for v in [r[2]] if v), None) for r in rows}


def test_held_out_accuracy(labelled):
    docs, truth = labelled
    model = language.learn(docs.filter("doc_id % 2 = 0"))
    assert model[0] == sorted(VOCABULARY)
    got = language.predict(docs.filter("doc_id % 2 = 1"), model).collect()
    known = [r for r in got if truth[r.doc_id] and r.doc_id < 1000]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in known]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id == 1001} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    e = language.Encoder(64, 3)
    a, b, space = (e._vectors(np.array([ord(c)]))[0].astype(int) for c in "ab ")
    want = np.roll(space, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * space
    got, has = e.bundle(["A--b", "a1b", "Ab", None, "..."])
    assert np.array_equal(got[2], want) and list(has) == [True, True, True, False, False]
    assert np.array_equal(got[0], got[1])


def test_odd_rows_and_clashing_names(docs, empty, labelled):
    model = language.learn(labelled[0])
    clash = docs.withColumn("Score", F.lit(1)).withColumn("lang_pred", F.lit("?"))
    got = language.predict(clash, model)
    assert got.columns[: len(clash.columns)] == clash.columns and got.columns[-2:] == ["_lang_pred", "_score"]
    assert got.count() == docs.count()
    assert all((r._lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got.collect())
    assert language.predict(empty, model).count() == 0
    none = language.learn(empty)
    assert none[0] == [] and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.keep_known(docs, model, 0.0).columns == docs.columns


def test_empty_model_keeps_what_has_letters(docs):
    """No labels to learn from must not drop the corpus."""
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    want = sorted(str(r.doc_id) for r in bare.collect() if any(c.isalpha() for c in r.text or ""))
    for got in (language.keep_known(bare, language.learn(bare), 0.1), corpus_pipeline.language_stage(bare.sparkSession, bare, "")):
        assert got.columns == bare.columns and sorted(str(r.doc_id) for r in got.collect()) == want
        assert {r.lang for r in got.collect()} == {None} and len(want) > 100
