import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusflow.llm import tokens
from locusflow.llm.words import slices

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.RANKS, "rb") as f:
        return tokens.Encoder(tokens.parse_ranks(f.read()))


def brute(token_ends, section_ends, rule):
    out = [0.0] * len(section_ends)
    owner = [next(i for i, e in enumerate(section_ends) if b < e) for b in range(section_ends[-1])]
    start = 0
    for end in token_ends:
        own = owner[start:end]
        if rule == "start":
            out[own[0]] += 1
        elif rule == "end":
            out[own[-1]] += 1
        elif rule == "most":
            out[max(sorted(set(own)), key=own.count)] += 1
        else:
            for i in set(own):
                out[i] += own.count(i) / len(own)
        start = end
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_against_bytes(rule):
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 40)
        cuts = lambda k: sorted({*rng.sample(range(1, n + 1), min(k, n)), n})
        t, s = cuts(rng.randint(1, 15)), cuts(rng.randint(0, 6))
        s = sorted([*s, *rng.sample(s, min(len(s), 1))]) if rng.random() < 0.3 else s  # an empty section
        assert tokens.attribute(np.array(t), np.array(s), rule) == pytest.approx(brute(t, s, rule))
    assert tokens.attribute(np.array([], int), np.array([0, 0]), rule).tolist() == [0, 0]


def test_offsets_are_those_of_the_tokens(encoder, texts):
    for t in texts:
        t = t or ""
        ids = encoder.encoding.encode_ordinary(t)
        assert encoder.ends(t).tolist() == np.cumsum([len(x) for x in encoder.encoding.decode_tokens_bytes(ids)]).astype(int).tolist()
        assert tokens.line_ends(t)[-1] == len(t.encode())


@pytest.mark.parametrize("rule", tokens.RULES)
def test_counts_add_up(docs, empty, encoder, rule):
    clash = docs.withColumn("FIELD", F.lit(1))
    got = tokens.token_counts(clash, rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end").alias("end")).collect()
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(encoder.encoding.encode_ordinary(r.text or ""))
    assert {r.doc_id: round(r.n, 6) for r in got} == want
    assert tokens.token_counts(empty).count() == 0


def test_offsets_are_characters(spark):
    text = "日本語\nnaïve 😀\n\nend"
    got = tokens.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    assert [text[r.start : r.end] for r in got] == ["日本語\n", "naïve 😀\n", "\n", "end"]


def test_lengths(docs, encoder):
    got = sorted((str(r.doc_id), r.n) for r in tokens.lengths(docs).collect())
    assert got == sorted((str(r.doc_id), len(encoder.encoding.encode_ordinary(r.text or ""))) for r in docs.collect())


def test_batches_are_bounded_by_all_fields():
    batch = pa.RecordBatch.from_pydict({"a": ["x"] * 8, "b": ["y" * 1000] * 8, "c": pa.array([None] * 8, pa.string())})
    assert [p.num_rows for p in slices([batch], "a", "b", "c", limit=2200)] == [2, 2, 2, 2]
    assert [p.num_rows for p in slices([batch], "a", limit=2200)] == [8]


def test_fields(spark):
    rows = [(1, "a title", "and the bo"), (2, None, "dy"), (3, "", None)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, title string, body string"), fields=("title", "body"), lines=False)
    assert [(r.doc_id, r.field, r.start, r.end) for r in got.orderBy("doc_id", "start", F.desc("field")).collect()] == [(1, "title", 0, 7), (1, "body", 7, 17), (2, "title", 0, 0), (2, "body", 0, 2), (3, "title", 0, 0), (3, "body", 0, 0)]
    assert tokens.totals(got).count() == 2


def test_a_large_file_is_no_vocabulary(spark, tmp_path, monkeypatch):
    path = tmp_path / "v"
    path.write_bytes(b"YQ== 0\n")
    assert tokens.ship(spark, str(path)).data.value == b"YQ== 0\n"
    monkeypatch.setattr(tokens, "MAX_VOCABULARY", 3)
    with pytest.raises(ValueError, match="no vocabulary"):
        tokens.ship(spark, str(path))
