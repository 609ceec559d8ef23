import os
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import packing, quality, simhash, tokens

from test_minhash import brute_set, similar
from test_quality import brute as measured
from test_queries import profile
from test_substring import brute as windows


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "substring_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_works_on_what_is_left(spark, docs, tmp_path):
    now, before = docs, docs.count()
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "unused").write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        if i < 4:
            assert new.columns == docs.columns and [f.dataType for f in new.schema] == [f.dataType for f in docs.schema]
            assert 0 < new.count() <= before
            seen.append(new.count())
        else:
            want = {(r.doc_id, r.n) for r in tokens.lengths(now).collect()}
            got = new.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
            assert {(r.doc_id, r.n) for r in got} == want
        now, before = new, new.count()
    assert seen[0] < docs.count() and seen[2] < seen[1]  # junk and copies went
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/quality_rules").collect()}
    assert kept == {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}


def test_clean_documents_stay(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, corpus_pipeline.quality_stage(spark, docs, ""), "").collect()}
    clean = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    assert len(clean - kept) <= 0.02 * len(clean)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_tables(spark, empty, stage):
    assert stage(spark, empty, "").count() == 0


def test_run_against_brute_force(spark, docs, tmp_path):
    """All five stages, one document at a time: rules from their definitions, cosines of single trigrams, all pairs of shingle sets, all windows, all tokens."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect() if kept_by_rules(r.text)]
    total = {}
    for _, text, lang in rows:
        if lang and (v := profile(text)) is not None:
            total[lang] = total.get(lang, 0) + v
    known = []
    for doc, text, _ in rows:
        v = profile(text)
        if v is not None and max(float(t @ v / np.linalg.norm(t)) for t in total.values()) >= corpus_pipeline.MIN_COSINE:
            known.append((doc, text))
    assert len(known) > 50
    sets = [brute_set(t) for _, t in known]
    root = list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    groups = {}
    for i, (doc, text) in enumerate(known):
        groups.setdefault(root[i], []).append((doc is None, doc or 0, doc, text))
    # of rows of one id any may stay, but these have one text here
    left = [min(g, key=lambda r: r[:2])[2:] for g in groups.values()]
    assert len(left) < len(known)
    with open(tokens.RANKS, "rb") as f:
        encoding = tokens.Encoder(tokens.parse_ranks(f.read())).encoding
    want = Counter()
    for (doc, text), (words, _, gone) in zip(left, windows([t for _, t in left], 35), strict=True):
        n = len(encoding.encode_ordinary(" ".join(words) if gone else text))
        want.update((doc, i, packing.MAX_LEN * i, min(n - packing.MAX_LEN * i, packing.MAX_LEN)) for i in range(max(-(-n // packing.MAX_LEN), 1)))
    assert got == want


def kept_by_rules(text):
    """The current policy, rule by rule."""
    text = text or ""
    n, chars, symbols, dup_lines, repeated = measured(text)
    lines = len([x for x in text.split("\n") if x.strip(" \t\v\f\r")])
    upper, lower = (sum(a <= c <= b for c in text) for a, b in ("AZ", "az"))
    ascii_ = 2 * sum(ord(c) > 127 for c in text) < chars
    failed = n < 10 or 100 * repeated > 20 * n or 10 * symbols > n or 2 * dup_lines > lines
    return not failed and not (ascii_ and (chars > 15 * n or chars < 2 * n or upper > lower))


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {"doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len", "batch", "slot"}
    assert got.agg(F.max("n_tokens")).first()[0] <= packing.MAX_LEN
    kept = {f.rsplit("/", 2)[-2] for f in got.inputFiles()}
    assert kept == {"packing"} and len(os.listdir(os.path.dirname(os.path.dirname(got.inputFiles()[0].removeprefix("file://"))))) == 1


def test_near_dedup_links_by_simhash_too(spark, docs):
    """Texts of one fingerprint go though their sets of five words differ, and groups run through links of either kind."""
    cycle, tail = "one two three four five " * 60, lambda c: " ".join(f"{c}{i}" for i in range(6))
    long = [f"w{i}" for i in range(60)]
    texts = {1: cycle + tail("x"), 2: cycle + tail("y"), 3: " ".join(long), 4: " ".join([*long, "more"]), 5: tail("z") * 3}
    assert not similar(brute_set(texts[1]), brute_set(texts[2])) and simhash.fingerprint(texts[1]) == simhash.fingerprint(texts[2])
    near = docs.limit(1).drop("doc_id", "text").crossJoin(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select(docs.columns)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, near, "").collect()) == [1, 3, 5]
