import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from corpus_data import SCHEMA, prose

from locusflow.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(rows):
    """The least id of each group, by all pairs."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i, (doc, _) in enumerate(rows):
        out.setdefault(find(i), []).append(doc)
    return [min((d for d in g if d is not None), default=None) for g in out.values()]


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def near(rng):
    """Texts with edits on both sides of the threshold: each edit of a text of 204 words changes five of its 200 shingles, so 4 leave 0.82 and 5 leave 0.78."""
    base = [" ".join(prose(rng, lang, 204).split()[:204]) for lang in ("en", "de", "fr") for _ in range(15)]
    return [x for t in base for x in (t, edited(rng, t, 1), edited(rng, t, 4), edited(rng, t, 5), edited(rng, t, 30))]


def test_sets_and_nodes(texts):
    got = minhash.shingle_sets(pa.array(["cut off", *texts]).slice(1))
    want = [brute_set(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i, a in enumerate(want):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(a & want[j])
            assert (minhash.node(got[i]) == minhash.node(got[j])) == (a == want[j])


def test_pipeline_stage_drops_near_copies(spark):
    """Three-word fingerprints within two bits leave nearly all of these apart."""
    rows = list(enumerate(near(random.Random(8))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert got == sorted(groups(rows)) and len(got) < 0.7 * len(rows)


def test_one_document_of_each_group_stays(docs, empty):
    got = minhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    want = groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, want))
    assert minhash.drop_near_copies(empty).count() == 0


def test_members_that_the_least_one_does_not_link(spark):
    """A chain of small edits: the ends are far apart, whichever member a bucket's first comparisons take."""
    rng = random.Random(9)
    chain = [" ".join(prose(rng, "en", 204).split()[:204])]
    for i in range(25):
        words = chain[-1].split()
        words[8 * i] = f"step{i}"
        chain.append(" ".join(words))
    rows = list(enumerate(chain))
    got = minhash.drop_near_copies(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)).collect()
    assert [r.doc_id for r in got] == groups(rows) == [0]


def test_a_large_group_meets_in_blocks(spark):
    """Copies with random edits, of which a bucket's centres link only some; blocks of a few sets."""
    rng = random.Random(10)
    base = " ".join(prose(rng, "de", 150).split()[:150])
    texts = [edited(rng, base, rng.randint(1, 8)) for _ in range(120)] + [base.upper(), base]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(r.doc_id for r in minhash.drop_near_copies(docs, block=(16, 3000)).collect())
    assert got == sorted(groups(rows)) and 1 < len(got) < 100
    assert got == sorted(r.doc_id for r in minhash.drop_near_copies(docs).collect())


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (1, 5, 300, 6000, 8000)]
    got = minhash._intersections(sets, sets[::-1])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
