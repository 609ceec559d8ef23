import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusflow.llm import substring
from locusflow.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append(([x for i, x in enumerate(w) if i not in gone], len(w), len(gone)))
    return out


@pytest.mark.parametrize("k,size", [(35, 1_000_000), (35, 200), (12, 500), (5, 300)])
def test_digests_against_brute_force(docs, k, size):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(i), n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (i, _), (kept, n, gone) in zip(rows, brute([t for _, t in rows], k), strict=True))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeat_digest(docs, k=k, group_size=size).collect())
    assert got == want


@pytest.mark.parametrize("k,size", [(12, 1_000_000), (5, 300)])
def test_maximal_repeats(docs, k, size):
    """Runs of windows that occur twice, of any document."""
    rows = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + k]) for _, w in rows for i in range(len(w) - k + 1))
    want = []
    for i, w in rows:
        at = [j for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1]
        first = [j for j in at if j - 1 not in at]
        last = [j for j in at if j + 1 not in at]
        want += [(str(i), a, b - a + k) for a, b in zip(first, last, strict=True)]
    got = [(str(r.doc_id), r.start, r.length) for r in substring.repeats(docs, k=k, group_size=size).collect()]
    assert sorted(got) == sorted(want) and len(got) > 10


def test_suffixes_are_sorted_by_their_words():
    rng = np.random.default_rng(4)
    vocabulary = ["a", "b", "ab", "ba", "a\x1cb", "é", "日本"]
    words = Words(pa.array([" ".join(rng.choice(vocabulary[: rng.integers(1, 8)], 60)) for _ in range(20)] + [None, "a"]))
    ids = substring.numbers(words)
    text = [words.buf[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    assert all((ids[i] == ids[j]) == (text[i] == text[j]) for i in range(0, len(text), 7) for j in range(len(text)))
    for k in (2, 7, 35):
        starts = np.flatnonzero(words.whole(k))
        order, common = substring.suffixes(ids[starts[:, None] + np.arange(k)])
        rows = [tuple(ids[s : s + k].tolist()) for s in starts[order]]
        assert rows == sorted(rows)
        assert common.tolist() == [next((i for i in range(k) if a[i] != b[i]), k) for a, b in zip(rows[:-1], rows[1:], strict=True)]
        for depth in range(k + 1):  # the nodes of each depth, with their leaves
            node, found = substring.intervals(order, common, depth), {}
            for s, x in zip(starts.tolist(), node.tolist(), strict=True):
                found.setdefault(x, set()).add(tuple(ids[s : s + depth].tolist()))
            assert all(len(prefixes) == 1 for prefixes in found.values()) and len(found) == len({tuple(ids[s : s + depth].tolist()) for s in starts})


@pytest.mark.parametrize("k", [2, 5, 9])
def test_leaves_of_both_trees_are_the_repeated_windows(k):
    """Pieces of a small vocabulary around a common prefix, with few or many words on either side."""
    rng = np.random.default_rng(k)
    text, size, anchor = [], [], []
    for _ in range(300):
        a = int(rng.integers(0, k - 1))
        n = int(rng.integers(1, a + 2))  # every window holds the prefix of two words
        left, right = rng.integers(0, 2, a), rng.integers(0, 2, max(0, n + k - 1 - a - 2))
        text.append([*left.tolist(), 7, 8, *right.tolist()][: n + k - 1])
        size.append(n + k - 1)
        anchor.append(a)
    ids, size = np.array([x for t in text for x in t]), np.array(size)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    # a window counts by its words and by where they hold the prefix
    windows = [(tuple(t[i : i + k]), a - i) for t, a in zip(text, anchor, strict=True) for i in range(len(t) - k + 1)]
    seen = Counter(windows)
    assert substring.leaves(ids, first, size, np.array(anchor), k).tolist() == [seen[w] > 1 for w in windows]


def test_heavy_slots_are_split():
    counts = np.array([5, 5, 100, 1, 40])
    plan = substring.plan_groups(counts, 10)
    assert plan[2, 1] == 10 and plan[4, 1] == 4
    assert (plan[[0, 1, 3], 1] == 1).all()
    ends = plan[:, 0] + plan[:, 1]
    assert ends.max() <= counts.sum() // 10 + 3


def test_texts_are_rewritten_only_where_words_go(docs, empty):
    clash = docs.withColumn("N_REMOVED", F.lit(3)).withColumn("chunk", F.lit("z"))
    got = substring.remove_repeats(clash, k=12)
    assert got.columns == clash.columns and got.schema["text"].dataType == docs.schema["text"].dataType
    rows = clash.collect()
    want = sorted((str(r.doc_id), str(r.text if not gone else " ".join(kept)), r.chunk, r.N_REMOVED) for r, (kept, _, gone) in zip(rows, brute([r.text for r in rows], 12), strict=True))
    assert sorted((str(r.doc_id), str(r.text), r.chunk, r.N_REMOVED) for r in got.collect()) == want
    assert substring.remove_repeats(empty).count() == 0 and substring.repeat_digest(empty).count() == 0
    assert substring.remove_repeats(docs, stats=True).columns[-2:] == ["n_words", "n_removed"]
