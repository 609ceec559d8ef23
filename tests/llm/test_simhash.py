import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from locusflow.llm import simhash
from locusflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_classes(docs, texts):
    got = simhash.simhash_classes(docs).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    nodes = {f for _, f in fps}
    near = [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2]
    root = classes(nodes, near)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted((str(i), f"{f:016x}", str(least.get(root[f]))) for i, f in fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_find_all_pairs(spark, bits):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [b ^ (1 << rng.randrange(64)) for b in base[:50]] + [0, 1, 2**64 - 1, 2**63, 2**63 - 1, 3 << 62]
    fps = sorted(set(base + near))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert got == want and len(want) > 40


def test_one_document_of_each_group_stays(docs, empty):
    clash = docs.withColumn("fingerprint_key", F.lit(7)).withColumn("FP", F.lit("y"))
    got = simhash.drop_near_copies(clash)
    assert got.columns == clash.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    nodes = {brute_fingerprint(t) for _, t in rows}
    root = classes(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    kept = got.collect()
    assert len(kept) == len({root[brute_fingerprint(t)] for _, t in rows})
    least = {}
    for i, t in rows:
        if i is not None:
            g = root[brute_fingerprint(t)]
            least[g] = min(least.get(g, i), i)
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(least.values())
    assert simhash.drop_near_copies(empty).count() == 0
    assert simhash.simhash_classes(empty).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (201, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(want[k] == k for k in want.keys() - got.keys())  # only loops may be left out
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
