import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from locusflow.llm import packing, queries, tokens


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        lengths = np.array(sorted(rng.sample(range(0, 40), n)))
        counts = np.array([rng.randint(1, 9) for _ in range(n)])
        for buckets in (1, 2, 3, 4):
            ends = packing.boundaries(lengths, counts, buckets)
            cost = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))
            best = min(cost([*cut, lengths[-1]]) for k in range(min(buckets, n)) for cut in itertools.combinations(lengths[:-1].tolist(), k))
            assert ends == sorted(set(ends)) and len(ends) <= buckets and cost(ends) == best
    assert packing.boundaries(np.array([], int), np.array([], int), 3) == []


def test_every_piece_has_one_place(docs, empty):
    got = packing.pack(docs, max_len=64, buckets=4, token_budget=256).collect()
    want = {}
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        want.setdefault(str(r.doc_id), []).append(n)
    total = {}
    for r in got:
        total[str(r.doc_id)] = total.get(str(r.doc_id), 0) + r.n_tokens
        assert r.n_tokens <= r.bucket_len <= 64 and r.start == 64 * r.piece
    assert total == {k: sum(v) for k, v in want.items()}
    places = [(r.bucket, r.batch, r.slot) for r in got]
    assert len(set(places)) == len(places)
    for bucket in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == bucket]
        room = max(256 // max(own[0].bucket_len, 1), 1)
        assert len({r.bucket_len for r in own}) == 1
        assert {r.batch for r in own} == set(range(-(-len(own) // room)))
        assert sorted((r.batch, r.slot) for r in own) == [(i // room, i % room) for i in range(len(own))]
    assert packing.pack(empty).count() == 0


def test_one_id_is_many_shards(spark, monkeypatch):
    """Rows without an id, or of one id, don't fall into one shard."""
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    rows = spark.createDataFrame([(None, "a b c")] * 500 + [(7, "a b c")] * 500, "doc_id long, text string").repartition(4)
    cut = packing.pieces(rows, "doc_id", F.lit(3)).select(F.pmod(F.xxhash64("row", "piece"), F.lit(20)).alias("s")).groupBy("s").count()
    assert cut.agg(F.max("count")).first()[0] < 100
    assert sorted((r.batch, r.slot) for r in packing.pack(rows).collect()) == [(0, i) for i in range(1000)]


def test_registered_query_against_brute_force(spark, docs, tmp_path):
    """Token lengths, cut, bucketed with the least padding, every place taken once."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_length_packing(spark, str(tmp_path)).collect()
    with open(tokens.RANKS, "rb") as f:
        encoding = tokens.Encoder(tokens.parse_ranks(f.read())).encoding
    want = Counter()
    for r in docs.collect():
        n = len(encoding.encode_ordinary(r.text or ""))
        want.update((r.doc_id, i, packing.MAX_LEN * i, min(n - packing.MAX_LEN * i, packing.MAX_LEN)) for i in range(max(-(-n // packing.MAX_LEN), 1)))
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == want
    sizes = Counter(r.n_tokens for r in got)
    ends = packing.boundaries(np.array(sorted(sizes)), np.array([sizes[k] for k in sorted(sizes)]), packing.BUCKETS)
    assert all(r.bucket_len == min(e for e in ends if e >= r.n_tokens) == ends[r.bucket] for r in got)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    assert all(r.slot < packing.TOKEN_BUDGET // max(r.bucket_len, 1) for r in got)


def test_shards_are_numbered_through(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    got = packing.pack(docs.withColumn("Batch", F.lit(1)), length=F.lit(5)).collect()
    assert sorted((r.batch, r.slot) for r in got) == [(0, i) for i in range(len(got))]
