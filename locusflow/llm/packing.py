"""Packing into optimal length buckets.

Documents longer than ``max_len`` units are cut into pieces of that length and a rest, so the
global histogram of piece lengths has ``max_len`` rows at most.  Dynamic
programming over it chooses the bucket boundaries with the least total padding
when every piece is padded to the boundary of its bucket.  Inside a bucket,
batches hold ``token_budget // boundary`` pieces each; all but the last of a
bucket are full.  Places are dealt without gathering a bucket: rows are written with a number of their own, pieces are numbered
within shards of these numbers (so no id makes a shard large), and shards get offsets from their counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

MAX_LEN, BUCKETS, TOKEN_BUDGET, SHARD_ROWS = 2048, 8, 65536, 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` upper boundaries that minimise the padding of a histogram (ascending distinct lengths).

    Layer by layer, by divide and conquer over the monotone best cut; exact.  Of equal
    costs the first cut wins.
    """
    n = len(lengths)
    if not n:
        return []
    number, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    top = np.concatenate([[0], lengths])
    cost = top * number - mass  # one bucket for the first j lengths
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = np.full(n + 1, np.iinfo(np.int64).max // 2, np.int64), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            value = cost[i] + top[j] * (number[j] - number[i]) - (mass[j] - mass[i])
            k = int(value.argmin())
            new[j], cut[j] = value[k], i[k]
            todo += [(a, j - 1, lo, int(i[k])), (j + 1, b, int(i[k]), hi)]
        cost = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j <= 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def word_count(text):
    """Words outside ASCII white space, as a column."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def pieces(docs: DataFrame, id_col: str, length, max_len: int = MAX_LEN) -> DataFrame:
    """``doc_id, row, piece, start, n_tokens``: documents cut at max_len; ``row`` numbers the rows, and is only fixed once written.  Lengths that are null or 0 or less give one piece of length 0."""
    own = docs.select(docs[id_col].alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("n"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)) - 1
    cut = own.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * max_len
    return cut.select("doc_id", "row", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_len)).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", length=None, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``doc_id, piece, start, n_tokens, bucket, bucket_len, batch, slot``: where each piece of each document goes.

    ``length`` is a column of lengths (of any tokenizer); without it, lengths are words of the text.
    Repeated rows are packed each for itself.  A piece of length 0 goes to the first bucket.
    An empty table gives no rows.  Batches are numbered from 0 within a bucket, and slots within a batch.
    """
    if max_len > token_budget:
        raise ValueError("token_budget must hold a piece of max_len")
    cut = checkpointed(pieces(docs, id_col, word_count(docs[text_col]) if length is None else length, max_len))  # so texts are read once
    histogram = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # max_len + 1 rows at most
    sizes = sorted((r["n_tokens"], r["n"]) for r in histogram)
    lengths, counts = np.array([s for s, _ in sizes], np.int64), np.array([n for _, n in sizes], np.int64)
    ends = boundaries(lengths, counts, buckets)
    shards = int(max(1, -(-int(counts.sum()) // SHARD_ROWS))) if len(counts) else 1
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    size = F.element_at(F.array(*[F.lit(e) for e in ends] or [F.lit(0)]), F.col("bucket") + 1).cast("long")
    placed = cut.withColumn("bucket", bucket).withColumn("bucket_len", size).withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    count = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SHARD_ROWS pieces
    count = count.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row", "piece")) - 1
    index = F.col("before") + F.col("nth")
    room = F.greatest(F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    return (
        placed.withColumn("nth", nth)
        .join(count, ["bucket", "shard"])
        .select("doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len", F.floor(index / room).cast("long").alias("batch"), (index % room).alias("slot"))
    )
