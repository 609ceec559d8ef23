"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits, and maps to the 16
counts of set bits.  The Manhattan distance of two such points never exceeds
the Hamming distance of the fingerprints, so all links of r bits or fewer
lie within r steps on the grid of counts.  A point is packed into one
integer of 4 bits a count, where a step is the addition of +-16**i.  Two points within r
steps have a cell between them that each reaches in half of the steps, so the range
join is an equi-join of the cells that both sides reach: 33 for each point at r = 2, and the same table on either side.
What it finds is verified by the Hamming distance itself.

Only distinct fingerprints take part, so a group of copies counts once; a fingerprint that many rows have is dealt to
several tasks where rows look up their class.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, extended, spare
from .components import components
from .words import slices

SEGMENTS, WIDTH = 16, 4
BITS, SHINGLE, SEED = 2, 3, 42
#: Which share of all rows makes a fingerprint hot (one in so many), and over how many tasks its rows are dealt.
HOT = 64
#: Distinct fingerprints for each partition of the range join, where each has 33 cells (at two bits).
FINGERPRINTS = 10_000
#: Shingles whose bits are summed at once.
_STEP = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text: bit set where more than half of its shingles have it; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, end = (end - length)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start, end, strict=True)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _STEP):
        ones += np.unpackbits(h[i : i + _STEP].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches, text: str, keep: list[str], shingle: int, seed: int):
    for part in slices(batches, text):
        fps = np.array([fingerprint(t, shingle, seed) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fps)], names=[*keep, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each row; no shuffle."""
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return two.mapInArrow(partial(_fingerprints, text="text", keep=["doc_id"], shingle=shingle, seed=seed), f"doc_id {dict(two.dtypes)['doc_id']}, fp long")


def cell(fp: Column) -> Column:
    """The packed point: 16 counts of 4 bits."""
    out = None
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))).cast("long")
        term = F.shiftleft(count, 4 * i)
        out = term if out is None else out.bitwiseOR(term)
    return out


def steps(n: int) -> list[int]:
    """All differences of packed points within ``n`` steps, without zero."""
    found = set()
    for size in range(1, n + 1):
        for dims in combinations_with_replacement(range(SEGMENTS), size):
            for signs in product((1, -1), repeat=size):
                at = [0] * SEGMENTS
                for d, s in zip(dims, signs, strict=True):
                    at[d] += s
                if sum(map(abs, at)) == size:
                    found.add(sum(x * 16**i for i, x in enumerate(at)))
    # the top count may wrap the sign bit; differences are taken modulo 2**64, as longs are
    return sorted((x + 2**63) % 2**64 - 2**63 for x in found)


def _reached(distinct: DataFrame, n: int, name: str, parts: int) -> DataFrame:
    """The cells that each fingerprint reaches within n steps, dealt by cell; the input may lie in few partitions, so it is dealt anew first."""
    offsets = F.array(*[F.lit(x).cast("long") for x in [0, *steps(n)]])
    own = distinct.select("fp").repartition(parts, "fp").select(F.col("fp").alias(name), cell(F.col("fp")).alias("from"), F.explode(offsets).alias("step"))
    # a step that takes a count out of 0..4 reaches no point
    return own.select(name, (F.col("from") + F.col("step")).alias("cell")).filter(F.expr(_in_range("cell"))).repartition(parts, "cell")


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints in column ``fp`` that differ in at most ``bits`` bits."""
    # the rows are small but each meets many, so partitions are cut by rows, not left to be merged by size
    parts = max(1, -(-distinct.count() // FINGERPRINTS))
    far = _reached(distinct, bits - bits // 2, "a", parts).hint("shuffle_hash")
    near = far.join(_reached(distinct, bits // 2, "b", parts), "cell").filter((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & (F.col("a") != F.col("b")))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_range(column: str) -> str:
    """Each of the packed counts is 0 to 4: no high bit, and bit 2 only alone."""
    high, four, low = (int(x * 16, 16) for x in "843")
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    return f"({column} & {signed(high)}L) = 0 AND (shiftrightunsigned({column} & {signed(four)}L, 2) * 3 & {column} & {signed(low)}L) = 0"


def classes(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp, component``: the class of each distinct fingerprint of ``fps`` (doc_id, fp), ``least``, its least doc_id, and ``n``, its rows."""
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(checkpointed(links(distinct, bits)))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "least", "n")


def class_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``a, b``: each node of ``prints`` (node, fp) with the least node of its class; nodes are longs and may have several fingerprints."""
    found = classes(prints.withColumnRenamed("node", "doc_id"), bits)
    least = found.groupBy("component").agg(F.min("least").alias("b"))
    return prints.join(found.select("fp", "component"), "fp").join(least, "component").select(F.col("node").alias("a"), "b").filter("a <> b")


def _look_up(fps: DataFrame, found: DataFrame) -> DataFrame:
    """Joins rows with the one row of their fingerprint; those of a fingerprint with over a ``HOT``-th of all rows are dealt to ``HOT`` tasks."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = [r["fp"] for r in found.filter(F.col("n") * HOT > total).select("fp").collect()]  # less than HOT rows
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    left = fps.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(HOT))).otherwise(F.lit(0)).cast("int"))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))
    return left.join(found.drop("n").withColumn("salt", F.explode(every)), ["fp", "salt"]).drop("salt")


def simhash_classes(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits), ``component_id`` of each row.

    Texts that are null, empty or without words have fingerprint zero and link like any other.
    Repeated rows are one class; an empty table gives no rows; other columns are not read.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle, seed))
    found = classes(fps, bits)
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = checkpointed(found.join(least, "component").select("fp", "component_id", "n"))
    return _look_up(fps, found).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents: one with the least id (of those, the least fingerprint).

    Rows with a null id come last in their group.  Of repeated rows one stays.
    Columns stay as they are.
    """
    (key,) = spare(docs, "fingerprint_key")
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle, seed))
    winner = classes(fps, bits).groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("w"))
    winner = winner.select(_key(F.col("w.fp"), F.col("w.least")).alias(key))
    own = docs.mapInArrow(partial(_with_fingerprint, text=text_col, name=key, shingle=shingle, seed=seed), extended(docs.schema, **{key: "long"}))
    own = own.withColumn(key, _key(F.col(key), F.col(id_col)))
    return own.join(winner, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def _key(fp: Column, of: Column) -> Column:
    return F.concat_ws("|", F.hex(fp), of.cast("string"))


def _with_fingerprint(batches, text: str, name: str, shingle: int, seed: int):
    for part in slices(batches, text):
        fps = np.array([fingerprint(t, shingle, seed) for t in part.column(text).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps)], names=[*part.schema.names, name])
