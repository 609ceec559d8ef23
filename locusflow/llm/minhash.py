"""Near-dedup by Jaccard similarity of five-word shingles: MinHash bands propose, the sets themselves decide.

A document is the set of its word shingles.  Documents of one set are one node.  Each set has ``BANDS`` buckets, each a hash of ``ROWS`` minima under
independent hash functions, so two sets of similarity s share a bucket with probability 1 - (1 - s**ROWS)**BANDS: 0.999997 at 0.8.
Pairs that share a bucket are verified by the exact similarity before they become links.

So that a large group of near copies doesn't make all of its pairs, each bucket's members are first compared with one of them
alone, and again with another where links leave the bucket in several components.  At last the members outside the largest component of a bucket meet all of
its members in blocks: a task takes the sets of two blocks, has the sizes of all intersections from matrix products, and
emits no more links than the components that it joins.  No pairs become rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, likely, spare
from .components import components
from .simhash import fingerprint
from .words import Words, mix, slices

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS, SEED = 5, 32, 42
#: Sets and shingles of a block, and columns of the incidence matrices that are multiplied at once.
BLOCK, _COLUMNS = (512, 500_000), 4096
#: Members of a bucket for each task that has its centre.
CENTRE_ROWS = 500
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``k`` words (A-Z as a-z); a shorter text is one shingle, one without words none."""
    w = Words(texts)
    w.buf = _LOWER[w.buf]
    h = w.hashes()
    out = [np.zeros(0, np.uint64)] * len(w.count)
    for n in range(1, k + 1):
        own = np.flatnonzero(w.count >= k if n == k else w.count == n)
        if not len(own):
            continue
        hashes = w.windows(h, n)
        for i in own.tolist():
            out[i] = np.unique(hashes[w.first[i] : w.first[i + 1] - n + 1])
    return out


def node(shingles: np.ndarray) -> int:
    """A fingerprint of the set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def buckets(sets: list[np.ndarray], rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> np.ndarray:
    """A row of ``bands`` bucket numbers for each set; sets must not be empty."""
    rng = np.random.Generator(np.random.PCG64(seed))
    factor = rng.integers(0, 2**63, rows * bands, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**64, rows * bands, np.uint64, endpoint=False)
    out = np.empty((len(sets), bands), np.uint64)
    if not sets:
        return out
    x = np.concatenate(sets)
    y, at = np.empty_like(x), np.cumsum([0, *map(len, sets[:-1])])
    for b in range(bands):
        total = np.full(len(sets), b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            np.multiply(x, factor[i], out=y)
            y += shift[i]
            total = mix(total * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(y, at))
        out[:, b] = total
    return out


def _sketches(batches, shingle: int, prints: bool):
    for part in slices(batches, "text"):
        sets = shingle_sets(part.column("text"), shingle)
        full = [i for i, s in enumerate(sets) if len(s)]
        own = dict(zip(full, buckets([sets[i] for i in full]).view(np.int64), strict=True))
        rows = pa.array([own.get(i, ()) for i in range(len(sets))], pa.list_(pa.int64()))
        kept = ["doc_id", "t0", "t1"]
        fps = pa.array(np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)) if prints else pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), rows, fps], names=[*kept, "node", "n", "buckets", "fp"])


def _sets(batches, shingle: int):
    for part in slices(batches, "text"):
        sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), shingle)]
        yield pa.RecordBatch.from_arrays([pa.array([node(s.view(np.uint64)) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])


def _text_key(text: Column) -> tuple[Column, Column]:
    """A text's 128-bit name, by which rows are found again without another pass over their words."""
    return F.xxhash64(F.lit(0), text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b``: the pairs ``node, centre`` whose sets are similar.  A centre meets many nodes, so its set is dealt to a task for each ``CENTRE_ROWS`` members of its largest bucket (``size``)."""
    parts = F.ceil(F.col("size") / CENTRE_ROWS).cast("int")
    own = pairs.filter("node <> centre").groupBy("node", "centre").agg(F.max(parts).alias("parts"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    centres = own.groupBy("centre").agg(F.max("parts").alias("parts")).select("centre", salts).join(sets.select(F.col("node").alias("centre"), F.col("items").alias("y")), "centre")
    both = own.join(sets.withColumnRenamed("items", "x"), "node").join(centres, ["centre", "salt"])
    common, n = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return checkpointed(both.filter(common / (n - common) >= similarity).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))


def _could(n: str, m: str, similarity: float):
    """Sets whose sizes differ more can't be similar."""
    return F.least(n, m) / F.greatest(n, m) >= similarity


def _open(rows: DataFrame, found: DataFrame, salt: int) -> DataFrame:
    """Rows ``bucket, node, n, size`` of buckets of over two sets that the links leave in several components, with their ``component``, whether it is the bucket's largest (``main``), and ``centre`` (node, n), some member of that one."""
    part = components(found).withColumnRenamed("component", "of")
    rows = checkpointed(rows.select("bucket", "node", "n", "size").join(part, "node", "left").select("bucket", "node", "n", "size", F.coalesce("of", "node").alias("component")))
    centre = F.min(F.struct(F.xxhash64(F.lit(salt), "node").alias("order"), "node", "n")).alias("centre")
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n_nodes"), centre)
    heads = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n_nodes", "component", "centre")).alias("largest")).filter("parts > 1")
    return checkpointed(rows.filter("size > 2").join(heads, "bucket").select("bucket", "node", "n", "size", "component", (F.col("component") == F.col("largest.component")).alias("main"), "largest.centre"))


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set on the left with each on the right, by products of slices of their incidence matrices."""
    own, other = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(own, other)
    out = np.zeros((len(left), len(right)))

    def places(items: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, items)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == items[hit]
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (i, x), (j, y) = places(own, left), places(other, right)
    for a in range(0, len(shared), _COLUMNS):
        n = min(_COLUMNS, len(shared) - a)
        sides = []
        for row, at, sets in ((i, x, left), (j, y, right)):
            lo, hi = np.searchsorted(at, [a, a + n])
            part = np.zeros((len(sets), n), np.float32)
            part[row[lo:hi], at[lo:hi] - a] = 1
            sides.append(part)
        out += sides[0] @ sides[1].T
    return out


def _linking(rows: pa.Table, similarity: float) -> pa.Table:
    """Of one pair of blocks: similar pairs that join different components, as few as connect what all of them do."""
    outer = np.array(rows.column("outer").to_pylist(), bool)
    node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
    sets = [np.array(x, np.int64) for x in rows.column("items").to_numpy()]
    left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
    a, b = [], []
    if len(left) and len(right):
        size = np.array([len(s) for s in sets], float)
        both = _intersections([sets[i] for i in left], [sets[j] for j in right])
        near = both / (size[left][:, None] + size[right][None, :] - both) >= similarity
        i, j = np.nonzero(near & (component[left][:, None] != component[right][None, :]))
        i, j = left[i], right[j]
        ends = np.sort(np.stack([component[i], component[j]], axis=1), axis=1)
        _, one = np.unique(ends, axis=0, return_index=True)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        for k in one.tolist():
            p, q = top(int(component[i[k]])), top(int(component[j[k]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(int(node[i[k]]))
                b.append(int(node[j[k]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _blocks(rows: DataFrame, sets: DataFrame, similarity: float, members: int, items: int) -> DataFrame:
    """Links between the components of open buckets: blocks of a bucket's outer members meet blocks of all of its members.

    A block has about ``members`` sets and ``items`` shingles at most, or one set.
    """
    count = lambda m, n: F.greatest(F.ceil(m / members), F.ceil(n / items)).cast("int")
    outer = F.when(~F.col("main"), 1).otherwise(0)
    grid = rows.groupBy("bucket").agg(F.sum(outer).alias("o"), F.sum(outer * F.col("n")).alias("on"), F.count("*").alias("m"), F.sum("n").alias("mn"))
    grid = rows.join(grid.select("bucket", count(F.col("o"), F.col("on")).alias("os"), count(F.col("m"), F.col("mn")).alias("ms")), "bucket")
    deal = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = grid.select("bucket", deal("ms").alias("mine"), every("os").alias("other"), F.lit(False).alias("outer"), "node", "component")
    left = grid.filter("NOT main").select("bucket", every("ms").alias("mine"), deal("os").alias("other"), F.lit(True).alias("outer"), "node", "component")
    both = right.unionByName(left).join(sets, "node")
    return both.groupBy("bucket", "mine", "other").applyInArrow(lambda t: _linking(t, similarity), "a long, b long")


def links(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: tuple[int, int] = BLOCK) -> DataFrame:
    """Pairs ``a, b`` of nodes of ``distinct`` (node, w: with the key of a text, n, buckets) that are similar: enough of them to connect whatever candidates do. ``docs`` has ``text, t0, t1``."""
    every = distinct.select(F.explode("buckets").alias("bucket"), "node", "n")
    # most buckets have one set and go at once; counts combine before they move, and the join may split a large bucket
    shared = every.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = checkpointed(every.join(shared, "bucket"))
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"same{i}") for i in range(2)]
    heads = rows.groupBy("bucket", "size").agg(*same, F.min(F.struct("node", "n")).alias("centre"))
    # of buckets with the same members one is enough
    heads = heads.groupBy("size", "same0", "same1", "centre").agg(F.min("bucket").alias("bucket")).select("bucket", "centre")
    members = checkpointed(rows.join(heads, "bucket"))

    candidates = distinct.select("node", "w.t0", "w.t1").join(members.select("node").distinct(), "node", "left_semi").select("t0", "t1")
    # of copies each partition sends one, and few of the texts that are no candidates
    texts = likely(docs, "t0", candidates).groupBy("t0", "t1").agg(F.first("text").alias("text")).join(candidates, ["t0", "t1"], "left_semi").select("text")
    sets = checkpointed(texts.mapInArrow(partial(_sets, shingle=shingle), "node long, items array<long>"))

    could, met = _could("n", "centre.n", similarity), ("node", F.col("centre.node").alias("centre"), "size")
    found = _similar(members.filter(could).select(*met), sets, similarity)
    rows = _open(members, found, 1)
    found = found.unionByName(_similar(rows.filter(could & ~F.col("main")).select(*met), sets, similarity))
    # each pair of a bucket that isn't connected yet has a member outside the bucket's largest component
    return found.unionByName(checkpointed(_blocks(_open(rows, found, 2), sets, similarity, *block)))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: tuple[int, int] = BLOCK, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each group of documents linked by a Jaccard similarity of at least ``similarity``: one with the least id (of those, the least key of its text).

    ``also`` makes further links ``a, b`` of nodes (sets) from the SimHash fingerprints of their texts (``node, fp``), such as ``simhash.class_links``; groups follow from both.
    Texts without words are one group.  Rows with a null id come last in their group.  Of
    repeated rows one stays.  Columns stay as they are.
    """
    (key,) = spare(docs, "text_key")
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *_text_key(docs[text_col]))
    sketches = two.mapInArrow(partial(_sketches, shingle=shingle, prints=also is not None), f"doc_id {dict(two.dtypes)['doc_id']}, t0 long, t1 long, node long, n long, buckets array<long>, fp long")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")).alias("w")
    distinct = checkpointed(sketches.groupBy("node").agg(least, F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.collect_set("fp").alias("fps")))
    near = links(two, distinct, shingle, similarity, block)
    if also:
        near = near.unionByName(also(distinct.select("node", F.explode("fps").alias("fp"))))
    found = components(near).withColumnRenamed("node", "of")
    classes = distinct.join(found, F.col("node") == F.col("of"), "left").select("w", F.coalesce("component", "node").alias("component"))
    winner = classes.groupBy("component").agg(F.min("w").alias("w")).select(_row_key(F.col("w.t0"), F.col("w.t1"), F.col("w.doc_id")).alias(key))
    own = docs.withColumn(key, _row_key(*_text_key(docs[text_col]), docs[id_col]))
    return own.join(winner, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def _row_key(t0: Column, t1: Column, of: Column) -> Column:
    return F.concat_ws("|", F.hex(t0), F.hex(t1), of.cast("string"))
