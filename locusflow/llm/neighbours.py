"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three times random signs and the fast Hadamard transform) and goes to the
nearest signed axis: the component of largest absolute value, with its sign.  Each of ``TABLES`` tables has a rotation of its own, so a row lies in one bucket of each.  A query
probes the ``PROBES`` buckets of all tables together on whose axes it projects furthest; all rows of these are candidates and get exact distances.

Buckets are dealt in shards: a bucket with many rows is cut into several by the rows' hash, and one that many queries probe into several groups of queries, so a common
vector fills no task.  Each pair of shard and group keeps the k nearest of each query.  A query that finds
fewer than k rows searches all rows by the buckets of one table, which hold each row once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed
from .topk import Best

K, QUERY_STEP, SEED = 10, 100, 7
#: Rotations, and buckets that a query probes of the 2 x TABLES x width that there are.
TABLES, PROBES = 8, 112
#: Rows of a shard: about twice the mean bucket, within these bounds; queries of a group; bytes of either; queries and rows that meet at once; pairs with exact distances at once.
SHARD_MIN, SHARD_MAX, GROUP, SHARD_BYTES, QUERY_BLOCK, ROW_BLOCK, PAIR_BLOCK = 1024, 131_072, 16_384, 32 << 20, 256, 4096, 65_536
_FOUND = "query_id long, vec_id long, score double"


# -- hashing -------------------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row (a power of two long)."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(unit: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    draw = np.random.default_rng([seed, table])
    for _ in range(3):
        unit = hadamard(unit * draw.choice(np.array([-1.0, 1.0]), unit.shape[1]))
    return unit


def _power(width: int) -> int:
    return 1 << max(0, (max(width, 1) - 1).bit_length())


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def buckets(unit: np.ndarray, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """The bucket of each row in each table: (table x width + axis) x 2, and 1 more for the negative side."""
    out = np.zeros((len(unit), tables), np.int32)
    for t in range(tables):
        r = rotated(unit, t, seed)
        axis = np.abs(r).argmax(axis=1)
        out[:, t] = (t * unit.shape[1] + axis) * 2 + (r[np.arange(len(r)), axis] < 0)
    return out


def probes(unit: np.ndarray, n: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """The n buckets of all tables on whose signed axes each row projects furthest."""
    r = np.stack([rotated(unit, t, seed) for t in range(tables)], axis=1)
    far = np.stack([r, -r], axis=3).reshape(len(unit), -1)
    n = min(n, far.shape[1])
    return np.argsort(-far, axis=1, kind="stable")[:, :n].astype(np.int32)


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, with zeros after shorter ones."""
    end = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(end)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(end[0], end[-1]) - end[:-1][row]] = column.values.to_numpy(zero_copy_only=False)[end[0] : end[-1]]
    return out


def _with_lists(df: DataFrame, name: str, width: int, make) -> DataFrame:
    """Adds an array of ints that ``make`` tells of the unit vectors."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROW_BLOCK):
                batch = whole.slice(at, ROW_BLOCK)
                out = make(unit_rows(dense(batch.column("v"), width)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


# -- exact distances -------------------------------------------------------------------------


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> Best:
    """The k nearest rows of each query, by score = -distance; rows with the query's own id take no part.

    Products of matrices bound the squared distances to within rounding; pairs that may be among the k get them from differences.
    """
    best, top = Best(len(q), k), max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0))
    unit = 2.0 ** -np.frexp(top)[1] if top > 0 else 1.0  # a power of two: no digit changes
    q, c = q * unit, c * unit
    limit, qq = np.full(len(q), np.inf), (q * q).sum(axis=1)
    for at in range(0, len(c), ROW_BLOCK):
        part, own = c[at : at + ROW_BLOCK], ids[at : at + ROW_BLOCK]
        size = qq[:, None] + (part * part).sum(axis=1)[None]
        d2, slack = size - 2 * (q @ part.T), 1e-12 * size
        d2[q_ids[:, None] == own[None]] = np.inf
        if len(part) >= k:
            limit = np.minimum(limit, np.partition(d2 + slack, k - 1, axis=1)[:, k - 1])
        qi, ci = np.nonzero((d2 - slack <= limit[:, None]) & np.isfinite(d2))
        for b in range(0, len(qi), PAIR_BLOCK):
            x, y = qi[b : b + PAIR_BLOCK], ci[b : b + PAIR_BLOCK]
            best.add(x, own[y], -np.sqrt(((q[x] - part[y]) ** 2).sum(axis=1)))
        limit = np.minimum(limit, best.least**2 * (1 + 1e-12))
    best.score = -best.score / unit
    return best


def _meet(queries: pa.Table, rows: pa.Table, k: int, width: int) -> pa.Table:
    out = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
    if queries.num_rows and rows.num_rows:
        (q_ids, q), (ids, c) = ((t.column("vec_id").to_numpy(), dense(pa.concat_arrays(t.column("v").chunks), width)) for t in (queries, rows))
        for at in range(0, len(q_ids), QUERY_BLOCK):
            part = q_ids[at : at + QUERY_BLOCK]
            best = search(part, q[at : at + QUERY_BLOCK], ids, c, k)
            out.append(pa.table({"query_id": part[best.query], "vec_id": best.id, "score": best.score.astype(np.float64)}))
    return pa.concat_tables(out)


# -- the operator ------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the distinct rows with an id and a vector of finite components that aren't all zero."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind if kind == "array<float>" else "array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.filter(finite & F.exists("v", lambda x: x != 0)).dropDuplicates()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.repartition("query_id").distinct().withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """The nearest found for ``queries`` (vec_id, v, and b: buckets to probe) among ``rows`` (vec_id, v, b: buckets they are in)."""
    row_in, query_in = rows.select("vec_id", "v", F.explode("b").alias("b")), queries.select(*[F.col(c).alias(c) for c in ("vec_id", "v")], F.explode("b").alias("b"))
    n = row_in.groupBy("b").agg(F.count("*").alias("n"))
    mean = n.agg(F.avg("n")).first()[0] or 0
    fit = max(1, SHARD_BYTES // (8 * width))
    shard = min(max(SHARD_MIN, 2 * int(mean)), SHARD_MAX, fit)
    m = query_in.groupBy("b").agg(F.count("*").alias("m"))
    # a row for each bucket, 2 x tables x width of them at most
    parts = F.broadcast(n.join(m, "b").select("b", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("m") / min(GROUP, fit)).cast("int").alias("groups")))
    deal = lambda what, parts: F.pmod(F.xxhash64(F.lit(what), "vec_id", "v"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = query_in.join(parts, "b").select("vec_id", "v", "b", deal("group", "groups").alias("g"), every("shards").alias("s")).groupBy("b", "g", "s")
    right = row_in.join(parts, "b").select("vec_id", "v", "b", every("groups").alias("g"), deal("shard", "shards").alias("s")).groupBy("b", "g", "s")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return _meet(a, b, k, width)

    return left.cogroup(right).applyInArrow(meet, _FOUND)


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, tables: int = TABLES, n_probes: int = PROBES, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query by Euclidean distance, nearest first, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``query_step``; candidates all rows but those with the query's own id.  All candidates are returned where there are fewer than k.
    Null, all-zero and empty vectors and null or non-finite components take no part, nor do rows without an id.  Repeated rows (same id and vector)
    count once; rows of one id with other vectors each for themselves, once where their distances are equal; queries of one id are answered together.  Vectors of
    different lengths meet as if zeros followed the shorter one.  Buckets go by direction alone, so recall is meant for vectors of like norm.  Other columns are not read.
    """
    own = usable(vectors, id_col, vector_col)
    width = _power(vectors.agg(F.max(F.size(vectors[vector_col]))).first()[0] or 1)
    rows = checkpointed(_with_lists(own, "b", width, lambda x: buckets(x, tables, seed)))
    asked = rows.filter(F.col("vec_id") % query_step == 0).select("vec_id", "v")
    found = checkpointed(_ranked(_search(rows, _with_lists(asked, "b", width, lambda x: probes(x, n_probes, tables, seed)), k, width), k))
    # those that found too few search the first table whole
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = checkpointed(asked.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    whole = short.withColumn("b", F.sequence(F.lit(0), F.lit(2 * width - 1)))
    exact = _ranked(_search(rows.withColumn("b", F.slice("b", 1, 1)), whole, k, width), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact)
