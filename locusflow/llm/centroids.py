"""Centroid clustering with ball trees: exact Lloyd rounds that settle whole balls of vectors at once.

Each partition packs its vectors into metric trees of at most ``TREE_ROWS`` rows.  A node is a ball with
its radius, its count and the integer sum of its vectors; its centre is the mean.  Where a centroid lies at distance d of a centre,
all vectors of the ball are within d - r and d + r of it (the triangle inequality), so a centroid with d - r above the least
d + r can't be the nearest of any.  A ball with one centroid left goes to it as a whole, by
its count and sum; the others are opened, down to leaves, whose rows get exact integer distances to the centroids left.

Rows never move: trees are made where rows are read, written once (checkpoint), and read again in each round.
A round sends centroids out (k x dims numbers) and gets at most k x (dims + 1) sums of a tree back,
which are added up before they reach the driver as k x (dims + 1) numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

K, ROUNDS, SEED, SCALE, DIMS = 40, 5, 2, 256, 64
#: Rows of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 4096, 32
#: Largest component after scaling: squared distances of 64 of them fit a long.
MAX_COMPONENT = 1 << 27
_EXACT = 2.0**52
_TREE = "ids array<long>, v array<int>, radius array<double>, n array<int>, sums array<long>"
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


# -- trees -------------------------------------------------------------------------------


def _levels(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF_ROWS))))


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among n rows."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def build(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows in the tree, and radius, count and sum of each node, level by level from the root.

    A node is cut in halves along the line between two of its vectors that lie far apart.
    """
    n, order = len(v), np.arange(len(v))
    wide = v.astype(np.float64)
    for level in range(_levels(n)):
        edge, below = bounds(n, level), bounds(n, level + 1)
        for i in range(1 << level):
            own = order[edge[i] : edge[i + 1]]
            x = wide[own]
            a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            order[edge[i] : edge[i + 1]] = own[np.argpartition(x @ (b - a), below[2 * i + 1] - edge[i] - 1)] if len(own) > 1 else own
    v, wide = v[order], wide[order]
    radius, count, sums = [], [], []
    for level in range(_levels(n) + 1):
        edge = bounds(n, level)
        count.append(np.diff(edge))
        sums.append(np.add.reduceat(v, edge[:-1], axis=0))
        centre = np.repeat(sums[-1] / count[-1][:, None], count[-1], axis=0)
        radius.append(np.maximum.reduceat(np.sqrt(((wide - centre) ** 2).sum(axis=1)), edge[:-1]))
    return order, np.concatenate(radius), np.concatenate(count), np.concatenate(sums)


def quantised(flat: np.ndarray, scale: float) -> np.ndarray:
    out = np.floor(flat * scale)
    if np.abs(out).max(initial=0.0) > MAX_COMPONENT:
        raise ValueError(f"a component is beyond {MAX_COMPONENT} after scaling by {scale:g}; its squared distances need not fit a long")
    return out.astype(np.int64)


def trees(kept: DataFrame, dims: int, scale: float) -> DataFrame:
    """A row for each ball tree over ``kept`` (vec_id, e), made of the rows of one partition."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                held.append(batch.slice(at, TREE_ROWS))
                n += held[-1].num_rows
                if n >= TREE_ROWS:
                    yield from packed(held)
                    held, n = [], 0
        if n:
            yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        e = pa.concat_arrays(table.column("e").chunks)
        v = quantised(e.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale).reshape(-1, dims)
        order, radius, count, sums = build(v)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        ids = table.column("vec_id").take(pa.array(order)).combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(v[order].ravel().astype(np.int32), pa.int32()), one(radius, pa.float64()), one(count.astype(np.int32), pa.int32()), one(sums.ravel(), pa.int64())],
            names=["ids", "v", "radius", "n", "sums"],
        )

    return kept.mapInArrow(make, _TREE)


def _unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        ids, v, radius, n, sums = (batch.column(c)[i].values for c in ("ids", "v", "radius", "n", "sums"))
        yield ids, v.to_numpy().astype(np.int64).reshape(-1, dims), radius.to_numpy(), n.to_numpy(), sums.to_numpy().reshape(-1, dims)


# -- assignment --------------------------------------------------------------------------


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    top = float(np.abs(v).max(initial=0)) + float(np.abs(c).max(initial=0))
    if top * top * max(v.shape[1], 1) < _EXACT:  # sums of integers below 2**53 are exact in any order
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1) if len(c) else np.zeros((len(v), 0), np.int64)


def descend(v: np.ndarray, radius: np.ndarray, count: np.ndarray, sums: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties to the smaller number), counts and sums by centroid, and how many rows were settled as whole balls."""
    label = np.full(len(v), -1, np.int64)
    size, total, whole = np.zeros(len(c), np.int64), np.zeros((len(c), v.shape[1]), np.int64), 0
    nodes, mask, first = np.zeros(1, np.int64), np.ones((1, len(c)), bool), 0
    wide, last = c.astype(np.float64), _levels(len(v))
    for level in range(last + 1):
        edge, at = bounds(len(v), level), first + nodes
        centre = sums[at] / count[at][:, None]
        d = np.sqrt(np.maximum(0.0, ((centre[:, None, :] - wide[None]) ** 2).sum(axis=2)))
        r = radius[at][:, None]
        d[~mask] = np.inf
        near = (d + r).min(axis=1, keepdims=True)
        mask = mask & (d - r <= near + 1e-9 * (1 + near))
        one = mask.sum(axis=1) == 1
        for node, to in zip(nodes[one], mask[one].argmax(axis=1), strict=True):
            label[edge[node] : edge[node + 1]] = to
        to = mask[one].argmax(axis=1)
        np.add.at(size, to, count[at[one]])
        np.add.at(total, to, sums[at[one]])
        whole += int(count[at[one]].sum())
        first += 1 << level
        if level < last:
            nodes, mask = np.concatenate([2 * nodes[~one], 2 * nodes[~one] + 1]), np.concatenate([mask[~one], mask[~one]])
        else:
            nodes, mask = nodes[~one], mask[~one]
            length = np.diff(edge)[nodes]
            row = np.repeat(edge[nodes] - np.concatenate([[0], length.cumsum()[:-1]]), length) + np.arange(length.sum()) if len(nodes) else np.zeros(0, np.int64)
            if len(row):
                columns = np.flatnonzero(mask.any(axis=0))
                exact = squared(v[row], c[columns])
                exact[~np.repeat(mask[:, columns], length, axis=0)] = np.iinfo(np.int64).max
                to = columns[exact.argmin(axis=1)]
                label[row] = to
                size += np.bincount(to, minlength=len(c))
                np.add.at(total, to, v[row])
    return label, size, total, whole


def own_distance(v: np.ndarray, c: np.ndarray, label: np.ndarray) -> np.ndarray:
    return ((v - c[label]) ** 2).sum(axis=1)


def _sums(forest: DataFrame, c: np.ndarray, distances: bool = False) -> dict[tuple[int, int], int]:
    """Sums by (centroid, component); component -1 is the count.  With ``distances`` -2 and -3 are the high and the low 31 bits of the distances."""
    dims = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, v, radius, count, sums in _unpacked(batch, dims):
                label, size, total, _ = descend(v, radius, count, sums, c)
                columns = [size[:, None]]
                if distances:
                    d, high, low = own_distance(v, c, label), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
                    np.add.at(high, label, d >> 31)
                    np.add.at(low, label, d & ((1 << 31) - 1))
                    columns = [low[:, None], high[:, None], *columns]
                table = np.hstack([*columns, total])
                some = np.flatnonzero(size)
                component = np.arange(table.shape[1]) - len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, table.shape[1]).astype(np.int32)), pa.array(np.tile(component, len(some)).astype(np.int32)), pa.array(table[some].ravel())], names=["cluster", "i", "s"])

    rows = forest.mapInArrow(run, "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()  # k x (dims + 3)
    return {(r["cluster"], r["i"]): r["s"] for r in rows}


# -- the operator ------------------------------------------------------------------------


@dataclass
class Model:
    """Centroids, and of the vectors they were learned from: counts and sums of squared distances by centroid."""

    centroids: np.ndarray
    count: list[int]
    inertia: list[int]

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """``vec_id, e`` of the vectors with exactly ``dims`` components, all finite."""
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("e")).filter(F.size("e") == dims)
    return own.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def starts(own: DataFrame, k: int, seed: int, scale: float) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 with the seed, in its order; rows of one id by their components, those without an id last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = own.select("e", h.alias("h")).orderBy(F.asc_nulls_last("h"), "e").limit(k).collect()  # k vectors
    return quantised(np.array([r["e"] for r in rows], np.float64), scale)


def learn(forest: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Rounds of assignment and replacement by floor(sum / count), then counts and inertia of one more assignment."""
    c = first
    for _ in range(rounds):
        got = _sums(forest, c)
        c = np.array([[got[j, i] // got[j, -1] for i in range(c.shape[1])] if (j, -1) in got else c[j].tolist() for j in range(len(c))], np.int64)
    got = _sums(forest, c, distances=True)
    return Model(c, [got.get((j, -1), 0) for j in range(len(c))], [(got.get((j, -2), 0) << 31) + got.get((j, -3), 0) for j in range(len(c))])


def assign(forest: DataFrame, model: Model) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of the trees."""
    c, own, every = model.centroids, model.inertia, sum(model.inertia)
    if every >= 1 << 63:
        raise ValueError("the sum of squared distances doesn't fit a long")
    sha = model.sha256()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, radius, count, sums in _unpacked(batch, c.shape[1]):
                label = descend(v, radius, count, sums, c)[0]
                to = pa.array(label)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(label.astype(np.int32)), pa.array(own_distance(v, c, label)), pa.array(own, pa.int64()).take(to), pa.array(np.full(len(label), every, np.int64)), pa.array(sha, pa.string()).take(to)],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return forest.mapInArrow(run, _OUT)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: float = SCALE, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector with exactly ``dims`` finite components: its cluster, squared distance, the sums over its cluster and over all, and its centroid's sha256.

    Components become floor(scale * x); one beyond 2**27 then raises, as distances need not fit a long.  Every row counts, repeated ones too; rows
    without an id are clustered like others but start a centroid only after all with one.  Fewer than k vectors give fewer centroids, none give no rows.  Ties go to
    the smaller number; empty centroids stay.  Null vectors, other lengths and null or non-finite components take no part; other columns are not read.
    """
    own = kept(vectors, id_col, vector_col, dims)
    first = starts(own, k, seed, scale)
    if not len(first):
        return vectors.sparkSession.createDataFrame([], _OUT)
    forest = checkpointed(trees(own, dims, scale))
    return assign(forest, learn(forest, first, rounds))


def sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS) -> str:
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v, embedding AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1)::INTEGER AS cluster, v AS c FROM v QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"p{r} AS MATERIALIZED (SELECT rid, vec_id, v, cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM v, c{r})")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT * FROM p{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1)")
        if r < rounds:
            ctes.append(f"s{r} AS MATERIALIZED (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY ALL) GROUP BY cluster)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(s.c, o.c) AS c FROM c{r} o LEFT JOIN s{r} s USING (cluster))")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"


SQL = sql()
