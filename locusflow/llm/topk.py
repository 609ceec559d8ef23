"""Exact top-k by inner product, with multi-resolution segment statistics.

A vector is cut into 2, 4, ... equal segments.  For a segment of w components with means
m, n and standard deviations s, t of two vectors, the squared distance of the
segments is at least w((m-n)**2 + (s-t)**2); as |a-b|**2 = |a|**2 + |b|**2 - 2ab,
their inner product is at most w(mn + st).  Summed over segments this bounds
the score of a pair, the more tightly the more segments.  Levels go coarse to fine; a pair
whose bound stays below the k-th best score so far is left, and the survivors
get exact integer products.

Queries are a stated set: they meet all rows in blocks.  Rows are dealt to spans and queries to groups by their hash, so a task that runs again after a lost executor makes the same blocks.  A cogroup of one group of queries with one span
reads each of them once and keeps the k best of each query; a second aggregation joins the spans.
Group and span are bounded in rows and in bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SCALE, QUERY_STEP = 5, 256, 50
#: Queries in a group and rows in a span, on average, and bytes of either; queries that are multiplied at once.
QUERY_GROUP, SPAN, SPAN_BYTES, QUERY_BLOCK = 4096, 16_384, 32 << 20, 256
LEVELS = (4, 16)
_EXACT = 2.0**52
#: Components beyond raise; scores that aren't within plus or minus this raise if they are among the results.
_LARGEST, _SCORE = 1 << 62, (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (array of long): floor(scale * x) of each component, of the rows with an id whose vector has only finite components."""
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("e")).filter("vec_id IS NOT NULL AND e IS NOT NULL")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = F.raise_error(F.lit("a component is beyond 2**62 after scaling")).cast("long")
    whole = lambda x: F.when(F.abs(x * F.lit(float(scale))) <= F.lit(float(_LARGEST)), F.floor(x * F.lit(float(scale)))).otherwise(large)
    return own.filter(finite).select("vec_id", F.transform("e", whole).alias("v"))


def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components (zeros after shorter vectors) of the distinct rows, in order of the ids."""
    rows = rows.combine_chunks()
    column = rows.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, end = column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy().astype(np.int64)
    size = np.diff(end)
    out = np.zeros((len(size), int(size.max(initial=0)) + 1), np.int64)
    out[:, 0] = size  # so that a vector and the same with zeros behind it are two
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(end[0], end[-1]) - end[:-1][row] + 1] = flat[end[0] : end[-1]]
    ids = rows.column("vec_id").to_numpy()
    one = np.unique(np.hstack([ids[:, None], out]), axis=0)
    return one[:, 0].copy(), one[:, 2:].copy()


def _statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length: one row a vector, so that a product of rows is the bound."""
    parts = np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1])) if v.shape[1] else []
    out = [np.zeros((len(v), 0))]
    for p in parts:
        x = v[:, p]
        root = np.sqrt(len(p))
        out += [x.mean(axis=1, keepdims=True) * root, x.std(axis=1, keepdims=True) * root]
    return np.hstack(out)


def _padded(v: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, width), np.int64)
    out[:, : v.shape[1]] = v
    return out


def _exact(q: np.ndarray, c: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The surviving pairs and their integer products; Python's integers where doubles could round."""
    rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    qi, ci = np.nonzero(alive[np.ix_(rows, columns)])
    a, b = q[rows], c[columns]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(q.shape[1], 1)
    if top < _EXACT:  # sums of integers below 2**53 are exact in any order
        score = (a.astype(np.float64) @ b.astype(np.float64).T)[qi, ci].astype(np.int64)
    else:
        exact = (sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True)) for i, j in zip(qi.tolist(), ci.tolist(), strict=True))
        score = np.array([max(-_SCORE, min(_SCORE, x)) for x in exact], np.int64)
    return rows[qi], columns[ci], score


class Best:
    """The k best (score, least vec_id) of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        full = np.bincount(self.query, minlength=len(self.least)) >= self.k
        worst = np.full(len(self.least), np.inf)
        np.minimum.at(worst, self.query, self.score)
        self.least[full] = worst[full]


def search(q_ids: np.ndarray, q: np.ndarray, blocks, k: int, levels=LEVELS) -> Best:
    """The k best of each query over blocks of (ids, vectors); a row with the query's own id takes no part."""
    best, stats = Best(len(q), k), {}
    for c_ids, c in blocks:
        width = max(q.shape[1], c.shape[1])
        a, b = (_padded(x, width, len(x)) if x.shape[1] < width else x for x in (q, c))
        if width not in stats:
            stats[width] = [_statistics(a.astype(np.float64), s) for s in levels]
        slack = 1e-9 * (1 + np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * width)
        for at in range(0, len(b), 1024):
            part, ids = b[at : at + 1024], c_ids[at : at + 1024]
            wide = part.astype(np.float64)
            alive = stats[width][0] @ _statistics(wide, levels[0]).T >= best.least[:, None] - slack
            alive &= q_ids[:, None] != ids[None, :]
            for level, s in zip(stats[width][1:], levels[1:], strict=True):
                if alive.mean() < 0.02:
                    break
                alive &= level @ _statistics(wide, s).T >= best.least[:, None] - slack
            if alive.any():
                qi, ci, score = _exact(a, part, alive)
                good = score >= best.least[qi]
                best.add(qi[good], ids[ci[good]], score[good])
    return best


def _meet(queries: pa.Table, span: pa.Table, k: int) -> pa.Table:
    """A group of queries and a span of rows."""
    out = []
    if queries.num_rows and span.num_rows:
        (q_ids, q), own = unpack(queries), [unpack(span)]
        for a in range(0, len(q_ids), QUERY_BLOCK):
            part = q_ids[a : a + QUERY_BLOCK]
            best = search(part, q[a : a + QUERY_BLOCK], own, k)
            if (np.abs(best.score) == _SCORE).any():
                raise ValueError("an inner product among the largest doesn't fit a long")
            out.append(pa.table({"query_id": part[best.query], "vec_id": best.id, "score": best.score}))
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
    return pa.concat_tables([empty, *out])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest integer products for each query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``query_step``; candidates all rows but those with the
    query's own id.  Rows without an id, with a null vector, or with a null or non-finite component take no
    part.  Repeated rows (same id and vector) count once, rows of one id with different vectors each for
    themselves.  Vectors of different lengths meet as if zeros followed the shorter one.  Other columns are not read.
    A component beyond 2**62 after scaling raises, and so does a product among the largest of a span that doesn't fit a long.
    """
    own = quantised(vectors, id_col, vector_col, scale).dropDuplicates()
    asked = F.count_if(vectors[id_col].cast("long") % query_step == 0)
    n, n_queries, width = vectors.agg(F.count("*"), asked, F.max(F.size(vectors[vector_col]))).first()
    bytes_ = 8 * max(width or 0, 1)
    spans = max(1, -(-n // max(1, min(SPAN, SPAN_BYTES // bytes_))))
    groups = max(1, -(-n_queries // max(1, min(QUERY_GROUP, SPAN_BYTES // bytes_))))

    def deal(what: str, parts: int):
        return F.pmod(F.xxhash64(F.lit(what), "vec_id", "v"), F.lit(parts)).cast("int")

    def every(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    rows = own.select("vec_id", "v", deal("span", spans).alias("span"), every(groups).alias("group"))
    queries = own.filter(F.col("vec_id") % query_step == 0).select("vec_id", "v", deal("group", groups).alias("group"), every(spans).alias("span"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet(left, right, k)

    met = queries.groupBy("span", "group").cogroup(rows.groupBy("span", "group")).applyInArrow(meet, "query_id long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
