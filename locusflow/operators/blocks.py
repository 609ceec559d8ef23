"""Replicates of individuals that stay in blocks: shuffled population labels and bootstrap weights, computed and not sorted.

Individuals are numbered so that populations lie one after another; what a replicate does to individual i follows from i, the populations'
sizes and a key of (seed, replicate).  No task needs to know of individuals in other blocks: each block
counts the alleles that its individuals bring to each population, and blocks' counts are added.

* Shuffled labels: a permutation of the numbers by a Feistel network (from ``LISTED`` individuals on) tells the place, and so the new population.
* Weights of a bootstrap within populations: a population's draws are split between halves of its individuals by binomial numbers, and so on down to leaves of
  ``LEAF`` individuals, which draw one by one.  A split is keyed by its node, so weights don't depend on blocks and add up to the population's size.

Up to ``BLOCK_CELLS`` genotypes (and ``kernel.MAX_CELLS``) the whole matrix is one block that goes to all tasks, which share the replicates.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import valid
from . import resample
from .margins import CHUNK, MAX_TASKS, STATISTICS, generator, statistics

#: Rounds of a network, individuals whose permutations are listed instead, and individuals of a leaf of splits.
ROUNDS, LISTED, LEAF = 8, 100_000, 4096
#: Genotypes of a block on average, loci of a block at most, bytes of counts that are sent on together, parts of all blocks' replicates that there should be at least, and individuals up to which tables of labels are looked up rather than searched.
BLOCK_CELLS, BLOCK_LOCI, BLOCK_BYTES, BLOCK_TASKS, LOOKED_UP = 2_000_000, 256, 16 << 20, 96, 20_000_000
#: Numbers that a network permutes at once, joint genotypes x populations that are counted together, and replicates whose weights are held at once.
TILE, JOINT, WEIGHED_REPS = 16_384, 65_536, 32
#: Alleles of all loci together, whose codes go to all tasks.
MAX_ALLELES = 1_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _below(x: np.ndarray, key: np.uint64, limit: np.uint64) -> np.ndarray:
    """A number under the limit that looks random."""
    z = (x + key) * _M1
    z ^= z >> np.uint64(29)
    z *= _M2
    z >>= np.uint64(32)
    return (z * limit) >> np.uint64(32)


def keys(seed, rep: int) -> np.ndarray:
    return generator(seed, "labels", rep).integers(0, 1 << 64, ROUNDS, np.uint64, endpoint=False)


def moved(i: np.ndarray, n: int, seed, rep: int, limit: int = LISTED) -> np.ndarray:
    """Where a replicate puts each of i: by a network, or by a list of all where these are few (``limit``), as a network's parts would be too small to mix well."""
    return generator(seed, "labels", rep).permutation(n)[i] if n <= limit else places(i, n, keys(seed, rep))


def places(i: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where a permutation of 0..n-1 puts each of i.

    Numbers are split as i = left * b + right with a * b just above n; rounds add to one part what a hash makes of the other.  What falls
    beyond n goes round again.  A part has few values, so what a round makes of them is listed where there are more numbers than that, and numbers go by tiles that stay in the processor's cache.
    """
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // max(a, 1))
    a_, b_, top = np.uint64(a), np.uint64(b), np.uint64(n)
    limits = [a_, b_] * (ROUNDS // 2)
    listed = [_below(np.arange(b if limit is a_ else a, dtype=np.uint64), key[r], limit) for r, limit in enumerate(limits)] if len(i) > a else None

    def added(r: int, x: np.ndarray) -> np.ndarray:
        return _below(x, key[r], limits[r]) if listed is None else listed[r].take(x.view(np.int64))

    def once(x: np.ndarray) -> np.ndarray:
        left = x // b_
        right = x - left * b_
        for r in range(0, ROUNDS, 2):
            left += added(r, right)
            # below zero wraps around to more than any part
            np.minimum(left, left - a_, out=left)
            right += added(r + 1, left)
            np.minimum(right, right - b_, out=right)
        left *= b_
        left += right
        return left

    numbers = np.ascontiguousarray(i, np.uint64)
    whole = np.empty(len(numbers), np.uint64)
    for start in range(0, len(numbers), TILE):
        out = once(numbers[start : start + TILE])
        while (far := np.flatnonzero(out >= top)).size:
            out[far] = once(out[far])
        whole[start : start + TILE] = out
    return whole.view(np.int64)


class Labels:
    """The populations' sizes, in order."""

    def __init__(self, pops: list[str], sizes: np.ndarray):
        self.pops, self.edge = pops, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n = int(self.edge[-1])

    def of(self, place: np.ndarray) -> np.ndarray:
        return self.table[place] if self.table is not None else np.searchsorted(self.edge, place, side="right") - 1

    @functools.cached_property
    def table(self) -> np.ndarray | None:
        """The population of each place, made where it is used."""
        return np.repeat(np.arange(len(self.pops), dtype=np.min_scalar_type(len(self.pops))), np.diff(self.edge)) if self.n <= LOOKED_UP else None


def shuffled(own: Labels, numbers: np.ndarray, seed, rep: int, limit: int = LISTED) -> tuple[np.ndarray, np.ndarray | None]:
    """The new population of each individual; each counts once."""
    return own.of(moved(numbers, own.n, seed, rep, limit)), None


def _split(draws: int, low: int, high: int, size: int, first: int, last: int, key: tuple, out: dict, leaf: int) -> None:
    """Adds to ``out`` how many of the draws fall to each leaf from ``first`` to ``last``; leaves low..high-1 hold the individuals below ``size``."""
    if high - low == 1:
        out[low] = draws
        return
    middle = (low + high) // 2
    left = (middle - low) * leaf
    whole = min(high * leaf, size) - low * leaf
    mine = int(generator(*key, low, high).binomial(draws, left / whole))
    if first < middle:
        _split(mine, low, middle, size, first, last, key, out, leaf)
    if last >= middle:
        _split(draws - mine, middle, high, size, first, last, key, out, leaf)


def weighed(own: Labels, numbers: np.ndarray, seed, rep: int, limit: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The population of each individual, and how often it is drawn among as many as its population has; leaves are of ``limit`` individuals."""
    order = np.argsort(numbers, kind="stable")
    sorted_, drawn = numbers[order], np.zeros(len(numbers))
    edge = np.searchsorted(sorted_, own.edge)
    for p in np.flatnonzero(np.diff(edge)).tolist():
        rank, part = sorted_[edge[p] : edge[p + 1]] - own.edge[p], drawn[edge[p] : edge[p + 1]]
        first, last = int(rank[0]) // limit, int(rank[-1]) // limit
        size, key, counts = int(own.edge[p + 1] - own.edge[p]), (seed, "weights", rep, own.pops[p]), {}
        _split(size, 0, -(-size // limit), size, first, last, key, counts, limit)
        cut = np.searchsorted(rank, np.arange(first, last + 2) * limit)
        for x, draws in counts.items():
            mine, there = slice(cut[x - first], cut[x - first + 1]), min(limit, size - x * limit)
            part[mine] = np.bincount(generator(*key, x).integers(0, there, draws), minlength=there)[rank[mine] - x * limit]
    weight = np.empty(len(numbers))
    weight[order] = drawn
    return own.of(numbers), weight


def _room(reps, p: int, loci: list) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.zeros((len(reps), p, k), np.int32), np.zeros((len(reps), p, k), np.int32)) for *_, k in loci]


def _joint(size: int, p: int, loci: list):
    """Loci whose genotypes are counted together: the joint code of each individual (times populations), the number of codes of each locus, and for each locus its number, and the copies and carriers of its codes (0: no genotype)."""
    most = min(JOINT, size // 2)
    out = []
    for j, (rows, x, y, k) in enumerate(loci):
        kind, code = np.unique(np.minimum(x, y).astype(np.int64) * k + np.maximum(x, y), return_inverse=True)
        first, second, at = kind // k, kind % k, np.arange(1, len(kind) + 1)
        both = np.zeros((len(kind) + 1, 2, k))
        for v in (first, second):
            both[at, 0, v] += 1
            both[at[first != second], 1, v[first != second]] = 1
        own = np.zeros(size, np.int64)
        own[rows] = code + 1
        many = len(kind) + 1
        if out and many * p * int(np.prod(out[-1][1])) <= most:
            codes, shape, members = out[-1]
            out[-1] = (codes * many + own, [*shape, many], [*members, (j, both)])
        else:
            out.append((own, [many], [(j, both)]))
    return [(codes * p, shape, members) for codes, shape, members in out]


def by_labels(own: Labels, numbers: np.ndarray, loci: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed, reps, limit: int | None = None):
    """For each locus copies and heterozygous carriers of ``shuffled`` individuals, both replicates x populations x alleles.

    ``numbers`` are individuals; a locus has rows into these, two allele codes and how many alleles there are.
    """
    p, size = len(own.pops), len(numbers)
    out, groups, place = _room(reps, p, loci), _joint(size, p, loci), np.empty(size, np.int64)
    for r, rep in enumerate(reps):
        label, _ = shuffled(own, numbers, seed, int(rep), LISTED if limit is None else limit)
        for codes, shape, members in groups:
            np.add(codes, label, out=place)
            t = np.bincount(place, minlength=int(np.prod(shape)) * p).reshape(*shape, p)
            for axis, (j, both) in enumerate(members):
                others = tuple(v for v in range(len(shape)) if v != axis)
                got = np.rint(t.sum(axis=others).T @ both.reshape(len(both), -1)).reshape(p, 2, -1)
                out[j][0][r], out[j][1][r] = got[:, 0], got[:, 1]
    return out


def by_weights(own: Labels, numbers: np.ndarray, loci: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed, reps, limit: int | None = None):
    """As ``by_labels``, of individuals as ``weighed``: products of weights with what each individual carries, for some replicates at once."""
    order = np.argsort(numbers, kind="stable")
    numbers, back = numbers[order], np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    start = np.concatenate([[0], np.cumsum([2 * k for *_, k in loci])]).astype(np.int64)
    carried = np.zeros((len(numbers), start[-1]), np.uint8)
    for (rows, x, y, k), at in zip(loci, start.tolist()):
        row, het = back[rows], x != y
        for v in (x, y):
            carried[row, at + v] += 1
            carried[row[het], at + k + v[het]] = 1
    edge = np.searchsorted(numbers, own.edge)
    out = _room(reps, len(own.pops), loci)
    for r in range(0, len(reps), WEIGHED_REPS):
        some = reps[r : r + WEIGHED_REPS]
        w = np.empty((len(some), len(numbers)), np.float32)
        for i, rep in enumerate(some):
            w[i] = weighed(own, numbers, seed, int(rep), LEAF if limit is None else limit)[1]
        for p in np.flatnonzero(np.diff(edge)).tolist():
            got = np.zeros((len(some), start[-1]))
            for a in range(edge[p], edge[p + 1], LEAF):
                mine = slice(a, min(a + LEAF, edge[p + 1]))
                # sums of whole numbers, exact in 32 bits as they stay below 2**24
                got += w[:, mine] @ carried[mine].astype(np.float32)
            for j, (*_, k) in enumerate(loci):
                both = np.rint(got[:, start[j] : start[j + 1]])
                out[j][0][r : r + len(some), p], out[j][1][r : r + len(some), p] = both[:, :k], both[:, k:]
    return out


# -- one block for all ------------------------------------------------------------------------


def from_matrix(m) -> tuple[Labels, np.ndarray, list]:
    """The numbers of the individuals of a ``kernel.Matrix``, and its loci as ``tally`` takes them."""
    order = np.argsort(m.pop, kind="stable")
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.arange(len(order))
    loci = []
    for j in range(len(m.loci)):
        rows = np.flatnonzero(m.a1[:, j] >= 0)
        loci.append((rows, m.a1[rows, j], m.a2[rows, j], m.k[j]))
    return Labels(m.pops, np.bincount(m.pop, minlength=m.n_pops)), numbers, loci


def _chunk(n: int, chunk: int) -> np.ndarray:
    return np.arange(1 + chunk * CHUNK, min(n, (chunk + 1) * CHUNK) + 1)


def small(spark, m, n: int, seed, make, schema: str, tally=by_labels) -> DataFrame:
    """``make(locus number, replicates, copies, carriers)`` of each locus and chunk, from the matrix."""
    own, numbers, loci = from_matrix(m)
    shared = spark.sparkContext.broadcast((own, numbers, loci))  # the matrix is checked

    def run(batches):
        own, numbers, loci = shared.value
        for pdf in batches:
            for chunk in pdf["id"].tolist():
                reps = _chunk(n, chunk)
                for j, (c, h) in enumerate(tally(own, numbers, loci, seed, reps)):
                    yield make(j, reps, c, h)

    chunks = -(-n // CHUNK)
    return spark.range(0, chunks, 1, max(1, min(chunks, MAX_TASKS))).mapInPandas(run, schema)


# -- blocks -----------------------------------------------------------------------------------


class Coded:
    """Populations, loci and alleles of a table in order, which are few beside its genotypes."""

    def __init__(self, geno: DataFrame):
        own = geno.withColumn("pop", F.col("pop").cast("string"))
        sizes = {r["pop"]: r["n"] for r in own.select("indiv", "pop").distinct().groupBy("pop").agg(F.count("*").alias("n")).collect()}  # a row for each population
        self.labels = Labels(sorted(sizes), np.array([sizes[p] for p in sorted(sizes)], np.int64))
        found = geno.filter(valid()).select("locus", F.explode(F.array("a1", "a2")).alias("allele")).distinct().limit(MAX_ALLELES + 1).collect()
        if len(found) > MAX_ALLELES:
            raise ValueError(f"more than {MAX_ALLELES} alleles")
        self.loci = [r["locus"] for r in geno.select("locus").distinct().orderBy("locus").collect()]
        named = {x: [] for x in self.loci}
        for r in found:
            named[r["locus"]].append(r["allele"])
        self.alleles = [np.array(sorted(named[x]), np.int64) for x in self.loci]


def blocked(geno: DataFrame, n: int, seed, coded: Coded, make, schema: str, tally=by_labels) -> DataFrame:
    """``make`` as in ``small``, from genotypes in blocks of individuals and loci."""
    spark, own = geno.sparkSession, coded.labels
    shared = spark.sparkContext.broadcast((own, coded.alleles))  # MAX_ALLELES bounds it
    people = geno.select("indiv", F.col("pop").cast("string").alias("pop")).distinct()
    number = dict(geno.dtypes)["indiv"] in ("tinyint", "smallint", "int", "bigint")
    key = resample._hex(F.col("indiv").cast("long")) if number else F.hex(F.col("indiv").cast("string"))
    top = int(np.diff(own.edge).max(initial=0))
    ranks = resample.ranked(people.withColumn("_k", key), ["pop"], "_k", ["indiv"], "_r", resample.digits_for(top))
    starts = spark.createDataFrame(list(zip(own.pops, own.edge[:-1].tolist(), strict=True)), "pop string, _start long")
    numbered = ranks.join(starts, "pop").select("indiv", F.col("pop").alias("_pop"), (F.col("_start") + F.col("_r") - 1).alias("i"))
    names = spark.createDataFrame(list(zip(coded.loci, range(len(coded.loci)), strict=True)), geno.select("locus", F.lit(0).alias("j")).schema)
    cells = geno.filter(valid()).select("indiv", F.col("pop").cast("string").alias("_pop"), "locus", F.col("a1").cast("long").alias("a1"), F.col("a2").cast("long").alias("a2"))
    wide = min(len(coded.loci), BLOCK_LOCI)
    size = max(1, BLOCK_CELLS // max(wide, 1))
    chunks = -(-n // CHUNK)
    every = -(-own.n // size) * -(-len(coded.loci) // BLOCK_LOCI)
    # each part of a block makes some of its chunks
    parts = max(1, min(chunks, -(-BLOCK_TASKS // max(every, 1))))
    # codes of alleles, and none as -1
    kind = np.min_scalar_type(-max((len(a) for a in coded.alleles), default=0) - 1)
    rows = cells.join(numbered, ["indiv", "_pop"]).join(names, "locus").select("i", "j", "a1", "a2", F.floor(F.col("i") / size).alias("block"), F.floor(F.col("j") / BLOCK_LOCI).alias("lb"))

    def pack(key, t):
        _, alleles = shared.value
        i, j, a1, a2 = (t.column(c).to_numpy() for c in ("i", "j", "a1", "a2"))
        numbers, row = np.unique(i, return_inverse=True)
        present = np.unique(j)
        packed = np.full((2, len(present), len(numbers)), -1, kind)
        for at, x in enumerate(present.tolist()):
            mine = np.flatnonzero(j == x)
            for v, a in enumerate((a1, a2)):
                packed[v, at, row[mine]] = np.searchsorted(alleles[x], a[mine])
        return pa.table({"block": [key[0].as_py()], "lb": [key[1].as_py()], "i": [numbers.tobytes()], "j": pa.array([present.tolist()], pa.list_(pa.int32())), "packed": [packed.tobytes()]})

    def count(batches):
        own, alleles = shared.value
        for batch in batches:
            for t in batch.to_pylist():
                numbers, present, loci = np.frombuffer(t["i"], np.int64), t["j"], []
                for x, (a1, a2) in zip(present, np.frombuffer(t["packed"], kind).reshape(2, len(present), -1).transpose(1, 0, 2), strict=True):
                    there = np.flatnonzero(a1 >= 0)
                    loci.append((there, a1[there].astype(np.int64), a2[there].astype(np.int64), len(alleles[x])))
                out, held = [], 0
                for chunk in range(t["part"], chunks, parts):
                    for x, (c, h) in zip(present, tally(own, numbers, loci, seed, _chunk(n, chunk)), strict=True):
                        out.append((x, chunk, c.ravel(), h.ravel()))
                        held += c.nbytes + h.nbytes
                    if held > BLOCK_BYTES or chunk + parts >= chunks:
                        yield pa.RecordBatch.from_arrays([pa.array(v, kind_) for v, kind_ in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), *2 * [pa.list_(pa.int32())]), strict=True)], ["j", "chunk", "c", "h"])
                        out, held = [], 0

    def add(key, t):
        own, alleles = shared.value
        j, chunk = (x.as_py() for x in key)
        reps, k = _chunk(n, chunk), len(alleles[j])
        shape = (len(reps), len(own.pops), k)
        c, h = (sum(x.values.to_numpy().astype(np.int64) for x in t.column(v)).reshape(shape) for v in "ch")
        return pa.Table.from_pandas(make(j, reps, c, h), preserve_index=False)

    blocks = rows.repartition(max(1, min(every, MAX_TASKS)), "block", "lb").groupBy("block", "lb").applyInArrow(pack, "block long, lb long, i binary, j array<int>, packed binary")
    # more tasks than parts, so that few parts share one
    work = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(1, min(2 * every * parts, MAX_TASKS)), "block", "lb", "part")
    counted = work.mapInArrow(count, "j int, chunk int, c array<int>, h array<int>")
    return counted.groupBy("j", "chunk").applyInArrow(add, schema)


# -- what is made of the counts -----------------------------------------------------------------


def permute(geno: DataFrame, n: int, seed, collected=None) -> DataFrame:
    """``rep, locus, fst, fit, fis, g`` of n shuffles; ``collected`` is the matrix where there is one."""
    kind = geno.schema["locus"].dataType.simpleString()
    schema = f"rep long, locus {kind}, " + ", ".join(f"{v} double" for v in STATISTICS)
    coded = None if collected else Coded(geno)
    loci = collected.loci if collected else coded.loci

    def make(j, reps, c, h) -> pd.DataFrame:
        return pd.DataFrame({"rep": reps, "locus": loci[j], **statistics(c.astype(np.int64), h.sum(axis=1))})

    tally = _bounded(by_labels)
    out = small(geno.sparkSession, collected, n, seed, make, schema, tally) if collected else blocked(geno, n, seed, coded, make, schema, tally)
    return out.select("rep", "locus", *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in STATISTICS])


def _bounded(tally):
    """The tally with its bound as it is on the driver."""
    return functools.partial(tally, limit=LISTED if tally is by_labels else LEAF)


def counted(geno: DataFrame, n: int, seed, collected=None, tally=by_labels) -> DataFrame:
    """``counts.allele_counts`` with ``rep`` of n shuffles, or of n bootstraps where ``tally`` is ``by_weights``."""
    kind = {f.name: f.dataType.simpleString() for f in geno.schema.fields}
    coded = None if collected else Coded(geno)
    loci, alleles = (collected or coded).loci, (collected or coded).alleles
    pops = np.array(collected.pops if collected else coded.labels.pops, object)

    def make(j, reps, c, h) -> pd.DataFrame:
        r, p, a = np.nonzero(c)
        return pd.DataFrame({"rep": reps[r], "locus": loci[j], "pop": pops[p], "allele": alleles[j][a], "c": c[r, p, a].astype(np.int64), "h": h[r, p, a].astype(np.int64)})

    schema, tally = f"rep long, locus {kind['locus']}, pop string, allele long, c long, h long", _bounded(tally)
    out = small(geno.sparkSession, collected, n, seed, make, schema, tally) if collected else blocked(geno, n, seed, coded, make, schema, tally)
    return out.select("rep", "locus", F.col("pop").cast(kind["pop"]).alias("pop"), F.col("allele").cast(kind["a1"]).alias("allele"), "c", "h")
