"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +-1; a letter trigram is its three letter vectors,
permuted by place (cyclic shifts by 2, 1 and 0) and bound by multiplication;
a text is the bundle (sum) of the vectors of its trigrams, and a language the
bundle of its documents, each scaled to length one.  A text gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, spare
from .words import slices

DIM, SEED, SPACE = 512, 97, 32
#: Documents that learning uses for each language, at most: the bound of the labelled sample.
TRAIN_PER_LANG = 3000
UNKNOWN = "und"
#: Documents bundled at once.
_BLOCK = 48
_lower: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _lower:
        out = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                out[c] = ord(x.lower()[0])
        _lower.append(out)
    return _lower[0]


def letter_vectors(codes: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """A row of +-1 for each code point; it depends on the code point and seed alone."""
    out = np.empty((len(codes), dim), np.int8)
    for i, c in enumerate(codes.tolist()):
        out[i] = np.random.Generator(np.random.PCG64([seed, c])).integers(0, 2, dim, np.int8) * 2 - 1
    return out


class Encoder:
    """Turns texts into bundles; keeps the vectors of letters seen."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.row: dict[int, np.ndarray] = {}

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        fresh = [c for c in codes.tolist() if c not in self.row]
        if fresh:
            self.row.update(zip(fresh, letter_vectors(np.array(fresh), self.dim, self.seed), strict=True))
        return np.array([self.row[c] for c in codes.tolist()], np.int8).reshape(-1, self.dim)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes (three of 21 bits) and counts of the distinct letter trigrams; runs of other characters are one space."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        x = _letters()[points].astype(np.uint64)
        space = x == SPACE
        if space.all():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keep = ~space
        keep[1:] |= ~space[:-1]
        x = np.concatenate([[np.uint64(SPACE)], x[keep] if not space[0] else x[keep][0:], [np.uint64(SPACE)]])
        x = x[np.concatenate([[True], (x[1:] != SPACE) | (x[:-1] != SPACE)])]
        return np.unique(x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:], return_counts=True)

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, and whether it has a letter."""
        out, has = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        for a in range(0, len(texts), _BLOCK):
            got = [self.trigrams(t or "") for t in texts[a : a + _BLOCK]]
            grams, where = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
            if not len(grams):
                continue
            doc = np.repeat(np.arange(len(got)), [len(g) for g, _ in got])
            n = np.concatenate([c for _, c in got])
            mask = np.uint64((1 << 21) - 1)
            letters = np.unique(np.concatenate([grams >> np.uint64(42), grams >> np.uint64(21) & mask, grams & mask]))
            rows = self._vectors(letters)
            places = [np.roll(rows, 2, axis=1), np.roll(rows, 1, axis=1), rows]
            for b in range(0, len(grams), 4096):
                part = grams[b : b + 4096]
                bound = places[0][np.searchsorted(letters, part >> np.uint64(42))] * places[1][np.searchsorted(letters, part >> np.uint64(21) & mask)] * places[2][np.searchsorted(letters, part & mask)]
                inside = (where >= b) & (where < b + len(part))
                counts = np.zeros((len(got), len(part)), np.float32)
                counts[doc[inside], where[inside] - b] = n[inside]
                out[a : a + len(got)] += counts @ bound.astype(np.float32)
            has[a : a + len(got)] = [len(g) > 0 for g, _ in got]
        return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _profiles(batches, text: str, lang: str, dim: int, seed: int):
    """One row a task and language: the sum of its documents' unit vectors."""
    encoder, total = Encoder(dim, seed), {}
    for part in slices(batches, text):
        vectors, has = encoder.bundle(part.column(text).to_pylist())
        for name, v, ok in zip(part.column(lang).to_pylist(), _unit(vectors), has, strict=True):
            if ok:
                total[name] = total.get(name, 0) + v.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = TRAIN_PER_LANG, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from about ``per_lang`` documents of each language.

    The sample is the documents whose hashed id falls below the share per_lang / n of
    the language's n documents, so it is bounded whatever the size of the input, and
    whole texts are learned.  Null langs take no part; rows without an id are chosen by the hash of their text.
    """
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    share = {r["lang"]: per_lang / r["n"] for r in two.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not share:
        return [], np.zeros((0, dim))
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(min(v, 1.0)))])[F.col("lang")]
    sample = two.filter(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1_000_000)) < limit * 1_000_000)
    # at most one row for each language and task of a bounded sample
    rows = sample.mapInArrow(partial(_profiles, text="text", lang="lang", dim=dim, seed=seed), "lang string, v array<double>")
    rows = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["lang"] for r in rows})
    at, out = {n: i for i, n in enumerate(names)}, np.zeros((len(names), dim))
    for r in rows:
        out[at[r["lang"]], r["i"]] = r["x"]
    return names, _unit(out)


def _scores(encoder: Encoder, texts: list, names: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    vectors, has = encoder.bundle(texts)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cosine = _unit(vectors).astype(np.float64) @ prototypes.T
    best = cosine.argmax(axis=1)
    return [names[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0.0)


def _predict(batches, text: str, pred: str, score: str, drop: bool, names: list[str], prototypes: np.ndarray, dim: int, seed: int):
    encoder = Encoder(dim, seed)
    for part in slices(batches, text):
        lang, value = _scores(encoder, part.column(text).to_pylist(), names, prototypes)
        own = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if not (drop and n == text)]
        yield pa.RecordBatch.from_arrays([*(c for _, c in own), pa.array(lang, pa.string()), pa.array(value, pa.float64())], names=[*(n for n, _ in own), pred, score])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep_text: bool = True, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the cosine, 0 to 1) to every row; no shuffle.

    Null texts and texts without a letter, or an empty model, get ``und`` and 0.  The new
    columns get underscores in front where ``docs`` has such names.  Ties go to the
    language that sorts first.
    """
    pred, score = spare(docs, "lang_pred", "score")
    names, prototypes = model
    schema = extended(docs.schema, **{pred: "string", score: "double"})
    if not keep_text:
        schema = type(schema)([f for f in schema if f.name != text_col])
    return docs.mapInArrow(partial(_predict, text=text_col, pred=pred, score=score, drop=not keep_text, names=names, prototypes=prototypes, dim=dim, seed=seed), schema)


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], min_cosine: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows with a predicted language and a cosine of at least ``min_cosine``; ``lang_col`` becomes the prediction.

    An empty model can't tell languages apart: then rows with a letter stay, and ``lang_col`` as it was.
    """
    if not model[0]:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    own = predict(docs, model, text_col)
    pred, score = own.columns[-2:]
    kept = own.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= min_cosine))
    return kept.select(*[F.col(pred).alias(c) if c == lang_col else c for c in docs.columns])
