"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two tokens is the gap-weighted subsequence kernel of order 3 over their
letters (each common subsequence counts ``DECAY`` to the power of the letters it
spans), scaled so that equal tokens have 1.  Characters that are put between the
letters of an insult, or left out, thus lower the similarity a little instead of losing it.
Signs, digits, typographic punctuation and combining marks are no letters, and runs of three or more one-letter words are one token.  Letters beyond a to z
are coded by their code points, in lower case for the scripts that have it, modulo ``OTHERS``, so alphabets of neighbouring code points keep their letters apart.
A mark before the first letter counts as a letter; tokens of over eight letters are cut into
overlapping pieces.

Landmarks are tokens and beginnings of tokens that the labelled sample ties to toxic
documents, by occurring in them at all or by occurring twice, each unlike the ones before it.  A sentence has for each landmark its largest kernel value over the sentence's
tokens (values under ``FLOOR`` count as 0), and K**-1/2 of the landmarks'
kernel matrix turns these into coordinates, where a linear SVM separates
the sentences.  Labels mark documents, so a toxic document stands for its worst
sentence, chosen anew in each round.

A document has the margin of its worst sentence, and for each landmark the sum of the kernel values
of ``NEAR`` or more over all of its tokens, both as a logarithm and in proportion to the root of its words:
a beginning that clean documents have by chance tells toxic ones by how often it comes, and long clean documents don't add up to toxic ones.
A second linear SVM over these gives the score; its cut comes from documents that it didn't learn from (five folds).
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, spare
from .words import Words, slices

ORDER, DECAY, FLOOR = 3, 0.6, 0.45
#: The least kernel value that counts towards a document's sums.
NEAR = 0.7
#: Letters of a token; longer ones are cut into overlapping pieces.
PIECE = 8
#: Bits of a code, and codes for letters beyond a to z (from 27 on).
BITS, OTHERS = 6, 36
#: The code that stands before a token's first letter, and the letters of the beginnings that may be landmarks.
BEGIN, STEMS = 63, (3, 4, 5, 6, 7, 8)
MARKS = 32
#: Bounds of the labelled sample: documents of each label, and bytes of a text.
TRAIN_PER_LABEL, TRAIN_BYTES = 2000, 30_000
THRESHOLD = 0.7
#: The least share of the toxic documents that a landmark occurs in.
MIN_SHARE = 0.02
#: Weight of the sample's loss against the margin, of sentences and of documents, and folds.
COST, DOCUMENT_COST, FOLDS = 20_000, 100, 5
#: How much a false alarm weighs against a miss.
CARE = 5

_CODE = np.zeros(256, np.uint8)
_CODE[np.arange(65, 91)] = _CODE[np.arange(97, 123)] = np.arange(1, 27)
#: Ranges of code points that are no letters (fixed values): multiplication and division signs, combining marks, general and CJK punctuation, half-width punctuation, variation selectors, pictures.
_NO_LETTERS = ((0xD7, 0xD7), (0xF7, 0xF7), (0x300, 0x36F), (0x2000, 0x206F), (0x3000, 0x303F), (0xFE00, 0xFE0F), (0xFF00, 0xFF0F), (0x1F000, 0x1FAFF))
#: Capitals and how far their small letters lie behind (fixed values): Latin-1, Greek, Cyrillic, its extensions, Armenian.
_CAPITALS = ((0xC0, 0xDE, 32), (0x391, 0x3A9, 32), (0x410, 0x42F, 32), (0x400, 0x40F, 80), (0x531, 0x556, 48))
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?", np.uint8)] = True


class Model(NamedTuple):
    """Sentences: ``root``, ``weights``, ``bias``. Documents: ``middle`` and ``spread`` of their features, ``outer`` weights and ``offset``. ``slope`` and ``cut`` make the score."""

    landmarks: list[str]
    root: np.ndarray
    weights: np.ndarray
    bias: float
    middle: np.ndarray
    spread: np.ndarray
    outer: np.ndarray
    offset: float
    slope: float
    cut: float


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All choices of three of n places, and DECAY to the power of what each spans."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, np.float64(DECAY) ** (at[:, -1] - at[:, 0] + 1)


_TRIPLES = [_triples(n) for n in range(PIECE + 2)]


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of equal length (a row each): the codes of their subsequences, and their weights."""
    at, weight = _TRIPLES[codes.shape[1]]
    c = codes.astype(np.int64)
    return c[:, at[:, 0]] << 2 * BITS | c[:, at[:, 1]] << BITS | c[:, at[:, 2]], weight


def _norms(codes: np.ndarray) -> np.ndarray:
    """The kernel of each token with itself."""
    sub, weight = _subsequences(codes)
    order = np.argsort(sub, axis=1, kind="stable")
    ranked, w = np.take_along_axis(sub, order, 1), weight[order]
    new = np.ones(ranked.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    total = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    row = np.repeat(np.arange(len(codes)), new.sum(axis=1))
    return np.bincount(row, total * total, minlength=len(codes))


def spell(codes: np.ndarray) -> list[str]:
    """A character for each code, ``a`` to ``z`` for these letters."""
    return [bytes(c + 96).decode("latin-1") for c in codes]


def unspell(word: str) -> np.ndarray:
    """One row: the codes of a spelled landmark, after the mark of a beginning."""
    return np.array([[BEGIN, *(ord(c) - 96 for c in word)]], np.uint8)


class Kernel:
    """Kernel values of many tokens with all landmarks at once."""

    def __init__(self, landmarks: list[str]):
        m = len(landmarks)
        self.norm = np.ones(m)
        found = []
        for j, word in enumerate(landmarks):
            codes = unspell(word)
            found.append(_subsequences(codes))
            self.norm[j] = _norms(codes)[0]
        #: The row of the table of each subsequence that a landmark has, from 1; row 0 is of all others.
        self.slot = np.zeros(1 << 3 * BITS, np.int32)
        own = np.unique(np.concatenate([np.zeros(0, np.int64), *(sub[0] for sub, _ in found)]))
        self.slot[own] = np.arange(1, len(own) + 1)
        self.table = np.zeros((len(own) + 1, m), np.float32)
        for j, (sub, weight) in enumerate(found):
            np.add.at(self.table[:, j], self.slot[sub[0]], weight)

    def values(self, codes: np.ndarray, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, landmarks and kernel values that are ``floor`` or more, of tokens of equal length."""
        none = np.zeros(0, np.int64)
        if codes.shape[1] < ORDER or not len(codes) or not self.table.shape[1]:
            return none, none, none.astype(float)
        out = []
        for a in range(0, len(codes), 8192):
            part = codes[a : a + 8192]
            sub, weight = _subsequences(part)
            slot = self.slot[sub]
            hit_row, hit = np.nonzero(slot)
            raw = np.zeros((len(part), self.table.shape[1]), np.float32)
            if len(hit_row):
                rows, first = np.unique(hit_row, return_index=True)
                raw[rows] = np.add.reduceat(self.table[slot[hit_row, hit]] * weight[hit, None].astype(np.float32), first, axis=0)
            # a token's own kernel is at least that of distinct subsequences, so this leaves out nothing above the floor
            likely = raw >= floor * 0.999 * np.sqrt((weight**2).sum() * self.norm)
            rows = np.flatnonzero(likely.any(axis=1))
            if len(rows):
                value = raw[rows] / np.sqrt(_norms(part[rows])[:, None] * self.norm)
                i, j = np.nonzero(value >= floor)
                out.append((rows[i] + a, j, np.minimum(value[i, j], 1.0)))
        if not out:
            return none, none, none.astype(float)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def letters_of(buf: np.ndarray) -> np.ndarray:
    """The code of the letter that begins at each byte of UTF-8, 0 where none does."""
    code = _CODE[buf]
    lead = np.flatnonzero(buf >= 0xC3)  # those before are Latin-1 signs
    if len(lead):
        first = buf[lead].astype(np.int64)
        after = [buf[np.minimum(lead + k, len(buf) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | after[0], np.where(first < 0xF0, (first & 0xF) << 12 | after[0] << 6 | after[1], (first & 7) << 18 | after[0] << 12 | after[1] << 6 | after[2]))
        for a, b, shift in _CAPITALS:
            point[(point >= a) & (point <= b) & (point != 0xD7)] += shift
        own = 27 + point % OTHERS
        for a, b in _NO_LETTERS:
            own[(point >= a) & (point <= b)] = 0
        code[lead] = own
    return code


def tokens(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (word number of each token or piece, the codes of the distinct ones, and which of these each is)."""
    buf = words.buf
    code = letters_of(buf)
    at = np.flatnonzero(code)
    letters = code[at]
    first = np.searchsorted(at, words.start)
    count = np.searchsorted(at, words.end) - first
    word = np.arange(len(first))
    # spelled-out words: runs of three or more words of one letter each
    single = count == 1
    edge = np.diff(np.concatenate([[0], (single).astype(np.int8), [0]]))
    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
    runs = runs[runs[:, 1] - runs[:, 0] >= 3]
    if len(runs):
        doc = words.doc
        runs = np.array([(a, b) for lo, hi in runs.tolist() for a, b in _within(doc, lo, hi)], np.int64).reshape(-1, 2)
    if len(runs):
        # their letters lie side by side, as between two words of a run there are none
        first, count, word = np.concatenate([first, first[runs[:, 0]]]), np.concatenate([count, runs[:, 1] - runs[:, 0]]), np.concatenate([word, runs[:, 0]])
    long = np.flatnonzero(count > PIECE)
    extra = [(first[i] + o, word[i]) for i in long for o in [*range(PIECE // 2, int(count[i]) - PIECE, PIECE // 2), int(count[i]) - PIECE]]
    out = []
    for n in range(ORDER, PIECE + 1):
        own = np.flatnonzero(count == n if n < PIECE else count >= n)
        if len(own):
            out.append(_distinct(word[own], np.hstack([np.full((len(own), 1), BEGIN, np.uint8), letters[first[own][:, None] + np.arange(n)]])))
    if extra:
        f, w = (np.array(x, np.int64) for x in zip(*extra, strict=True))
        out.append(_distinct(w, letters[f[:, None] + np.arange(PIECE)]))
    return out


def _distinct(word: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.zeros(len(rows), np.uint64)  # BITS a code: 54 at most
    for j in range(rows.shape[1]):
        key = key << np.uint64(BITS) | rows[:, j]
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    return word, rows[one], which


def _within(doc: np.ndarray, lo: int, hi: int):
    """Cuts a run of words at the ends of documents."""
    cuts = [lo, *(np.flatnonzero(np.diff(doc[lo:hi])) + lo + 1).tolist(), hi]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a >= 3]


def sentences(words: Words) -> np.ndarray:
    """The sentence number of each word: a new one after a word that ends in ``.!?``, a line break, or the end of a document."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    breaks = np.concatenate([[0], np.cumsum(words.buf == 10)])
    new[1:] = _STOP[words.buf[words.end[:-1] - 1]] | (words.doc[1:] != words.doc[:-1]) | (breaks[words.start[1:]] != breaks[words.end[:-1]])
    return np.cumsum(new)


def sentence_features(words: Words, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and the landmark values of each sentence that has any; and each document's sums of the values of ``NEAR`` or more."""
    m = kernel.table.shape[1]
    sentence = sentences(words)
    near = np.zeros((len(words.count), m))
    where, mark, value = [], [], []
    for word, codes, which in tokens(words):
        row, j, v = kernel.values(codes)
        if not len(row):
            continue
        order = np.argsort(row, kind="stable")
        row, j, v = row[order], j[order], v[order]
        lo, hi = np.searchsorted(row, which), np.searchsorted(row, which, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        own = np.repeat(word, n)
        where.append(sentence[own])
        mark.append(j[at])
        value.append(v[at])
        np.add.at(near, (words.doc[own], j[at]), np.where(v[at] >= NEAR, v[at], 0.0))
    if not where:
        return np.zeros(0, np.int64), np.zeros((0, m)), near
    where, mark, value = map(np.concatenate, (where, mark, value))
    live, row = np.unique(where, return_inverse=True)
    out = np.zeros((len(live), m))
    np.maximum.at(out, (row, mark), value)
    return words.doc[np.searchsorted(sentence, live)], out, near


def document_features(worst: np.ndarray, near: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.hstack([worst[:, None], np.log1p(near), near / np.sqrt(n_words + 1)[:, None]])


def _vocabulary(batches, text: str, label: str):
    """The tokens and beginnings of each document, once each, and whether they come twice."""
    for part in slices(batches, text):
        words = Words(part.column(text))
        own = part.column(label).to_pylist()
        found: list[Counter] = [Counter() for _ in own]
        for word, codes, which in tokens(words):
            if codes[0, 0] != BEGIN:
                continue
            spelled = spell(codes[:, 1:])
            pair, n = np.unique(words.doc[word] * len(codes) + which, return_counts=True)
            for d, i, k in zip((pair // len(codes)).tolist(), (pair % len(codes)).tolist(), n.tolist(), strict=True):
                for x in {spelled[i], *(spelled[i][:n] for n in STEMS)}:
                    found[d][x] += k
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for f in found for t in f], pa.string()), pa.array([y for y, f in zip(own, found, strict=True) for _ in f], pa.int32()), pa.array([int(k > 1) for f in found for k in f.values()], pa.int32())],
            names=["token", "label", "again"],
        )


def _features(batches, text: str, label: str, landmarks: list[str]):
    """For each document its label, its words, its sums and its live sentences (both as doubles)."""
    kernel = Kernel(landmarks)
    for part in slices(batches, text):
        words = Words(part.column(text))
        doc, x, near = sentence_features(words, kernel)
        ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
        rows = [x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), part.column(label).cast(pa.int32()), pa.array(words.count, pa.int64()), pa.array([v.tobytes() for v in near], pa.binary()), pa.array(rows, pa.binary())],
            names=["key", "label", "n_words", "near", "x"],
        )


def sample(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``text, label, key`` of a bounded share of the labelled documents, chosen by hashed id; equal texts once, toxic if any of them is.

    ``docs`` has doc_id and text, ``labels`` has doc_id and toxic; null ids take no part.  ``key`` is the text's hash.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.when(F.col("label") == 1, F.lit(per_label / max(n.get(1, 0), 1))).otherwise(F.lit(per_label / max(n.get(0, 0), 1)))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("toxic sample"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    own = docs.filter(F.octet_length("text") <= max_bytes)
    few = chosen.limit(4 * per_label + 1).count() <= 4 * per_label  # about 2 * per_label; beyond that, texts are dealt by id
    own = own.join(F.broadcast(chosen) if few else chosen, "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    return own.withColumn("key", F.xxhash64("text"))


def choose_landmarks(vocabulary: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The tokens and beginnings whose presence, or presence twice, has the strongest ties (G statistic) to toxic documents."""
    label, again = F.col("label"), F.col("again")
    df = vocabulary.groupBy("token").agg(F.sum(label).alias("t"), F.sum(1 - label).alias("c"), F.sum(label * again).alias("t2"), F.sum((1 - label) * again).alias("c2"))
    total = n_toxic + n_clean

    def term(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    def tie(t, c):
        n = t + c
        g = 2 * (term(t, n * n_toxic / total) + term(c, n * n_clean / total) + term(n_toxic - t, (total - n) * n_toxic / total) + term(n_clean - c, (total - n) * n_clean / total))
        return F.when((t * n_clean > c * n_toxic) & (n < total), g).otherwise(0.0)

    rated = df.filter(F.col("t") / n_toxic >= MIN_SHARE).withColumn("g", F.greatest(tie(F.col("t"), F.col("c")), tie(F.col("t2"), F.col("c2")))).filter("g > 20")
    best = rated.orderBy(F.desc(F.round("g", 6)), F.desc(F.length("token")), "token").limit(50 * MARKS).collect()
    out: list[str] = []
    for token in (r["token"] for r in best):
        if len(out) < MARKS and not any(token.startswith(x) or x.startswith(token) for x in out) and not (out and len(Kernel(out).values(unspell(token), 0.6)[0])):
            out.append(token)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps in the primal."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        if np.allclose(new, w):
            break
        w = new
    return w[:-1], float(w[-1])


def _balanced(x: np.ndarray, y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """An SVM to which both labels, 1 and -1, weigh the same."""
    return _svm(x, y, np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * cost)


def fit(landmarks: list[str], bags: list[np.ndarray], near: np.ndarray, n_words: np.ndarray, y: np.ndarray, rounds: int = 4) -> Model:
    """The model of documents with label ``y`` (1 or -1; both occur): ``bags`` are the values of their live sentences."""
    kernel, m = Kernel(landmarks), len(landmarks)
    gram = np.zeros((m, m))
    for i, word in enumerate(landmarks):
        _, j, v = kernel.values(unspell(word), 0.0)
        gram[i, j] = v
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    own = [x @ root if len(x) else np.zeros((1, m)) for x in bags]
    toxic = np.flatnonzero(y > 0).tolist()
    clean = np.vstack([own[i] for i in np.flatnonzero(y < 0)])
    # sentences that hold a toxic landmark itself stand beside the worst ones
    plain = np.vstack([own[i][: len(bags[i])][bags[i].max(axis=1, initial=0) >= 0.9] for i in toxic])
    worst = [own[i][np.argmax(np.linalg.norm(own[i], axis=1))] for i in toxic]
    for _ in range(rounds):
        x = np.vstack([*worst, plain, clean])
        w, b = _balanced(x, np.concatenate([np.ones(len(worst) + len(plain)), -np.ones(len(clean))]), COST)
        worst = [own[i][np.argmax(own[i] @ w)] for i in toxic]
    x = document_features(np.array([(v @ w).max(initial=-np.inf) for v in own]) + b, near, n_words)
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = (x - middle) / spread
    outer, offset = _balanced(x, y, DOCUMENT_COST)
    f, fold = np.empty(len(y)), np.empty(len(y), np.int64)
    for side in (y > 0, y < 0):
        fold[side] = np.arange(side.sum()) % FOLDS
    for k in range(FOLDS):
        rest, part = fold != k, fold == k
        v, c = _balanced(x[rest], y[rest], DOCUMENT_COST) if (y[rest] > 0).any() and (y[rest] < 0).any() else (outer, offset)
        f[part] = x[part] @ v + c
    # the cut where the share of toxic documents caught, less CARE times that of clean ones, is largest; the middle of its gap gets the threshold
    ranked = np.argsort(-f, kind="stable")
    gain = np.cumsum(np.where(y[ranked] > 0, 1 / (y > 0).sum(), -CARE / (y < 0).sum()))
    gain[:-1][f[ranked][:-1] == f[ranked][1:]] = -np.inf  # equal values fall on one side
    k = int(gain.argmax())
    cut = (f[ranked[k]] + f[ranked[k + 1]]) / 2 if k + 1 < len(f) else f[ranked[k]]
    return Model(landmarks, root, w, b, middle, spread, outer, offset, 4.0 / max(float(f[ranked[: k + 1]].mean() - cut), 1e-6), float(cut))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, max_bytes: int = TRAIN_BYTES, rounds: int = 4) -> Model | None:
    """A model from the labelled documents; None, for which every score is 0, without documents of both labels or without landmarks."""
    own = sample(docs, labels, per_label, max_bytes).persist()
    try:
        n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            return None
        vocabulary = own.mapInArrow(partial(_vocabulary, text="text", label="label"), "token string, label int, again int")
        landmarks = choose_landmarks(vocabulary, n[1], n[0])
        if not landmarks:
            return None
        schema = "key long, label int, n_words long, near binary, x binary"
        rows = own.mapInArrow(partial(_features, text="text", label="label", landmarks=landmarks), schema).collect()  # bounded by the sample
    finally:
        own.unpersist()
    rows.sort(key=lambda r: (r["key"], r["x"]))
    m = len(landmarks)
    bags = [np.frombuffer(r["x"]).reshape(-1, m) for r in rows]
    near = np.array([np.frombuffer(r["near"]) for r in rows])
    return fit(landmarks, bags, near, np.array([r["n_words"] for r in rows], float), np.where([r["label"] == 1 for r in rows], 1, -1), rounds)


def margins(words: Words, model: Model, kernel: Kernel) -> np.ndarray:
    """The document SVM's value of each text."""
    doc, x, near = sentence_features(words, kernel)
    worst = np.full(len(words.count), model.bias)
    got = np.full(len(worst), -np.inf)
    np.maximum.at(got, doc, x @ (model.root @ model.weights) + model.bias)
    worst = np.where(np.isfinite(got), got, worst)
    return (document_features(worst, near, words.count) - model.middle) / model.spread @ model.outer + model.offset


def _score(batches, text: str, names: tuple[str, str], drop: bool, model: Model | None):
    kernel = Kernel(model.landmarks) if model else None
    for part in slices(batches, text):
        score = np.zeros(part.num_rows)
        if model:
            f = margins(Words(part.column(text)), model, kernel)
            score = 1 / (1 + np.exp(-np.clip(model.slope * (f - model.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
        own = [(a, c) for a, c in zip(part.schema.names, part.columns, strict=True) if not (drop and a == text)]
        yield pa.RecordBatch.from_arrays([*(c for _, c in own), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*(a for a, _ in own), *names])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) to every row; no shuffle.

    Null and empty texts score as a text without any token near a landmark.  The new
    columns get underscores in front where ``docs`` has such names.
    """
    names = tuple(spare(docs, "score", "predicted"))
    schema = extended(docs.schema, **{names[0]: "double", names[1]: "int"})
    if not keep_text:
        schema = type(schema)([f for f in schema if f.name != text_col])
    return docs.mapInArrow(partial(_score, text=text_col, names=names, drop=not keep_text, model=model), schema)
