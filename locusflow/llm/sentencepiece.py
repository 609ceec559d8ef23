"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A normalised text is cut where a piece never crosses (before each run of ``▁``), so a
text is a sequence of units of about a word, and distinct units are encoded once.
All units of equal length advance together: at each place, the substrings of every
length are hashed, the hashes probe the sorted keys of the pieces, and
vectorised maxima store the score and the length of the best last piece, which
lead back from the end.

* Unigram models: the score of a path is the sum of its pieces' scores; the best path wins.
* BPE models: a merge order has no sum of scores that it maximises, but a sequence
  of pieces is the result of the merges exactly if each two neighbours are (their
  joined text merges into just these two).  A step thus scores 0 if the new piece
  can follow the last piece of the place where it starts, else minus infinity;
  exactly one step is left for each place.  Whether two pieces can be neighbours is
  found by undoing their merges from the seam, for all pairs at once, and remembered.

Long units (text without white space) of BPE models advance in overlapping windows, together as one batch.  The last piece of a place
depends on the text and on the last pieces of the places before it, as far back as the longest piece; so once a
window agrees with the one before over that many places, it agrees from there on.  A window
that doesn't within the overlap goes on from the end of the one before, place by place.  Unigram models, whose sums depend on all that
comes before, take long units place by place.

Characters without a piece become bytes (or the unknown piece).
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Vocabulary, once, ship
from .words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Kinds of pieces and models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Penalty of a character without a piece, below the least score.
UNK_PENALTY = np.float32(10.0)
#: Units that a worker remembers, and pairs of pieces.
CACHE_UNITS, CACHE_PAIRS = 600_000, 1 << 21
#: Characters from which a unit is long, those that a window adds, and those that it has in common with the one before.
LONG, WINDOW, OVERLAP = 2048, 512, 128
_B = np.uint64(0x9E3779B97F4A7C15)
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes):
    """The fields of a protocol buffer message: number and value (bytes or integer)."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores, kinds and settings of a model file."""

    def __init__(self, data: bytes):
        self.data = data
        self.piece, self.score, self.kind = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.piece.append(own.get(1, b"").decode())
                self.score.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                self.kind.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.type = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        self.charsmap = bool(normalizer.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1))
        if self.type not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with escaped, leading white space are known")
        self.unknown = self.kind.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.piece, self.kind, strict=True)) if k == BYTE}
        self._library = None

    def normalize(self, text: str) -> str:
        """The text that is cut into pieces, white space escaped."""
        if self.charsmap:  # the file's own character map, which only the library applies
            if self._library is None:
                import sentencepiece

                self._library = sentencepiece.SentencePieceNormalizer(model_proto=self.data)
            return self._library.normalize(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        usable = [i for i, k in enumerate(model.kind) if k in (NORMAL, USER) and model.piece[i]]
        points = [np.frombuffer(model.piece[i].encode("utf-32-le"), np.uint32) for i in usable]
        self.longest = max(map(len, points))
        self.power = np.array([pow(int(_B), n, 2**64) for n in range(2 * self.longest + 1)], np.uint64)
        keys = np.array([self._hash(p[None, :])[0] for p in points], np.uint64)
        order = np.argsort(keys)
        self.key, self.id = keys[order], np.array(usable, np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces repeat, or their hashes meet")
        self.likely = np.zeros(1 << 20, bool)  # by the first 20 bits: most substrings are no piece
        self.likely[self.key >> np.uint64(44)] = True
        n = len(model.piece)
        self.hash, self.size = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
        self.hash[usable], self.size[usable] = keys, [len(p) for p in points]
        self.score = np.zeros(n + 1, np.float32)
        self.score[:n] = model.score
        self.bad = n  # the number of a character without a piece
        self.score[n] = np.float32(min(self.score[usable]) - UNK_PENALTY)
        self.crossing = any(SPACE in model.piece[i].lstrip(SPACE) for i in usable)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}
        self.pairs, self.fits = np.full(CACHE_PAIRS, -1, np.int64), np.zeros(CACHE_PAIRS, bool)  # one slot a hash, the last pair stays
        if model.type == BPE:
            self._merges(usable)

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = h * _B + (rows[:, j].astype(np.uint64) + np.uint64(1))
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pieces with these hashes; -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        likely = np.flatnonzero(self.likely[keys >> np.uint64(44)])
        own = keys[likely]
        at = np.minimum(np.searchsorted(self.key, own), len(self.key) - 1)
        out[likely] = np.where(self.key[at] == own, self.id[at], -1)
        return out

    # -- merge order -----------------------------------------------------------------

    def _merges(self, usable: list[int]) -> None:
        """When each piece is made (0: a character), and its last two parts."""
        model = self.model
        self.time = np.zeros(len(model.piece) + 1, np.int64)
        made = sorted((i for i in usable if self.size[i] > 1), key=lambda i: (-model.score[i], i))
        for t, i in enumerate(made, 1):
            self.time[i] = t
        self.left = np.arange(len(model.piece) + 1)
        self.right = self.left.copy()
        number = {model.piece[i]: i for i in usable}
        self.whole = np.zeros(len(model.piece) + 1, bool)
        self.whole[self.bad] = True
        for i in usable:
            parts = self._merge(model.piece[i], number, stop=i)
            self.whole[i] = parts is not None
            if parts:
                self.left[i], self.right[i] = parts

    def _merge(self, text: str, number: dict[str, int], stop: int):
        """The two parts of the merge that makes the piece from its own text; () for a character, None if it is never made."""
        parts = list(text)
        if len(parts) == 1:
            return ()
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = number.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.time[i] < best[0]):
                    best = self.time[i], k, i
            if best is None:
                return None
            _, k, i = best
            if i == stop and len(parts) == 2:
                return number.get(parts[0], self.bad), number.get(parts[1], self.bad)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of pieces stay two when their joined text is merged."""
        pair = a * (self.bad + 1) + b
        slot = (pair.astype(np.uint64) * _B >> np.uint64(64 - CACHE_PAIRS.bit_length() + 1)).astype(np.int64)
        known = self.pairs[slot] == pair
        out = self.fits[slot]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._seam(a[new], b[new])
            self.pairs[slot[new]], self.fits[slot[new]] = pair[new], out[new]
            # where several pairs wrote to one slot, it is emptied unless all of them were the same pair
            clash = new[self.pairs[slot[new]] != pair[new]]
            self.fits[slot[clash]], self.pairs[slot[clash]] = False, -1
        return out

    def _seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Goes back in time: at each step the later of the two parts at the seam is undone, and no merge over the seam may have come first."""
        a, b, never = a.copy(), b.copy(), np.iinfo(np.int64).max
        out, live = np.ones(len(a), bool), np.flatnonzero((a != self.bad) & (b != self.bad))
        limit = np.full(len(a), never)
        while len(live):
            x, y = a[live], b[live]
            joined = self.find(self.hash[x] * self.power[self.size[y]] + self.hash[y])
            when = np.where(joined >= 0, self.time[joined], never)
            lost = when < limit[live]
            out[live[lost]] = False
            live, x, y = live[~lost], x[~lost], y[~lost]
            later = self.time[x] > self.time[y]
            ended = (self.time[x] == 0) & (self.time[y] == 0)
            limit[live] = np.where(later, self.time[x], self.time[y] + 1)
            a[live] = np.where(later, self.right[x], x)
            b[live] = np.where(later, y, self.left[y])
            live = live[~ended]
        return out

    # -- paths -----------------------------------------------------------------------

    def _forward(self, rows: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For units of equal length, a row of code points each: at each place the last piece (``bad``: a character without one) and its length on the best path; place 0 is the start, with piece -1.

        ``known`` has the last pieces of the first places (after place 0), for BPE models; these are taken as they are.
        """
        n, width = rows.shape
        bpe = self.model.type == BPE
        total = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            total[:, j + 1] = total[:, j] * _B + (rows[:, j].astype(np.uint64) + np.uint64(1))
        best = np.full((n, width + 1), -np.inf, np.float32)
        best[:, 0] = 0
        last, back = np.full((n, width + 1), -1, np.int64), np.zeros((n, width + 1), np.int64)
        begin = 1
        if known is not None:
            begin = known.shape[1] + 1
            last[:, 1:begin], back[:, 1:begin] = known, np.where(known == self.bad, 1, self.size[known])
        for i in range(begin, width + 1):
            open_ = np.arange(n)
            for size in range(min(i, self.longest), 0, -1):
                piece = self.find(total[open_, i] - total[open_, i - size] * self.power[size])
                if size == 1:
                    piece[piece < 0] = self.bad
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                row, piece = open_[hit], piece[hit]
                if bpe:
                    fits = self.whole[piece]
                    seam = np.flatnonzero(fits & (last[row, i - size] >= 0))
                    fits[seam] = self.neighbours(last[row[seam], i - size], piece[seam])
                    row, piece = row[fits], piece[fits]
                    last[row, i], back[row, i] = piece, size
                    left = np.ones(len(open_), bool)
                    left[hit[fits]] = False
                    open_ = open_[left]
                    if not len(open_):
                        break
                else:
                    value = best[row, i - size] + self.score[piece]
                    better = value > best[row, i]
                    row = row[better]
                    best[row, i], last[row, i], back[row, i] = value[better], piece[better], size
        return last, back

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """For units of equal length, a row of code points each: at each place the piece that ends there on the best path, else -1; ``bad`` for characters without a piece."""
        n, width = rows.shape
        last, back = self._forward(rows)
        out, at, row = np.full((n, width + 1), -1, np.int64), np.full(n, width), np.arange(n)
        while len(row):
            out[row, at[row]] = last[row, at[row]]
            at[row] -= back[row, at[row]]
            row = row[at[row] > 0]
        return out[:, 1:]

    def long_path(self, points: np.ndarray) -> list[int]:
        """The pieces of one unit of any length, by windows (BPE models)."""
        n = len(points)
        last = np.full(n + 1, -1, np.int64)
        edges = np.arange(0, max(n - WINDOW, 1), WINDOW)  # window k adds the places after edges[k], the last one all that is left
        last[: min(n, WINDOW) + 1] = self._forward(points[None, :WINDOW])[0][0]
        ends = np.minimum(edges + WINDOW, n)
        ends[-1] = n
        if ends[0] == n and n > WINDOW:
            last[:] = self._forward(points[None, :])[0][0]
        middle = np.arange(1, len(edges) - 1)
        rows, memo = {}, {}
        for a in range(0, len(middle), 1024):
            part = middle[a : a + 1024]
            got = self._forward(points[edges[part][:, None] - OVERLAP + np.arange(OVERLAP + WINDOW)])[0]
            rows |= dict(zip(part.tolist(), got, strict=True))
        for k in range(1, len(edges)):
            start, end = int(edges[k]), int(ends[k])
            got = rows.pop(k) if k in rows else self._forward(points[None, start - OVERLAP : end])[0][0]
            near = self.longest
            if (got[OVERLAP - near + 1 : OVERLAP + 1] == last[start - near + 1 : start + 1]).all():
                last[start + 1 : end + 1] = got[OVERLAP + 1 :]
            else:  # from the end of the window before, place by place
                known, text = last[start - near + 1 : start + 1], points[start - near : end]
                state = known.tobytes() + text.tobytes()  # comes again in repetitive text
                if state not in memo:
                    memo[state] = self._forward(text[None, :], known[None, :])[0][0][near + 1 :]
                last[start + 1 : end + 1] = memo[state]
        out, at = [], n
        while at:
            out.append(int(last[at]))
            at -= 1 if last[at] == self.bad else int(self.size[last[at]])
        return out[::-1]

    def units(self, text: str) -> list[str]:
        own = self.model.normalize(text)
        return ([own] if own else []) if self.crossing else _UNITS.findall(own)

    def learn(self, units) -> None:
        """Encodes the units that aren't remembered, in groups of equal length."""
        if len(self.cache) > CACHE_UNITS // 2:  # units in use move on from the older half
            self.older, self.cache = self.cache, {}
        fresh, self.long = [], {}
        for u in set(units):
            if len(u) > LONG and self.model.type == BPE:  # these are not remembered
                path = self.long_path(np.frombuffer(u.encode("utf-32-le"), np.uint32))
                self.long[u] = self._without_bad(u, path) if self.bad in path else np.array(path, np.int32).tobytes()
            elif u not in self.cache:
                if (ids := self.older.get(u)) is not None:
                    self.cache[u] = ids
                else:
                    fresh.append(u)
        by: dict[int, list[str]] = {}
        for u in fresh:
            by.setdefault(len(u), []).append(u)
        for width, group in by.items():
            step = max(1, (1 << 18) // width)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                path = self.paths(np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), width))
                data = path[path >= 0].astype(np.int32).tobytes()
                ends = (4 * np.cumsum((path >= 0).sum(axis=1))).tolist()
                self.cache.update(zip(part, (data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
                for i in np.flatnonzero((path == self.bad).any(axis=1)).tolist():
                    self.cache[part[i]] = self._without_bad(part[i], path[i][path[i] >= 0].tolist())

    def _without_bad(self, unit: str, path: list[int]) -> bytes:
        out, at = [], 0
        for p in path:
            if p != self.bad:
                out.append(p)
                at += int(self.size[p])
                continue
            if self.model.byte_fallback:
                out += [self.model.byte[b] for b in unit[at].encode()]
            elif not (out and out[-1] == self.model.unknown):
                out.append(self.model.unknown)
            at += 1
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.units(t or "") for t in texts]
        self.learn([u for units in cut for u in units])
        known = (lambda u: self.long[u] if u in self.long else self.cache[u]) if self.long else self.cache.__getitem__
        return [np.frombuffer(b"".join(map(known, units)), np.int32) for units in cut]


class Decoder:
    """Ids to text: bytes of pieces side by side, white space unescaped, the dummy prefix taken off."""

    def __init__(self, model: Model):
        self.model = model
        skip = {CONTROL}
        self.bytes = [b"" if k in skip else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.piece, model.kind, strict=True)]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def coder(file: Vocabulary) -> tuple[Encoder, Decoder]:
    def make(data: bytes) -> tuple[Encoder, Decoder]:
        model = Model(data)
        return Encoder(model), Decoder(model)

    return once("pieces", file, make)


def _encode(batches, text: str, file: Vocabulary, check: bool):
    encoder, decoder = coder(file)
    for part in slices(batches, text):
        texts = part.column(text).to_pylist()
        ids = encoder.encode(texts)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        arrays = [*(c for c, n in zip(part.columns, part.schema.names, strict=True) if n != text), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
        if check:
            arrays.append(pa.array([decoder.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()))
        yield pa.RecordBatch.from_arrays(arrays, names=[*(n for n in part.schema.names if n != text), "n_pieces", "ids", *["round_trip"] * check])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """``doc_id, n_pieces, ids`` of each row, and with ``check`` whether decoding gives the text back (``round_trip``).

    A null text has no pieces, as an empty one, and round-trips to the empty text.  Repeated rows each have their own row;
    other columns are not read; no shuffle.
    """
    file = ship(docs.sparkSession, model)
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {dict(two.dtypes)['doc_id']}, n_pieces long, ids array<int>" + ", round_trip boolean" * check
    return two.mapInArrow(partial(_encode, text="text", file=file, check=check), schema)


def _decode(batches, file: Vocabulary):
    _, decoder = coder(file)
    for batch in batches:
        texts = [None if x is None else decoder.decode(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of each row of ids; null ids give a null text, ids outside the vocabulary raise."""
    file = ship(encoded.sparkSession, model)
    two = encoded.select(encoded[id_col].alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return two.mapInArrow(partial(_decode, file=file), f"doc_id {dict(two.dtypes)['doc_id']}, text string")
