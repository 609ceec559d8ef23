"""Whole-batch word splitting and fingerprints, vectorised over Arrow buffers.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` (ASCII white
space only).  Nothing here loops over documents or words in Python, so the
cost is a few array operations a byte, and memory is bounded by the slice
size (``SLICE_BYTES`` of text, or one document if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 1 << 14
BLOCK = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(int(_M), -1, 2**64))
_B = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64) -> np.ndarray:
    if name not in _powers:
        x = np.full(BLOCK + LONG_WORD + 2, base, np.uint64)
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any bits of the result may pick a bin."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches, *texts: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(t))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
        ends = np.cumsum(size + 64)
        at, n = 0, batch.num_rows
        while at < n:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


class Words:
    """The words of a slice: ``start``, ``end`` (bytes), ``first`` (word offsets by document) and ``doc``."""

    def __init__(self, texts: pa.Array):
        self.buf, self.off = buffer(texts)
        buf, off = self.buf, self.off
        solid = ~WHITE[buf]
        if len(buf):
            begins = solid.copy()
            begins[1:] &= ~solid[:-1]
            cut = off[:-1][off[:-1] < len(buf)]
            begins[cut] |= solid[cut]
            ends = solid.copy()
            ends[:-1] &= ~solid[1:]
            last = off[1:][off[1:] > 0] - 1
            ends[last] |= solid[last]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.solid = solid
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sums of byte flags by document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def per_document_words(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word's bytes, the same in every process."""
        out = np.zeros(len(self.start), np.uint64)
        if not len(out):
            return out
        power, inverse = _power("M", _M), _power("M_INV", _M_INV)
        length = self.end - self.start
        long = length > LONG_WORD
        edge = np.searchsorted(self.start, np.arange(self.start[0], len(self.buf) + BLOCK, BLOCK))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            lo = self.start[a]
            fits = ~long[a:b]
            s, e = (self.start[a:b] - lo)[fits], (self.end[a:b] - lo)[fits]
            if not len(s):
                continue
            span = self.buf[lo : lo + e[-1]]
            total = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(_BYTE[span] * power[: len(span)], out=total[1:])
            out[a:b][fits] = (total[e] - total[s]) * inverse[s]
        out = mix(out + length.astype(np.uint64))
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(self.buf[self.start[i] : self.end[i]].tobytes(), 7)
        return out

    def windows(self, h: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of the k words from each word on; only valid where ``whole(k)`` holds."""
        n = len(h)
        if n < k:
            return np.zeros(0, np.uint64)
        out, width, done = None, 1, 0
        part, rest = h, k
        while rest:
            if rest & 1:
                piece = part[done : n - k + 1 + done] if done else part[: n - k + 1]
                out = piece.copy() if out is None else out * np.uint64(pow(_B, width, 2**64)) + piece
                done += width
            rest >>= 1
            if rest:
                part = part[: len(part) - width] * np.uint64(pow(_B, width, 2**64)) + part[width:]
                width *= 2
        return mix(out)

    def whole(self, k: int) -> np.ndarray:
        """Which of ``windows(h, k)`` lie within one document."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, bool)
        return self.doc[: n - k + 1] == self.doc[k - 1 :]

    def covered(self, begins: np.ndarray, k: int) -> np.ndarray:
        """Which words lie in a window of k words that starts at one of ``begins``."""
        step = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(step, begins, 1)
        np.add.at(step, begins + k, -1)
        return np.cumsum(step)[:-1] > 0
