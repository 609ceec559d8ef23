"""Token counts by offset-mapped attribution.

A document's fields are joined and encoded once, as a whole.  Each token's
span follows from the lengths of the tokens; sections (or
fields) are spans too, and both are sorted, so their interval join is two
binary searches.  A token has a character span where it is whole characters; one that ends inside a
character has that part of it, so offsets are exact to the byte inside, and results are in characters.
A token that crosses a boundary goes by an explicit rule:

* ``start``: to the section that holds its beginning,
* ``end``: to the section that holds its end,
* ``most``: to the section with most of it, the first of equals,
* ``share``: to all of its sections, in proportion.
"""

from __future__ import annotations

import base64
import hashlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import slices

#: A file of ``base64 rank`` lines and the pattern that cuts a text before the merges (fixed by the vocabulary).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "most", "share")
RULE = "most"
#: Bytes of a vocabulary file.
MAX_VOCABULARY = 32 << 20


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)

    def ends(self, text: str) -> np.ndarray:
        """The byte offsets where the tokens end."""
        return np.cumsum(self.length[np.array(self.encoding.encode_ordinary(text), np.int64)])


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Vocabulary(NamedTuple):
    """A vocabulary file that goes with a job: its digest and its bytes."""

    digest: str
    data: Broadcast


_made: dict[tuple[str, str], object] = {}


def once(kind: str, vocabulary: Vocabulary, make):
    """What ``make`` builds of the file's bytes, once a worker."""
    key = kind, vocabulary.digest
    if key not in _made:
        _made[key] = make(vocabulary.data.value)
    return _made[key]


def encoder(vocabulary: Vocabulary) -> Encoder:
    return once("ranks", vocabulary, lambda data: Encoder(parse_ranks(data)))


def ship(spark: SparkSession, path: str) -> Vocabulary:
    """Sends a vocabulary file, of ``MAX_VOCABULARY`` bytes at most, to all executors; its path is the driver's."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} is no vocabulary: it has more than {MAX_VOCABULARY} bytes")
    return Vocabulary(hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = RULE) -> np.ndarray:
    """Tokens of each section, as doubles; spans start where the one before ends, empty sections get 0."""
    n, m = len(section_ends), len(token_ends)
    if not m or not n:
        return np.zeros(n)
    starts = np.concatenate([[0], token_ends[:-1]])
    first, last = np.searchsorted(section_ends, starts, "right"), np.searchsorted(section_ends, token_ends - 1, "right")
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float)
    cross = np.flatnonzero(first != last)
    out = np.bincount(first[first == last], minlength=n).astype(float)
    begins = np.concatenate([[0], section_ends[:-1]])
    for t in cross.tolist():
        own = np.arange(first[t], last[t] + 1)
        part = np.minimum(section_ends[own], token_ends[t]) - np.maximum(begins[own], starts[t])
        if rule == "share":
            out[own] += part / part.sum()
        else:
            out[own[part.argmax()]] += 1
    return out


def line_ends(text: str) -> np.ndarray:
    """Sections are lines, each with its line break: the byte offsets where they end. An empty text has one empty section."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def characters(text: str) -> np.ndarray:
    """The characters that begin before each byte, and after the last."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def _count(batches, ids: str, fields: list[str], lines: bool, file: Vocabulary, rule: str):
    own = encoder(file)
    for part in slices(batches, *fields):
        columns = [part.column(f).to_pylist() for f in fields]
        docs, name, section, start, end, n = [], [], [], [], [], []
        for i, values in enumerate(zip(*columns, strict=True)):
            texts = [v or "" for v in values]
            whole = "".join(texts)
            token_ends = own.ends(whole)
            spans, at = [], 0
            for f, text in zip(fields, texts, strict=True):
                ends = line_ends(text) if lines else np.array([len(text.encode())])
                spans.append((f, ends + at))
                at += int(ends[-1])
            every = np.concatenate([e for _, e in spans])
            counts = attribute(token_ends, every, rule)
            docs += [i] * len(every)
            for f, e in spans:
                name += [f] * len(e)
                section += range(len(e))
            at = characters(whole)[every].tolist()  # sections begin and end between characters
            start += [0, *at[:-1]]
            end += at
            n += counts.tolist()
        yield pa.RecordBatch.from_arrays([part.column(ids).take(pa.array(docs, pa.int64())), pa.array(name, pa.string()), pa.array(section, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.float64())], names=["doc_id", "field", "section", "start", "end", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), lines: bool = True, rule: str = RULE, ranks: str = RANKS) -> DataFrame:
    """``doc_id, field, section, start, end, n_tokens``: a row for each line (or field) of each row of ``docs``.

    ``start`` and ``end`` are character offsets in the joined fields.  A null field is an empty one and has one empty section
    with 0 tokens.  The counts of a row add up to the tokens of its whole text.  Repeated rows each have their own rows;
    other columns are not read; no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    file = ship(docs.sparkSession, ranks)
    plain = [f"f{i}" for i in range(len(fields))]
    own = docs.select(docs[id_col].alias("doc_id"), *(docs[f].alias(p) for f, p in zip(fields, plain, strict=True)))
    kind = dict(own.dtypes)["doc_id"]
    out = own.mapInArrow(partial(_count, ids="doc_id", fields=plain, lines=lines, file=file, rule=rule), f"doc_id {kind}, field string, section long, start long, end long, n_tokens double")
    names = F.create_map(*[x for p, f in zip(plain, fields, strict=True) for x in (F.lit(p), F.lit(f))])
    return out.withColumn("field", names[F.col("field")])


def _lengths(batches, file: Vocabulary):
    own = encoder(file).encoding
    for part in slices(batches, "text"):
        n = [len(own.encode_ordinary(t or "")) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``doc_id, n``: the tokens of each row's whole text (null: none); no shuffle."""
    file = ship(docs.sparkSession, ranks)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(partial(_lengths, file=file), f"doc_id {dict(own.dtypes)['doc_id']}, n long")


def totals(counts: DataFrame) -> DataFrame:
    """``field, n_sections, n_tokens`` over all documents."""
    return counts.groupBy("field").agg(F.count("*").alias("n_sections"), F.sum("n_tokens").alias("n_tokens"))
