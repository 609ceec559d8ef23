"""Substring dedup by prefix-partitioned suffix trees over words.

Suffix trees are followed as deep as ``k`` words, as deeper nodes change nothing.  A k-word window is repeated if
two leaves hang below one node of depth k; the words that such windows cover
are a repeat, and runs of such windows make it maximal.

1. *Prefix histogram.*  One pass counts the suffixes (word positions) by their first two
   words, hashed into 4096 slots (the only thing that goes to the driver, of
   fixed size).  Light slots are merged into groups of about ``group_size``
   suffixes; a heavier slot is split by longer prefixes (twelve words) into as many groups as it needs.
2. *Shallow level.*  Every k-word window holds a least 12-word gram (its
   minimizer), and equal windows hold the same one in the same place.  So of the suffixes only those that begin with
   a minimizer go to their groups; where a leaf is alone at depth 12, all windows that hold it are
   pruned.  Grams are compared by 64-bit hashes here: a chance match prunes less, and never too much.
3. *Deep level.*  The suffixes left go to the group of their twelve-word prefix, with the words before it that its windows have:
   neighbouring windows of one minimizer travel as one piece of text.  A group numbers its words and sorts its suffixes by them; the common prefix of each two
   neighbours gives the nodes of every depth as intervals.  A second tree is that of the words before the prefix, read backwards.  A
   window with o words before the prefix has k - o from there on: it is repeated where two leaves share a node of depth k - o in one tree and
   one of depth o in the other.  Words are compared as they are, so the result is exact.
   Where a prefix has so many windows that its group would be too large, it is lengthened to all k words: these windows are dealt one by one, and
   the node of depth k tells.
4. The bits go back to the documents, which drop the covered words.

Documents are packed into chunks of about 2 MB, which are written once; steps 1 and 2 read them where they lie, steps 3 and 4 share one exchange.  A chunk sends each piece once for each
group, however often it has it, so a passage that a third of all rows share costs a group one piece
a chunk: no key is hot, and no pairs are made.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import checkpointed, extended, spare
from .words import Words, slices

SLOTS, PREFIX, SHALLOW = 4096, 2, 12
#: Suffixes of a group, on average, and the share of them that one gram may have before its windows are dealt one by one.
GROUP_SIZE, HEAVY = 500_000, 50
#: Marks of grams: alone, shared, and with too many windows for one group.
ALONE, SHARED, TOO_MANY = 0, 1, 2
ANSWERS = "chunk string, group int, marks binary, heavy long"


def _pack(batches, text: str):
    """One row a chunk: its id (a hash of its content) and its rows as compressed Arrow data."""
    for part in slices(batches, text):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        data = sink.getvalue().to_pybytes()
        yield pa.RecordBatch.from_pydict({"chunk": [xxhash.xxh3_128_hexdigest(data)], "data": [data]})


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _slots(words: Words, h: np.ndarray) -> np.ndarray:
    """The prefix slot of each word position that starts two words of one document."""
    return (words.windows(h, PREFIX) % np.uint64(SLOTS)).astype(np.int64)


def _histogram(batches, text: str, k: int):
    total = np.zeros(SLOTS, np.int64)
    for part in slices(batches, text):
        words = Words(part.column(text))
        h, ok = words.hashes(), words.whole(k)
        total += np.bincount(_slots(words, h)[: len(ok)][ok], minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})


def plan_groups(counts: np.ndarray, group_size: int) -> np.ndarray:
    """For each slot its first group and over how many groups its longer prefixes are dealt."""
    out, group, filled = np.zeros((len(counts), 2), np.int64), 0, 0
    for slot, n in enumerate(counts.tolist()):
        if n > group_size:
            if filled:
                group, filled = group + 1, 0
            parts = -(-n // group_size)
            out[slot] = group, parts
            group += parts
            continue
        if filled + n > group_size:
            group, filled = group + 1, 0
        out[slot] = group, 1
        filled += n
    return out


def _groups(words: Words, h: np.ndarray, plan: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The group of each position that starts a whole gram."""
    slot = _slots(words, h)[: len(gram)]
    return plan[slot, 0] + ((gram >> np.uint64(20)) % plan[slot, 1].astype(np.uint64)).astype(np.int64)


def _anchors(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each whole k-window: its start and the position of its least gram (the first of equals); and the grams."""
    short = min(SHALLOW, k)
    gram = words.windows(h, short)
    starts = np.flatnonzero(words.whole(k))
    if not len(starts):
        return starts, starts, gram
    width = k - short + 1
    best, at = gram[: len(gram) - width + 1].copy(), np.arange(len(gram) - width + 1)
    for j in range(1, width):
        other = gram[j : len(gram) - width + 1 + j]
        less = other < best
        best[less], at[less] = other[less], np.flatnonzero(less) + j
    return starts, at[starts], gram


class Level(NamedTuple):
    """The shallow level of a chunk: windows, the positions of their minimizers, these once each, and their distinct grams."""

    h: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    anchors: np.ndarray
    path: np.ndarray
    group: np.ndarray
    count: np.ndarray
    where: np.ndarray


def _shallow_level(words: Words, k: int, plan: np.ndarray) -> Level:
    h = words.hashes()
    starts, at, gram = _anchors(words, h, k)
    anchors = np.unique(at)
    path, where, count = np.unique(gram[anchors] if len(anchors) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    group = np.zeros(len(path), np.int64)
    if len(anchors):
        group[where] = _groups(words, h, plan, gram)[anchors]
    return Level(h, starts, at, anchors, path, group, count, where)


def _cuts(group: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each group and its members in order."""
    order = np.argsort(group, kind="stable")
    ends = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    return [(int(group[order[a]]), order[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


GRAMS = "chunk string, group int, paths binary, counts binary"


def _shallow(batches, text: str, k: int, plan: np.ndarray):
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
            level = _shallow_level(Words(_unpack(data.as_py()).column(text)), k, plan)
            rows = [(chunk, g, level.path[own].tobytes(), np.minimum(level.count[own], 65535).astype(np.uint16).tobytes()) for g, own in _cuts(level.group)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "group", "paths", "counts"])


def _answer(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.int64()))], names=["chunk", "group", "marks", "heavy"])


def _match(table: pa.Table, heavy: int) -> pa.Table:
    """The shallow tree of one group: which grams of each chunk have two leaves, and which over ``heavy``."""
    paths = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("paths")]
    counts = [np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in table.column("counts")]
    _, where = np.unique(np.concatenate(paths), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts)).astype(np.int64)[where]
    marks = np.where(total > heavy, TOO_MANY, np.where(total > 1, SHARED, ALONE)).astype(np.uint8)
    rows, at = [], 0
    for chunk, group, n in zip(table.column("chunk").to_pylist(), table.column("group").to_pylist(), counts, strict=True):
        own = marks[at : at + len(n)]
        at += len(n)
        if own.any():
            rows.append((chunk, group, own.tobytes(), int(n[own == TOO_MANY].sum())))
    return _answer(rows)


class Pieces(NamedTuple):
    """The windows of a chunk that may repeat, as pieces of text: the first word and the windows of each, which distinct one it is, and of the distinct ones the groups, the windows, whether
    they come again, the place of the prefix that tells their group, and the text."""

    begin: np.ndarray
    n: np.ndarray
    which: np.ndarray
    group: np.ndarray
    windows: np.ndarray
    again: np.ndarray
    anchor: np.ndarray
    text: list[bytes]


def _pieces(words: Words, k: int, plan: np.ndarray, answers: pa.Table, parts: int) -> Pieces:
    level = _shallow_level(words, k, plan)
    mark = np.zeros(len(level.path), np.uint8)
    own = dict(_cuts(level.group))
    for g, bits in zip(answers.column("group").to_pylist(), answers.column("marks").to_pylist(), strict=True):
        mark[own[g]] = np.frombuffer(bits, np.uint8)
    anchor = np.searchsorted(level.anchors, level.at)
    of = level.where[anchor] if len(anchor) else anchor
    shared, many = np.flatnonzero(mark[of] == SHARED), np.flatnonzero(mark[of] == TOO_MANY)
    first = np.flatnonzero(np.diff(anchor[shared], prepend=-1))  # the windows of a minimizer are neighbours
    begin = np.concatenate([level.starts[shared[first]], level.starts[many]])
    n = np.concatenate([np.diff(np.append(first, len(shared))), np.ones(len(many), np.int64)])
    group = level.group[of[shared[first]]]
    if len(many):
        long = words.windows(level.h, k)[level.starts[many]]
        group = np.concatenate([group, (plan[:, 0] + plan[:, 1]).max() + ((long >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)])
    raw, number = words.buf.tobytes(), {}
    ends = words.end[begin + n + k - 2] if len(begin) else begin
    which = np.array([number.setdefault((g, raw[a:b]), len(number)) for g, a, b in zip(group.tolist(), words.start[begin].tolist(), ends.tolist(), strict=True)], np.int64)
    windows, anchors = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    windows[which] = n
    # where a window goes by all of its words, these are the prefix
    anchors[which] = np.concatenate([level.at[shared[first]] - level.starts[shared[first]], np.zeros(len(many), np.int64)])
    return Pieces(begin, n, which, np.array([g for g, _ in number], np.int64), windows, np.bincount(which, minlength=len(number)) > 1, anchors, [t for _, t in number])


PIECES = "chunk string, group int, sizes binary, again binary, anchors binary, size long, text binary"


def _deep(chunks: pa.Table, answers: pa.Table, text: str, k: int, plan: np.ndarray, parts: int) -> pa.Table:
    rows = []
    for chunk, data in zip(chunks.column("chunk").to_pylist(), chunks.column("data"), strict=True):
        pieces = _pieces(Words(_unpack(data.as_py()).column(text)), k, plan, answers, parts)
        for g, own in _cuts(pieces.group):
            every = b"".join(pieces.text[i] for i in own.tolist())
            sizes = np.array([len(pieces.text[i]) for i in own.tolist()], np.uint32).tobytes()
            rows.append((chunk, g, sizes, np.packbits(pieces.again[own]).tobytes(), pieces.anchor[own].astype(np.uint16).tobytes(), len(every), pa.compress(every, "zstd", asbytes=True)))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], names=["chunk", "group", "sizes", "again", "anchors", "size", "text"])


def numbers(words: Words) -> np.ndarray:
    """Each word's number: the same for equal words, and for these only."""
    end = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    letters = np.ascontiguousarray(words.buf[words.solid])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(end) - 1, [None, pa.py_buffer(end), pa.py_buffer(letters)])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers, and the common prefix of each two neighbours."""
    n, k = rows.shape
    bits = max(int(rows.max(initial=0)).bit_length(), 1)
    per = max(1, min(63 // bits, k))
    keys = []
    for a in range(0, k, per):
        key = np.zeros(n, np.int64)
        for j in range(a, min(a + per, k)):
            key = key << bits | rows[:, j]
        keys.append(key)
    order = np.lexsort(keys[::-1]) if keys else np.arange(n)
    common, live = np.zeros(max(n - 1, 0), np.int64), np.arange(max(n - 1, 0))
    for c, key in enumerate(keys):
        m = min(per, k - c * per)
        differ = key[order[live]] ^ key[order[live + 1]]
        for j in range(m):
            common[live] += differ >> bits * (m - 1 - j) == 0
        live = live[differ == 0]
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node at a depth that each suffix hangs below: neighbours with so long a common prefix are one interval."""
    node = np.zeros(len(order), np.int64)
    node[order] = np.concatenate([[0], np.cumsum(common < depth)])[: len(order)]
    return node


def leaves(ids: np.ndarray, first: np.ndarray, size: np.ndarray, anchor: np.ndarray, k: int) -> np.ndarray:
    """Which k-word windows of the pieces, in order, start elsewhere too.

    A piece has ``size`` words from ``first`` on and holds its group's prefix at the word ``anchor``; each of its windows holds it too.  The suffixes from there on are sorted,
    and so are the words before, read backwards.  A window with o words before the prefix is repeated where two leaves hang below
    one node of depth k - o of the first tree and one of depth o of the second.
    """
    def beside(step: int, from_: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.arange(k)
        there = at[None] < n[:, None]
        return np.where(there, ids[np.where(there, from_[:, None] + step * at[None], 0)] + 1, 0).astype(np.int64)

    n = size - k + 1
    start = np.concatenate([[0], np.cumsum(n)])
    found = np.zeros(start[-1], bool)
    if not len(found):
        return found
    after, before = suffixes(beside(1, first + anchor, size - anchor)), suffixes(beside(-1, first + anchor - 1, np.minimum(anchor, k)))
    for o in range(int(anchor.max()) + 1):
        own = np.flatnonzero((o <= anchor) & (o > anchor - n))
        if len(own):
            pair = intervals(*after, k - o)[own] * len(n) + intervals(*before, o)[own]
            _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
            found[start[own] + anchor[own] - o] = count[which] > 1
    return found


def _match_deep(table: pa.Table, k: int) -> pa.Table:
    """The deep tree of one group: a mark for each window of each chunk's pieces."""
    sizes = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in table.column("sizes")]
    text = b"".join(pa.decompress(x.as_py(), n, "zstd", asbytes=True) for x, n in zip(table.column("text"), table.column("size").to_pylist(), strict=True))
    end = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    words = Words(pa.LargeStringArray.from_buffers(len(end) - 1, pa.py_buffer(end), pa.py_buffer(text)))
    anchor = np.concatenate([np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in table.column("anchors")])
    found = leaves(numbers(words), words.first[:-1], words.count, anchor, k)
    # a piece that one chunk has twice repeats even when no other chunk has it
    again = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(n)) for x, n in zip(table.column("again"), sizes, strict=True)]).astype(bool)
    windows = words.count - k + 1
    found |= np.repeat(again, windows)
    at = np.concatenate([[0], np.cumsum(windows)])[np.concatenate([[0], np.cumsum([len(n) for n in sizes])])]
    rows = [(chunk, group, np.packbits(found[a:b]).tobytes(), 0) for chunk, group, a, b in zip(table.column("chunk").to_pylist(), table.column("group").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True) if found[a:b].any()]
    return _answer(rows)


def _repeats(words: Words, k: int, plan: np.ndarray, parts: int, shallow: pa.Table, deep: pa.Table) -> np.ndarray:
    """The word positions where repeated windows start, from the marks of both levels."""
    pieces = _pieces(words, k, plan, shallow, parts)
    if not len(pieces.begin):
        return pieces.begin
    first = np.concatenate([[0], np.cumsum(pieces.windows)])
    found = np.zeros(first[-1], bool)
    own = dict(_cuts(pieces.group))
    for g, bits in zip(deep.column("group").to_pylist(), deep.column("marks").to_pylist(), strict=True):
        n = pieces.windows[own[g]]
        at = np.repeat(first[own[g]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        found[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
    step = np.arange(pieces.n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(pieces.n)[:-1]]), pieces.n)
    start = np.repeat(pieces.begin, pieces.n) + step
    return np.sort(start[found[np.repeat(first[pieces.which], pieces.n) + step]])


def _write(chunks: pa.Table, answers: pa.Table, text: str, k: int, plan: np.ndarray, parts: int, make) -> pa.Table:
    level = answers.column("level").to_numpy() if answers.num_rows else np.zeros(0)
    shallow, deep = answers.filter(pa.array(level == 0)), answers.filter(pa.array(level == 1))
    out = []
    for data in chunks.column("data"):
        rows = _unpack(data.as_py())
        words = Words(rows.column(text))
        out.append(make(rows, words, _repeats(words, k, plan, parts, shallow, deep)))
    return pa.concat_tables(out)


def _texts(words: Words, removed: np.ndarray) -> list[list[bytes]]:
    """The words kept, by document."""
    raw = words.buf.tobytes()
    lost = words.per_document_words(removed)
    out = []
    for d, (a, b) in enumerate(zip(words.off[:-1].tolist(), words.off[1:].tolist(), strict=True)):
        own = raw[a:b].split()
        if lost[d]:
            own = [w for w, gone in zip(own, removed[words.first[d] : words.first[d + 1]].tolist(), strict=True) if not gone]
        out.append(own)
    return out


def _runs(rows: pa.Table, words: Words, starts: np.ndarray, k: int) -> pa.Table:
    """Runs of repeated windows of each document."""
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > 1) | (words.doc[starts[1:]] != words.doc[starts[:-1]])
    first = np.flatnonzero(new)
    last = starts[np.append(first[1:], len(starts)) - 1] if len(starts) else starts
    begin = starts[first]
    doc = words.doc[begin]
    return pa.table([rows.column(0).take(pa.array(doc)), pa.array(begin - words.first[doc], pa.int64()), pa.array(last - begin + k, pa.int64())], names=["doc_id", "start", "length"])


def _digest(rows: pa.Table, words: Words, starts: np.ndarray, k: int) -> pa.Table:
    removed = words.covered(starts, k)
    kept = [hashlib.sha256(b" ".join(x)).hexdigest() for x in _texts(words, removed)]
    return pa.table([rows.column(0), pa.array(words.count, pa.int64()), pa.array(words.per_document_words(removed), pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(rows: pa.Table, words: Words, starts: np.ndarray, k: int, text: str, n_words: str, n_removed: str) -> pa.Table:
    """The rows with the text as it was where nothing was removed, else the kept words joined by one space."""
    removed = words.covered(starts, k)
    lost, at, texts = words.per_document_words(removed), rows.schema.get_field_index(text), rows.column(text).to_pylist()
    if lost.any():
        for d, own in enumerate(_texts(words, removed)):
            if lost[d]:
                texts[d] = b" ".join(own).decode()
    rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
    return rows.append_column(n_words, pa.array(words.count, pa.int64())).append_column(n_removed, pa.array(lost, pa.int64()))


def _run(docs: DataFrame, text: str, k: int, group_size: int, make, schema: str) -> DataFrame:
    counts = np.zeros(SLOTS, np.int64)
    for row in docs.select(text).mapInArrow(partial(_histogram, text=text, k=k), "slot int, n long").groupBy("slot").sum("n").collect():  # 4096 rows at most
        counts[row[0]] = row[1]
    plan = plan_groups(counts, group_size)
    # written, so that a task that runs again reads the same chunks
    stored = checkpointed(docs.mapInArrow(partial(_pack, text=text), "chunk string, data binary"))
    heavy = max(group_size // HEAVY, 1)

    def match(table: pa.Table) -> pa.Table:
        return _match(table, heavy)

    shallow = checkpointed(stored.mapInArrow(partial(_shallow, text=text, k=k, plan=plan), GRAMS).groupBy("group").applyInArrow(match, ANSWERS))
    # a gram is the least one of about half of the windows that hold it
    windows = (shallow.agg(F.sum("heavy")).first()[0] or 0) * (k - min(SHALLOW, k) + 2) // 2
    own = dict(text=text, k=k, plan=plan, parts=max(1, -(-windows // group_size)))

    def deep(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _deep(left, right, **own)

    def write(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _write(left, right, **own, make=make) if left.num_rows else empty

    def match_deep(table: pa.Table) -> pa.Table:
        return _match_deep(table, k)

    chunks = stored.repartition("chunk")  # both steps below read this exchange
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    deeper = chunks.groupBy("chunk").cogroup(shallow.groupBy("chunk")).applyInArrow(deep, PIECES).groupBy("group").applyInArrow(match_deep, ANSWERS)
    answers = shallow.withColumn("level", F.lit(0)).unionByName(deeper.withColumn("level", F.lit(1)))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(write, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, group_size: int = GROUP_SIZE) -> DataFrame:
    """``doc_id, start, length``: the maximal repeats of each row, as runs of words whose k-word windows all start elsewhere too, with the first word's place (from 0).

    Runs of one row don't touch, but may overlap by up to k - 2 words.  A null text has none; an empty table gives no rows.
    """
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return _run(two, "text", k, group_size, partial(_runs, k=k), f"doc_id {dict(two.dtypes)['doc_id']}, start long, length long")


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, group_size: int = GROUP_SIZE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs``.

    A null text has no words.  Rows with the same id or the same text are different
    documents, so all of their windows repeat.  Texts shorter than k words
    keep everything.  An empty table gives no rows; other columns are not read.
    """
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = dict(two.dtypes)["doc_id"]
    return _run(two, "text", k, group_size, partial(_digest, k=k), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", k: int = 35, group_size: int = GROUP_SIZE, stats: bool = False) -> DataFrame:
    """``docs`` without the words that repeated k-word windows cover.

    A text that loses words becomes its kept words joined by single spaces (empty
    if none is left); all other texts and columns stay as they are.  ``stats``
    adds n_words and n_removed, with underscores in front if ``docs`` has such columns.
    """
    n_words, n_removed = spare(docs, "n_words", "n_removed")
    schema = extended(docs.schema, **{n_words: "long", n_removed: "long"})
    names = [f"c{i}" for i in range(len(schema))]  # plain names inside, as columns may clash but for letter case
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))
    text = names[docs.columns.index(text_col)]
    inner = docs.toDF(*names[:-2])
    out = _run(inner, text, k, group_size, partial(_rewrite, k=k, text=text, n_words=names[-2], n_removed=names[-1]), ddl)
    out = out.toDF(*[f.name for f in schema])
    return out if stats else out.drop(n_words, n_removed)
