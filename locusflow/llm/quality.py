"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the measurements
and one bit for each rule that fails; what is kept is decided later, by
versioned policies, which are masks over these bits.  Ablations (what each
rule rejects, alone or at all) are bitwise aggregations of the ledger and
never look at a text again.

Five-word windows of a text are compared by 64-bit hashes (a polynomial of the words' XXH64), not word by word: a chance match would count a window as
repeated, with a probability of about n**2 / 2**65 in a text of n words (under 1e-9 at 100,000 words).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, spare
from .words import Words, slices

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(SYMBOLS.encode(), np.uint8)] = True
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_wide")

#: Bit, name and SQL condition of failure, over the measurements.  Bits are never used again for another rule.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 10"),
    (1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "dup_lines", "2 * n_dup_lines > n_lines"),
    (4, "long_words", "word_chars > 15 * n_words"),
    (5, "short_words", "word_chars < 2 * n_words"),
    (6, "upper_case", "n_upper > n_lower"),
    # word lengths and letter case of ASCII tell nothing about a text that is mostly in another script
    (7, "long_ascii_words", "word_chars > 15 * n_words AND 2 * n_wide < word_chars"),
    (8, "short_ascii_words", "word_chars < 2 * n_words AND 2 * n_wide < word_chars"),
    (9, "upper_ascii", "n_upper > n_lower AND 2 * n_wide < word_chars"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any of its rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: bit for bit, name, _ in RULES}
        return sum(1 << bits[r] for r in set(self.rules))


POLICIES = (
    Policy("base", 1, BASE),
    Policy("strict", 1, (*BASE, "symbols", "dup_lines", "long_words", "short_words")),
    Policy("strict", 2, (*BASE, "symbols", "dup_lines", "long_words", "short_words", "upper_case")),
    Policy("strict", 3, (*BASE, "symbols", "dup_lines", "long_ascii_words", "short_ascii_words", "upper_ascii")),
)
#: What ``op1_quality_rules`` and the pipeline apply.
CURRENT = POLICIES[-1]


def _dup_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    seen, n, again = set(), 0, 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\v\f\r"):
            n += 1
            if line in seen:
                again += 1
            seen.add(line)
    return n, again


def _measure_slice(texts: pa.Array) -> list[pa.Array]:
    words = Words(texts)
    char = (words.buf & 0xC0) != 0x80
    h, ok = words.hashes(), words.whole(WINDOW)
    at = np.flatnonzero(ok)
    # one number for each (document, window); equal ones are found by sorting
    key = words.windows(h, WINDOW)[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, where, n = np.unique(key, return_inverse=True, return_counts=True)
    repeated = words.covered(at[n[where] > 1], WINDOW) if len(at) else np.zeros(len(words.start), bool)
    lines = np.array([_dup_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
    values = (
        words.count, words.per_document(words.solid & char), words.per_document(_SYMBOL[words.buf]), lines[:, 1], words.per_document_words(repeated), lines[:, 0],
        words.per_document((words.buf >= 65) & (words.buf <= 90)), words.per_document((words.buf >= 97) & (words.buf <= 122)),
        words.per_document(words.buf >= 0xC0),
    )
    return [pa.array(v, pa.int64()) for v in values]


def _measure(batches, text: str, names: list[str]):
    for part in slices(batches, text):
        arrays = _measure_slice(part.column(text))
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(part.columns, part.schema.names, strict=True) if n != text), *arrays], names=[*(n for n in part.schema.names if n != text), *names])


def fail_bits() -> Column:
    """The bitmask of the rules that fail, from columns named as the measurements."""
    bits = [F.when(F.expr(condition), F.lit(1 << bit)).otherwise(0) for bit, _, condition in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` (long) of each row; no shuffle.

    A null text measures as an empty one: all zero, and it fails few_words only
    (every other rule compares sums with zero).  Repeated rows each have their own row.
    """
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = dict(two.dtypes)["doc_id"]
    measured = two.mapInArrow(partial(_measure, text="text", names=list(MEASURES)), f"doc_id {kind}, {', '.join(f'{m} long' for m in MEASURES)}")
    return measured.withColumn("fail_bits", fail_bits())


def verdict(policy: Policy, bits: str = "fail_bits") -> Column:
    """True where the policy keeps the document."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def filter_documents(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they are."""
    names = spare(docs, *MEASURES, "fail_bits")
    if names != [*MEASURES, "fail_bits"]:  # rules are written over plain names: rename the clashing columns meanwhile
        return filter_documents(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), policy, f"c{docs.columns.index(text_col)}").toDF(*docs.columns)
    schema = extended(docs.schema, **dict.fromkeys(MEASURES, "long"))
    return docs.mapInArrow(partial(_measure_keeping, text=text_col), schema).filter((fail_bits().bitwiseAND(F.lit(policy.mask))) == 0).select(*(docs.columns))


def _measure_keeping(batches, text: str):
    for part in slices(batches, text):
        yield pa.RecordBatch.from_arrays([*part.columns, *_measure_slice(part.column(text))], names=[*part.schema.names, *MEASURES])


def ablation(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, those only this rule of the policy rejects, and those that the policy rejects.

    The ledger is first counted by bit pattern, at most 2 ** len(RULES) rows, so the
    rest costs nothing whatever the number of documents.  An empty ledger gives no rows.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits = {name: bit for bit, name, _ in RULES}
    rows = [(p.name, p.version, rule, p.mask, 1 << bits[rule]) for p in policies for rule in p.rules]
    wanted = ledger.sparkSession.createDataFrame(rows, "policy string, version int, rule string, mask long, bit long")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.join(F.broadcast(wanted), failed != 0)  # at most 2 ** len(RULES) x policies x rules pairs
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum(F.when(failed.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum("n").alias("n_rejected"),
        )
    )


def quality_rules(docs: DataFrame, policy: Policy = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fail_bits and the other measurements."""
    base = POLICIES[0]
    return ledger(docs, id_col, text_col).select(
        "doc_id", *MEASURES[:5], (~verdict(base)).alias("base_failed"), (verdict(base) & verdict(policy)).alias("kept"), "fail_bits", *MEASURES[5:]
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
  SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM words) WHERE len(g) = 5),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM wins, range(5) r(j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
  length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower, length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))::BIGINT AS n_wide FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  fail_bits & {mask} = 0 AS kept, fail_bits, n_lines, n_upper, n_lower, n_wide FROM f
""".replace("{bits}", " + ".join(f"CASE WHEN {condition} THEN {1 << bit} ELSE 0 END" for bit, _, condition in RULES)).replace("{mask}", str(CURRENT.mask))


#: What ``ablation`` returns over the ledger of ``documents``.
ABLATION_SQL = f"WITH ledger AS ({SQL})," + """
p(policy, version, rule, mask, bit) AS (VALUES {rows})
SELECT policy, version, rule, (count(*) FILTER (WHERE fail_bits & bit <> 0))::BIGINT AS n_failed, (count(*) FILTER (WHERE fail_bits & mask = bit))::BIGINT AS n_only_this, count(*)::BIGINT AS n_rejected
FROM ledger JOIN p ON fail_bits & mask <> 0 GROUP BY policy, version, rule
""".replace("{rows}", ", ".join(f"('{p.name}', {p.version}, '{name}', {p.mask}, {1 << bit})" for p in POLICIES for bit, name, _ in RULES if name in p.rules))
