"""URL filters: fixed host rules first, mined association rules for the rest.

Pages that a fixed rule fits are labelled by it.  Spark's FP-growth mines a bounded
sample of them for combinations of URL tokens that imply ``allow`` or
``block``; rules under a confidence or support, and rules that a shorter rule does as well as, are
pruned.  The rest of the pages is matched by an inverted index from tokens to rules:
a rule fires when all of its tokens have been counted.
"""

from __future__ import annotations

import re
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, spare

#: Host, path and verdict of the fixed rules.
FIXED = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.8, 3
#: Bounds: labelled pages that are mined, and rules that are left after pruning (more raise an error).
TRAIN_PAGES, MAX_RULES = 50_000, 5_000
MINE_PARTITIONS = 8
DEFAULT = "allow"
CLASS = "class:"


class Rule(NamedTuple):
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(h: Column, p: Column, rules=FIXED) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones come later and win
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL: scheme, host and its suffixes, path segments (digits as #), names of query parameters, fragment."""
    url = url or ""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return ["none:"]
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    name, slash, where = rest.partition("/")
    labels = name.lower().split(".")
    out = {f"scheme:{scheme.lower()}", *(f"host:{'.'.join(labels[i:])}" for i in range(len(labels))), f"first:{labels[0]}"}
    out |= {f"path:{re.sub(r'[0-9]+', '#', s)}" for s in where.split("/") if s}
    out |= {f"digits:{len(d)}{d[0]}" for d in re.findall(r"[0-9]+", where)}
    out |= {f"query:{q.partition('=')[0]}" for q in query.split("&") if q}
    if fragment:
        out.add("fragment:")
    return sorted(out)


def _tokenised(batches):
    for batch in batches:
        items = [[*tokens(u), CLASS + v] for u, v in zip(batch.column("url").to_pylist(), batch.column("verdict").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"items": pa.array(items, pa.list_(pa.string()))})


def mine(labelled: DataFrame, train: int = TRAIN_PAGES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Rule]:
    """Pruned rules from ``url, verdict``; the sample is about ``train`` rows, by hashed url. No labelled rows give no rules; more than ``MAX_RULES`` after pruning raise."""
    known = labelled.filter("url IS NOT NULL AND verdict IS NOT NULL")
    n = known.agg(F.count("*")).first()[0]
    if not n:
        return []
    sample = known.filter(F.pmod(F.xxhash64(F.lit("url sample"), "url"), F.lit(1_000_000)) < F.lit(train / n * 1_000_000))
    # the sample is small whatever the number of the table's partitions
    items = sample.repartition(MINE_PARTITIONS).mapInArrow(_tokenised, "items array<string>")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=MINE_PARTITIONS).fit(items)
    # the rules of classes among itemsets over the support, themselves bounded
    found = model.associationRules.filter(F.col("consequent")[0].startswith(CLASS) & (F.size("antecedent") <= MAX_TOKENS) & ~F.exists("antecedent", lambda x: x.startswith(CLASS)))
    best = _needed(found.select(F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("class"), "confidence", "support")).limit(MAX_RULES + 1).collect()
    if len(best) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules are left after pruning; mine with a higher support or confidence, or raise MAX_RULES")
    return pruned([Rule(tuple(sorted(r["tokens"])), r["class"][len(CLASS) :], r["confidence"], r["support"]) for r in best])


def _needed(found: DataFrame) -> DataFrame:
    """What ``pruned`` keeps, found before anything is collected: each rule looks for a better one among the subsets of its tokens."""
    token = F.col("tokens")
    parts = [F.transform(token, lambda x: F.array(x)), F.flatten(F.transform(token, lambda x: F.transform(F.filter(token, lambda y: y > x), lambda y: F.array(x, y))))]
    smaller = found.select("tokens", "class", "confidence", F.explode(F.filter(F.concat(*parts), lambda p: F.size(p) < F.size("tokens"))).alias("part"))
    other = found.select(F.col("tokens").alias("part"), "class", F.col("confidence").alias("least"))
    covered = smaller.join(other, ["part", "class"]).filter("least >= confidence").select("tokens", "class")
    return found.join(covered, ["tokens", "class"], "left_anti")


def pruned(rules: list[Rule]) -> list[Rule]:
    """Without the rules whose tokens hold those of another rule of the same verdict and at least the confidence."""
    out: list[Rule] = []
    for r in sorted(rules, key=lambda r: (len(r.tokens), -r.confidence, -r.support, r.tokens)):
        if not any(set(o.tokens) <= set(r.tokens) and o.verdict == r.verdict and o.confidence >= r.confidence for o in out):
            out.append(r)
    return sorted(out, key=_rank)


def _rank(r: Rule):
    return -r.confidence, -r.support, -len(r.tokens), r.tokens


class Index:
    """The inverted index; rules are in order of rank."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for t in r.tokens:
                self.by.setdefault(t, []).append(i)

    def match(self, found: list[str]) -> Rule | None:
        """The best rule all of whose tokens are there."""
        seen: dict[int, int] = {}
        best = len(self.rules)
        for t in found:
            for i in self.by.get(t, ()):
                seen[i] = seen.get(i, 0) + 1
                if i < best and seen[i] == len(self.rules[i].tokens):
                    best = i
        return self.rules[best] if best < len(self.rules) else None


def _judge(batches, url: str, names: tuple[str, str], rules: list[Rule]):
    index = Index(rules)
    for batch in batches:
        hits = [index.match(tokens(u)) for u in batch.column(url).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h.verdict if h else DEFAULT for h in hits], pa.string()), pa.array([" & ".join(h.tokens) if h else None for h in hits], pa.string())], names=[*batch.schema.names, *names])


def judge(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` of each row: the fixed rule's verdict, else the best mined rule's, else allow.

    ``mined`` names the mined rule's tokens where it decided.  A null url, or one without ``://``, has empty host and path and the token
    ``none:``.  Repeated rows each have their own row; html and other columns are not read; no shuffle but the mining's.
    """
    two = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    h, p = host(F.col("url")), path(F.col("url"))
    split = two.withColumn("host", h).withColumn("path", p)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    split = split.withColumn("rule", rule).withColumn("fixed", verdict)
    if rules is None:
        rules = mine(split.select("url", F.col("fixed").alias("verdict")))
    names = spare(split, "learned", "mined")
    out = split.mapInArrow(partial(_judge, url="url", names=tuple(names), rules=rules), extended(split.schema, **dict.fromkeys(names, "string")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", names[0]).alias("verdict"), F.when(F.col("rule").isNull(), F.col(names[1])).alias("mined"))
