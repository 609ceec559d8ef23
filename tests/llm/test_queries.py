"""Registered queries that SQL can't express, from table to result, against brute force."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from locusflow.llm import language, queries, tokens, urls

from corpus_data import SCHEMA, VOCABULARY, prose
from test_tokens import brute as attributed
from test_urls import ODD
from test_urls import brute as fixed


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def mined(labelled):
    """Rules of up to three tokens by counting every combination; then those that no part does as well as."""
    sets = [(urls.tokens(u), v) for u, v in labelled]
    n, seen, held = len(sets), Counter(), Counter()
    for own, v in sets:
        for size in (1, 2, 3):
            for c in combinations(own, size):
                seen[c] += 1
                held[c, v] += 1
    rules = {(c, v): k / seen[c] for (c, v), k in held.items() if k >= urls.MIN_SUPPORT * n and k / seen[c] >= urls.MIN_CONFIDENCE}
    worse = lambda c, v, conf: any(rules.get((p, v), -1) >= conf for size in range(1, len(c)) for p in combinations(c, size))
    return {(c, v): (conf, held[c, v] / n) for (c, v), conf in rules.items() if not worse(c, v, conf)}


def test_op4_against_counting(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, u, "<html>") for i, u in enumerate(ODD)]
    for i in range(400):
        host = f"{rng.choice(['www.', 'm.', ''])}{rng.choice(['example', 'site', 'notes'])}.{rng.choice(['org', 'com', 'net', 'io'])}"
        rows.append((100 + i, f"https://{host}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(3000)}{rng.choice(['', '?page=2', '#top'])}", None))
    pages = [*rows, rows[110], (None, rows[120][1], None), (9000, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    labelled = [(u, fixed(u)[3]) for _, u, _ in pages if u is not None and fixed(u)[3]]
    rules = mined(labelled)
    assert len(rules) > 10
    got = queries.op4_url_filter(spark, str(tmp_path)).collect()
    want = []
    for page, url, _ in pages:
        host, path, rule, verdict = fixed(url)
        if rule is None:
            own = set(urls.tokens(url))
            fits = [(-conf, -support, -len(c), c, v) for (c, v), (conf, support) in rules.items() if set(c) <= own]
            verdict = min(fits)[4] if fits else "allow"
        want.append((str(page), host, path, rule, verdict))
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(want, key=key)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_op5_against_bytes(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with open(tokens.RANKS, "rb") as f:
        encoding = tokens.Encoder(tokens.parse_ranks(f.read())).encoding
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        pieces = encoding.decode_tokens_bytes(encoding.encode_ordinary(text))
        ends = np.cumsum([len(x.encode()) for x in lines]).tolist()
        n = attributed(np.cumsum([len(x) for x in pieces]).astype(int).tolist(), ends, "most") if text else [0.0]
        at = 0
        for i, (line, k) in enumerate(zip(lines, n, strict=True)):
            want[str(r.doc_id), "text", i, at, at + len(line), k] += 1
            at += len(line)
    got = Counter((str(r.doc_id), r.field, r.section, r.start, r.end, r.n_tokens) for r in queries.op5_token_counts(spark, str(tmp_path)).collect())
    assert got == want


def profile(text):
    """The sum of the bound trigrams of a text, one at a time."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    words = letters.split()
    if not words:
        return None
    padded, out = f" {' '.join(words)} ", np.zeros(language.DIM)
    vector = {c: language.letter_vectors(np.array([ord(c)]))[0].astype(int) for c in set(padded)}
    for gram, n in Counter(zip(padded, padded[1:], padded[2:], strict=False)).items():
        out += n * np.roll(vector[gram[0]], 2) * np.roll(vector[gram[1]], 1) * vector[gram[2]]
    return out / np.linalg.norm(out)


def test_op7_against_single_trigrams(spark, tmp_path):
    rng = random.Random(31)
    rows = []
    for i in range(160):
        lang = rng.choice(list(VOCABULARY))
        rows.append((i, prose(rng, lang, rng.randint(3, 60)), lang if i % 7 else None, "s", 0))
    rows += [(500, None, "en", "s", 0), (501, "12 34 !!", "de", "s", 0), (502, "", None, "s", 0), (None, prose(rng, "fr", 20), "fr", "s", 0), rows[3], rows[3]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    total = {}
    for doc, text, lang, *_ in rows:
        held = doc is not None and remainder(doc, 4) == 2
        if not held and lang and (v := profile(text)) is not None:
            total[lang] = total.get(lang, 0) + v
    prototypes = {k: v / np.linalg.norm(v) for k, v in total.items()}
    got = sorted(queries.op7_language_id(spark, str(tmp_path)).collect(), key=lambda r: (str(r.doc_id), r.lang_pred))
    assert len(got) == len(rows)
    want = []
    for doc, text, *_ in rows:
        v = profile(text)
        best = max(sorted(prototypes), key=lambda k: prototypes[k] @ v) if v is not None else "und"
        want.append((doc, doc is not None and remainder(doc, 4) == 2, best, min(max(float(prototypes[best] @ v), 0), 1) if v is not None else 0.0))
    for r, w in zip(got, sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert (r.doc_id, r.held_out, r.lang_pred) == w[:3] and r.score == pytest.approx(w[3], abs=1e-4)


def test_fixed_columns_come_first(spark, docs, tmp_path):
    """Names and types that callers rely on."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.org/x", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, [0.5, float(i)]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {
        "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
        "op6_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op10_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    }
    for name, columns in want.items():
        types = [f"{n} {t}" for n, t in queries.queries()[name](spark, str(tmp_path)).dtypes]
        assert types[: columns.count(",") + 1] == columns.split(", "), name
