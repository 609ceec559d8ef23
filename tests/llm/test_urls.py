import re

import pytest
from pyspark.sql import functions as F

from locusflow.llm import urls

ODD = [None, "", "no scheme", "://", "http://", "HTTP://Blog.Example.ORG", "http://example.org/es/1", "http://a.example.org/en/1234?x", "http://example.org/en/2#f", "http://notexample.org/es/x",
       "https://x.com/fr/1", "https://x.com/de/1", "https://x.com/en/1", "http://com/fr/", "http://a.net?q=http://b.org/", "ftp://ÄÖ.org/x", "http://a.org:80/x", "x http://two.org/a://b.com/de/", "http://y.net/\nz"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in urls.FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda r: len(r[0])) if fits else (None, None))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "<html>") for i, u in enumerate(ODD)]
    for i in range(300):
        rows.append((1000 + i, f"https://m.site{i % 5}.example.{['com', 'org', 'net'][i % 3]}/{['en', 'fr', 'de', 'es'][i % 4]}/{i}" + ("?page=2&ref=x" if i % 7 == 0 else ""), None))
    return spark.createDataFrame([*rows, rows[3], (None, "http://n.org/", None)], "page_id long, url string, html string")


def test_hosts_paths_and_fixed_rules(pages):
    got = urls.judge(pages.withColumn("Verdict", F.lit(0)).withColumn("host", F.lit(1))).collect()
    by = {r.page_id: r.url for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        host, path, rule, verdict = brute(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), by[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert rule is None or r.mined is None


def test_mined_rules_against_counting(pages):
    labelled = [(r.url, brute(r.url)[3]) for r in pages.collect() if r.url and brute(r.url)[3]]
    spark = pages.sparkSession
    rules = urls.mine(spark.createDataFrame(labelled, "url string, verdict string"), min_support=0.02, min_confidence=0.9)
    assert rules
    sets = [(set(urls.tokens(u)), v) for u, v in labelled]
    for r in rules:
        held = [v for t, v in sets if set(r.tokens) <= t]
        assert r.confidence == pytest.approx(held.count(r.verdict) / len(held)) and r.confidence >= 0.9
        assert r.support == pytest.approx(held.count(r.verdict) / len(sets)) and r.support >= 0.02
        assert not any(o is not r and set(o.tokens) < set(r.tokens) and o.verdict == r.verdict and o.confidence >= r.confidence for o in rules)


def test_index_against_scanning():
    rules = sorted([urls.Rule(("a", "b"), "block", 0.9, 0.1), urls.Rule(("a",), "allow", 0.85, 0.5), urls.Rule(("c",), "block", 0.95, 0.2)], key=urls._rank)
    index = urls.Index(rules)
    for found in (["a"], ["a", "b"], ["b"], ["a", "b", "c"], [], ["c", "z"]):
        want = next((r for r in rules if set(r.tokens) <= set(found)), None)
        assert index.match(found) == want


def test_no_rows_and_no_labels(pages):
    assert urls.judge(pages.limit(0)).count() == 0
    got = urls.judge(pages.filter("page_id < 3")).collect()
    assert {r.verdict for r in got} == {"allow"} and {r.mined for r in got} == {None}


def test_redundant_rules_take_no_places(pages, monkeypatch):
    """The bound counts what pruning leaves, and nothing is cut silently."""
    labelled = pages.sparkSession.createDataFrame([(r.url, brute(r.url)[3]) for r in pages.collect() if r.url and brute(r.url)[3]], "url string, verdict string").persist()
    whole = urls.mine(labelled)
    monkeypatch.setattr(urls, "MAX_RULES", len(whole))
    assert urls.mine(labelled) == whole and whole == urls.pruned(whole)
    monkeypatch.setattr(urls, "MAX_RULES", len(whole) - 1)
    with pytest.raises(ValueError, match="after pruning"):
        urls.mine(labelled)


def test_mined_rules_on_labelled_pages_held_out(spark):
    """A third of the pages that the fixed rules label is kept from mining; mined rules alone judge it."""
    split = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").distinct()
    rule, verdict = urls.fixed_rule(urls.host(F.col("url")), urls.path(F.col("url")))
    known = split.withColumn("verdict", verdict).filter("verdict IS NOT NULL").withColumn("held_out", F.crc32("url") % 3 == 1).persist()
    index = urls.Index(urls.mine(known.filter("NOT held_out").select("url", "verdict")))
    judged = [(r.verdict, index.match(urls.tokens(r.url))) for r in known.filter("held_out").collect()]
    hits = [(v, m.verdict) for v, m in judged if m]
    block = [(v, m.verdict if m else urls.DEFAULT) for v, m in judged]
    right = sum(v == m for v, m in hits) / len(hits)
    precision = sum(v == m == "block" for v, m in block) / max(1, sum(m == "block" for _, m in block))
    recall = sum(v == m == "block" for v, m in block) / sum(v == "block" for v, _ in block)
    print(f"held out {len(judged)}, matched {len(hits)}, right {right:.4f}, block precision {precision:.4f}, recall {recall:.4f}")
    assert len(judged) > 300 and len(hits) >= 0.9 * len(judged) and right >= 0.95 and precision >= 0.9 and recall >= 0.9
