import json
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from jobs import common, marker_scan, null_report, queries
from locusflow.operators import nulls
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def documents(n, first=0):
    rng = random.Random(first)
    words = [f"w{i}" for i in range(12)]
    out = []
    for i in range(first, first + n):
        source = rng.choice(["a", "b", "c", None])
        share = {"a": 0.7, "b": 0.3}.get(source, 0.5)
        out.append((i, " ".join(w if k % 3 else w.upper() for k, w in enumerate(words) if rng.random() < share) + ", é!", rng.choice(["en", "en", "fr", None]), source, 1))
    return [*out, (first, None, "en", "a", None), (first, "", "fr", None, 0)]


def counted(rows):
    """(lang, source) sizes and carriers by (lang, word, source), in plain Python."""
    sizes, carry = Counter(), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "und", source or "unknown"
        sizes[lang, source] += 1
        for w in {w.strip(",!").lower() for w in (text or "").split()} - {""}:
            carry[lang, w][source] += 1
    return sizes, carry


def haploid_fst(sizes, carriers):
    """Weir and Cockerham's FST of one biallelic marker whose genotypes are all homozygous."""
    n = {s: float(x) for s, x in sizes.items()}
    r, total = len(n), sum(n.values())
    nbar, nc = total / r, (total - sum(x * x for x in n.values()) / total) / (r - 1)
    out = [0.0, 0.0, 0.0]
    p = sum(carriers.get(s, 0) for s in n) / total
    s2 = sum(x * (carriers.get(s, 0) / x - p) ** 2 for s, x in n.items()) / ((r - 1) * nbar)
    inner = p * (1 - p) - (r - 1) / r * s2
    for _ in range(2):  # both alleles
        out[0] += nbar / nc * (s2 - inner / (nbar - 1))
        out[1] += nbar / (nbar - 1) * inner
    return out[0] / sum(out)


def scanned(df):
    return sorted(map(tuple, df.select("lang", "word", "n_docs", "n_sources", "fst", "g", "outlier").collect()))


def test_marker_scan_takes_only_what_is_new(spark, tmp_path):
    at = {"min_carriers": 5, "outlier_fst": 0.05}
    first, second = documents(150), documents(130, 1000)
    place = [f"{tmp_path}/{x}" for x in ("docs", "out", "checkpoint")]
    spark.createDataFrame(first, DOCS).repartition(3).write.parquet(place[0])
    one = scanned(marker_scan.run(spark, *place, at))
    batches = spark.read.parquet(f"{place[1]}/counts").select("batch").distinct().count()
    assert scanned(marker_scan.run(spark, *place, at)) == one  # nothing new
    assert spark.read.parquet(f"{place[1]}/counts").select("batch").distinct().count() == batches
    spark.createDataFrame(second, DOCS).coalesce(1).write.mode("append").parquet(place[0])
    both = scanned(marker_scan.run(spark, *place, at))
    assert both != one
    other = [place[0], f"{tmp_path}/out2", f"{tmp_path}/checkpoint2"]
    assert scanned(marker_scan.run(spark, *other, at)) == both  # all at once
    sizes, carry = counted(first + second)
    want = {}
    for (lang, word), own in carry.items():
        of = {s: n for (la, s), n in sizes.items() if la == lang}
        if 5 <= sum(own.values()) <= sum(of.values()) - 5:
            want[lang, word] = sum(own.values()), len(own), haploid_fst(of, own)
    assert {(r[0], r[1]) for r in both} == set(want)
    for lang, word, n_docs, n_sources, fst, _, outlier in both:
        assert (n_docs, n_sources) == want[lang, word][:2] and fst == pytest.approx(want[lang, word][2], abs=1e-7) and outlier == (fst >= 0.05)


def test_marker_scan_makes_a_batch_again(spark, tmp_path):
    """What an earlier try left under the number of a batch isn't counted twice."""
    place = [f"{tmp_path}/{x}" for x in ("docs", "out", "checkpoint")]
    spark.createDataFrame(documents(60), DOCS).coalesce(1).write.parquet(place[0])
    clean = scanned(marker_scan.run(spark, place[0], f"{tmp_path}/clean", f"{tmp_path}/clean-checkpoint", {"min_carriers": 2}))
    spark.createDataFrame([("en", "a", "w1", 99)], marker_scan.COUNTS).write.parquet(f"{place[1]}/counts/batch=0")
    assert scanned(marker_scan.run(spark, *place, {"min_carriers": 2})) == clean


def test_marker_scan_without_documents(spark, tmp_path):
    place = [f"{tmp_path}/{x}" for x in ("docs", "out", "checkpoint")]
    spark.createDataFrame([], DOCS).write.parquet(place[0])
    assert marker_scan.run(spark, *place).count() == 0
    only = spark.createDataFrame([(1, None, None, None, None)] * 3, DOCS)
    only.write.mode("append").parquet(place[0])
    assert marker_scan.run(spark, *place, {"min_carriers": 1}).count() == 0


def test_settings(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown settings: x"):
        common.settings({"a": 1}, {"x": 2})
    (tmp_path / "c.json").write_text('{\n "a": [1, 2]\n}')
    assert common.read_settings(spark, f"file://{tmp_path}/c.json") == {"a": [1, 2]} and common.read_settings(spark, None) == {}
    for name, module in (("marker_scan", marker_scan), ("null_report", null_report)):
        with open(f"{common.ROOT}/jobs/{name}.json", encoding="utf-8") as f:
            assert set(json.load(f)) <= set(module.DEFAULTS)


def reported(df):
    return sorted(map(tuple, df.select("analysis", "locus", "pop1", "pop2", "statistic", "value").collect()), key=str)


def test_null_report_replaces_only_its_analyses(spark, tmp_path):
    at = {"n_boot": 5, "n_perm": 5, "seed": 3, "analyses": ["frequencies", "summary"]}
    out = f"{tmp_path}/report"
    one = reported(null_report.run(spark, SMALL, out, at))
    assert reported(null_report.run(spark, SMALL, out, at)) == one and {r[0] for r in one} == {"frequencies", "summary"}
    two = reported(null_report.run(spark, SMALL, out, at | {"analyses": ["regression", "mantel"]}))
    assert [r for r in two if r[0] in at["analyses"]] == one and {r[0] for r in two} == {"frequencies", "summary", "regression", "mantel"}
    with pytest.raises(ValueError, match="no such analyses: x"):
        null_report.run(spark, SMALL, out, {"analyses": ["x"]})


@pytest.mark.parametrize("name", ["job2_marker_scan", "job1_null_report"])
def test_registered_jobs_equal_their_sql(spark, name):
    got = queries.queries()[name](spark, SMALL)
    con = duckdb.connect()
    for table in ("customer", "nation", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(got.columns)
    clean = lambda row: tuple(None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
    want, have = sorted(map(clean, res.fetchall()), key=str), sorted((clean(r[c] for c in names) for r in got.collect()), key=str)
    assert len(want) == len(have) > 0
    for a, b in zip(have, want, strict=True):
        assert all(x == y or x == pytest.approx(y, abs=2e-6) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def named(spark):
    """Genotypes as files give them: names of populations as text, null codes, blanks."""
    rng = random.Random(8)
    rows = [(i, f"site {'abcde'[i % 5]}", f"L{j}", *rng.choice([(0, 0), (999, 999), (101, 101), (101, 103), (103, 105), (105, 105), (101, 105)])) for i in range(200) for j in range(4)]
    return spark.createDataFrame(rows, "indiv long, pop string, locus string, a1 int, a2 int").persist()


def test_null_alleles_of_named_populations(spark, named):
    numbered = named.withColumn("pop", F.ascii(F.substring("pop", 6, 1)) - 97)
    wide = numbered.withColumn("a1", F.col("a1").cast("long")).withColumn("a2", F.col("a2").cast("long"))
    treat = nulls.suggest_treatments(named)
    key = lambda df: sorted(df.collect(), key=str)
    want = key(nulls.em_long(nulls.em_table(named, treat)).withColumn("pop", F.ascii(F.substring("pop", 6, 1)) - 97))
    assert key(nulls.em_long(nulls.em_table(numbered, treat))) == want
    assert [tuple(r) for r in key(nulls.em_long(nulls.em_table(wide, treat)))] == [tuple(r) for r in want]


def test_intervals_of_shared_draws_both_ways(spark, named):
    sizes, rows = nulls.inputs(nulls.em_table(named, nulls.suggest_treatments(named)))
    parts = nulls.paired(sizes, rows, nulls.pairs(named))
    pair = nulls.pair_components(*parts).filter("NOT (pop1 = 'site a' AND locus = 'L2')")  # loci that some pairs lack
    args = nulls.both(sizes, rows, ["locus"]), pair, nulls.chord(*parts), 30, 5, 0.9
    key = lambda df: {(r["statistic"], r["pop1"], r["pop2"]): (r["ci_l"], r["ci_u"]) for r in df.collect()}
    fast, slow = key(nulls.shared_intervals(*args)), key(nulls.shared_intervals_relational(*args))
    assert fast.keys() == slow.keys() and len(fast) == 42
    for k, ends in fast.items():
        assert ends == pytest.approx(slow[k], abs=1e-12)


def paired_rows(df, by=("pop1", "pop2", "locus")):
    return {tuple(r[c] for c in by): tuple(v for k, v in r.asDict().items() if k not in by) for r in df.collect()}


@pytest.mark.parametrize("block", [2, 256])
def test_pairs_by_blocks_equal_rows_of_pairs(spark, named, block, monkeypatch):
    monkeypatch.setattr(nulls, "POP_BLOCK", block)
    lone = spark.createDataFrame([(900, "site f", "L0", 0, 0), (901, "site g", "L1", 777, 777), (902, "site h", "L1", 777, 777)], named.schema)  # nothing but blanks, and two that are alike
    geno = named.filter("NOT (pop = 'site c' AND locus = 'L3')").unionByName(lone)
    sizes, rows = nulls.inputs(nulls.em_table(geno, nulls.suggest_treatments(geno)))
    parts = nulls.paired(sizes, rows, nulls.pairs(geno))
    for fast, slow in ((nulls.pairwise_components(sizes, rows), nulls.pair_components(*parts)), (nulls.pairwise_chord(sizes, rows), nulls.chord(*parts))):
        slow = slow.select(fast.columns)
        assert dict(fast.dtypes) == dict(slow.dtypes)
        have, want = paired_rows(fast), paired_rows(slow)
        assert have.keys() == want.keys() and len(have) == 28 * 4
        for k, v in have.items():
            assert v == pytest.approx(want[k], abs=1e-10)
