import re

from pyspark.sql import functions as F

from locusflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in wins:
        count[w] = count.get(w, 0) + 1
    hit = {i + j for i, w in enumerate(wins) if count[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures_against_brute_force(docs):
    got = quality.quality_rules(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) >= docs.filter("doc_id IS NOT NULL").count()
    for r in got:
        n, chars, symbols, lines, repeated = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated), r.text
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)


def test_rows_stay_whole(docs, empty):
    assert quality.ledger(docs).count() == docs.count()
    assert quality.ledger(empty).count() == 0
    assert quality.ablation(quality.ledger(empty)).count() == 0


def test_policies_are_masks_over_the_ledger(docs):
    ledger = quality.ledger(docs).persist()
    for policy in quality.POLICIES:
        want = sum(1 for r in ledger.collect() if not r.fail_bits & policy.mask)
        assert ledger.filter(quality.verdict(policy)).count() == want
    rows = {(r.policy, r.version, r.rule): r for r in quality.ablation(ledger).collect()}
    bits = {name: bit for bit, name, _ in quality.RULES}
    for (name, version, rule), r in rows.items():
        policy = next(p for p in quality.POLICIES if (p.name, p.version) == (name, version))
        own = [x.fail_bits & policy.mask for x in ledger.collect()]
        assert r.n_rejected == sum(1 for b in own if b)
        assert r.n_failed == sum(1 for b in own if b >> bits[rule] & 1)
        assert r.n_only_this == sum(1 for b in own if b == 1 << bits[rule])


def test_filter_keeps_columns_even_with_clashing_names(docs):
    plain = quality.filter_documents(docs)
    assert plain.columns == docs.columns
    clash = docs.withColumn("N_words", F.lit("x")).withColumn("fail_bits", F.lit(1.5))
    got = quality.filter_documents(clash)
    assert got.columns == clash.columns and got.count() == plain.count() > 0
    assert {r.N_words for r in got.collect()} == {"x"}


def test_current_policy_keeps_clean_text_of_other_scripts(spark):
    """Short spaced words and a few Latin capitals don't count against text that is mostly in another script."""
    clean = [
        "日本 の NHK は 今日 新 しい 番 組 を 発 表 し ま し た 。 次 は AI の 話 で す",
        "Сегодня НАТО и AI обсуждали новые правила торговли между странами региона, сообщает NHK после встречи министров",
        "أعلنت الشركة اليوم عن نتائج جديدة في مجال AI والطاقة بعد اجتماع طويل مع NHK في العاصمة",
    ]
    junk = ["A B C D E F G H I J K L M N O P", "BUY THIS NOW AND THEN BUY IT ONCE MORE FOR EVERY FRIEND YOU HAVE"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id int, text string")
    assert sorted(r.doc_id for r in quality.quality_rules(rows).filter("kept").collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in quality.filter_documents(rows).collect()) == [0, 1, 2]
    # the bits of older rules stay, so older policies can still be applied
    assert quality.ledger(rows).filter(quality.verdict(quality.POLICIES[2])).count() < 3
