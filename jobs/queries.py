"""The jobs as registered queries: each runs twice into the same new folder and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import marker_scan, null_report
from locusflow.plans import null_queries as nq
from locusflow.plans import oracle
from locusflow.sources.folders import shared_folder

REPLICATES = {"n_boot": nq.B, "n_perm": nq.B, "seed": nq.SEED, "conf": 1 - nq.ALPHA, "null_homo": list(nq.HOMO)}


def job1_null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/null-report-{uuid.uuid4().hex}"
    null_report.run(spark, sf_dir, place, REPLICATES)
    return null_report.run(spark, sf_dir, place, REPLICATES)


def job2_marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/marker-scan-{uuid.uuid4().hex}"
    for _ in range(2):
        out = marker_scan.run(spark, f"{sf_dir}/documents.parquet", f"{place}/out", f"{place}/checkpoint")
    return out


# -- SQL -----------------------------------------------------------------------------------


def _named(sql: str) -> str:
    """The same over populations with names."""
    sql = sql.replace("geno AS (", "numbered AS (", 1)
    return sql.replace("valid AS (", "geno AS (SELECT indiv, n_name AS pop, locus, a1, a2, coded FROM numbered JOIN nation ON pop = n_nationkey),\nvalid AS (", 1)


def _long(analysis: str, sql: str, values: list[str], locus: str = "NULL", pop1: str = "NULL", pop2: str = "NULL", front: str = "''") -> str:
    cells = ", ".join(f"{{'s': {front} || '{v}', 'v': round({v}::DOUBLE, {3 if v == 'd' else 6})}}" for v in values)
    return f"SELECT locus, pop1, pop2, x.s AS statistic, x.v AS value, '{analysis}' AS analysis FROM (SELECT {locus}::VARCHAR AS locus, {pop1}::VARCHAR AS pop1, {pop2}::VARCHAR AS pop2, unnest([{cells}]) AS x FROM ({sql}))"


_O = nq.oracle_sql()
_LIN = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(0.9999, {x})) / (1 - greatest(0, least(0.9999, {x}))) END"
_IBD = (
    *nq.P_, nq.wc_sql("pop1, pop2, locus", "ptb", "pal"), "pt AS (SELECT n_name AS pop, 10 + (n_nationkey * 37 % 97) * 0.1::DOUBLE AS lat, 5 + (n_nationkey * 53 % 89) * 0.1::DOUBLE AS lon FROM nation WHERE n_name IN (SELECT pop FROM geno))", nq._VINCENTY,
    f"fp AS ({nq.POOL('wc', 'pop1, pop2, ')}), ib AS (SELECT pop1, pop2, d, CASE WHEN d > 0 THEN ln(d) END AS ln_d, {_LIN('fst_raw')} AS fr_raw, {_LIN('fst_ena')} AS fr_ena FROM fp LEFT JOIN vd USING (pop1, pop2))",
)
_LINES = f"ln_ AS ({nq._LINE('raw', 'fr_raw', 'ln_d')} UNION ALL {nq._LINE('corrected', 'fr_ena', 'ln_d')}), lb2 AS (SELECT *, round(slope, 4) AS b FROM ln_)"
_TEST = "ob AS (SELECT corr(x, y) AS o, count(*) AS n_pairs FROM mt), nl AS (SELECT rep, corr(x, py) AS s FROM pm WHERE py IS NOT NULL GROUP BY rep), pv AS (SELECT (count(*) FILTER (WHERE s >= o - 1.4901161193847656e-08) + 1) / (count(s) + 1) AS p, (count(*) FILTER (WHERE s <= o + 1.4901161193847656e-08) + 1) / (count(s) + 1) AS n, count(s) AS n_perm FROM nl, ob)"
_PAIRS = f"SELECT * FROM ({_named(_O['fst_pair'])}) JOIN ({_named(_O['dcse_pair'])}) USING (pop1, pop2)"
_INTERVALS = " UNION ALL ".join(
    f"SELECT '{v}' AS statistic, {pops}, {v}_lo AS lo, {v}_hi AS hi FROM ({_named(_O[src])})"
    for src, pops, names in (("boot_loci_ena", "NULL AS pop1, NULL AS pop2", ("fst_raw", "fst_ena")), ("boot_loci_pair", "pop1, pop2", ("fst_raw", "fst_ena")), ("boot_loci_dcse", "pop1, pop2", ("dcse_raw", "dcse_ina")))
    for v in names
)

REPORT_SQL = " UNION ALL ".join([
    _long("frequencies", _named(_O["null_t1"]), ["p_nulls", "n", "n_blanks", "n_exp_blanks"], locus="locus", pop1="subsample"),
    _long("summary", _named(_O["null_t2"]), ["av_n_exp_blanks", "av_p_nulls", "n_tot", "n_blanks", "f_exp_blanks", "p_value"], locus="locus"),
    _long("pairs", _PAIRS, ["fst_raw", "fst_ena", "dcse_raw", "dcse_ina"], pop1="pop1", pop2="pop2"),
    _long("pairs", _INTERVALS, ["lo", "hi"], pop1="pop1", pop2="pop2", front="statistic || ' '"),
    _long("distance", _named(nq.q(*_IBD, "SELECT * FROM ib")), ["d", "ln_d", "fr_raw", "fr_ena"], pop1="pop1", pop2="pop2"),
    _long("regression", _named(nq.q(*_IBD, _LINES, "SELECT *, CASE WHEN b <> 0 THEN 1 / b END AS nb, CASE WHEN b <> 0 THEN 1 / b / (2 * pi()) END AS nem FROM lb2")), ["slope", "intercept", "r2", "n", "b", "nb", "nem"], front="line || ' '"),
    _long("mantel", _named(nq.q(*_IBD, "mt AS (SELECT pop1, pop2, ln_d AS x, fr_ena AS y FROM ib WHERE ln_d IS NOT NULL AND fr_ena IS NOT NULL)", nq.PERM, _TEST, "SELECT o AS stat, p AS p_pos, n AS p_neg, least(1.0, 2 * least(p, n)) AS p_two, n_pairs, n_perm FROM ob, pv")), ["stat", "p_pos", "p_neg", "p_two", "n_pairs", "n_perm"]),
])

_AT = marker_scan.DEFAULTS
SCAN_SQL = oracle.query(
    f"""own AS (SELECT coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS pop, list_filter(list_distinct(regexp_split_to_array(translate(coalesce(text, ''), '{marker_scan.UPPER}', '{marker_scan.LOWER}'), '[^\\p{{L}}\\p{{N}}]+')), lambda w: w <> '') AS ws FROM documents),
size AS (SELECT lang, pop, count(*) AS size FROM own GROUP BY ALL),
carry AS (SELECT lang, pop, word, count(*) AS k FROM (SELECT lang, pop, unnest(ws) AS word FROM own) GROUP BY ALL),
mark AS (SELECT lang, word, sum(k)::BIGINT AS n_docs, count(*) AS n_sources FROM carry GROUP BY ALL HAVING sum(k) >= {_AT["min_carriers"]}),
kept AS (SELECT mark.* FROM mark JOIN (SELECT lang, sum(size) AS whole FROM size GROUP BY lang) USING (lang) WHERE whole - n_docs >= {_AT["min_carriers"]}),
cell AS (SELECT lang, word AS locus, pop, size, coalesce(k, 0) AS k FROM kept JOIN size USING (lang) LEFT JOIN carry USING (lang, word, pop)),
cnt AS (SELECT * FROM (SELECT lang, locus, pop, unnest([0, 1]) AS allele, unnest([2 * (size - k), 2 * k]) AS c, 0 AS h FROM cell) WHERE c > 0),
n AS (SELECT lang, locus, pop, size::DOUBLE AS n, 0.0::DOUBLE AS n_het FROM cell)""",
    oracle.components("lang, "),
    oracle.g_sql("lang, "),
    f"SELECT lang, word, n_docs, n_sources, R(fst) AS fst, R(g / 2) AS g, fst >= {_AT['outlier_fst']} AS outlier FROM kept JOIN (SELECT lang, locus AS word, fst FROM f) USING (lang, word) JOIN (SELECT lang, locus AS word, g FROM g) USING (lang, word)",
    geno=False,
)


def queries() -> dict:
    return {f.__name__: f for f in (job1_null_report, job2_marker_scan)}


def oracle_sql() -> dict[str, str]:
    return {"job1_null_report": REPORT_SQL, "job2_marker_scan": SCAN_SQL}
