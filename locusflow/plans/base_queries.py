"""Registered queries: counts, F statistics, diversities, frequencies, G statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pack_gt, r8, unpack_gt
from ..operators import counts, diversity, frequencies, gstat, wc84
from . import oracle
from .fixtures import genotypes

Query = Callable[[SparkSession, str], DataFrame]
POPS = list(range(25))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r8(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def _counts(spark, d):
    return counts.allele_counts(genotypes(spark, d))


F_COLS = ("fst", "fit", "fis", "hi", "hs", "ht")
WC = (oracle.counts(), oracle.components())
RF = ", ".join(f"R({c}) AS {c}" for c in F_COLS)


def geno_decode(spark, d):
    g = genotypes(spark, d).withColumn("gt", pack_gt(F.col("a1"), F.col("a2")))
    x, y = unpack_gt(F.col("gt"))
    return g.select("indiv", "pop", "locus", "gt", x.alias("a1"), y.alias("a2"))


def wc84_components(spark, d):
    return rounded(wc84.locus_stats(_counts(spark, d)).select("locus", "a", "b", "c", "hs", "ht"), "a", "b", "c", "hs", "ht")


BASIC = ("ho", "hs", "ht", "fit_wc", "fis_wc", "fst_wc", "fis_nei", "fst_nei", "fst_max", "fst_prime_meirmans", "fst_prime_hedrick", "gst", "gst2")

_SPARK: dict[str, Query] = {
    "geno_decode": geno_decode,
    "geno_counts": lambda s, d: counts.genotype_counts(genotypes(s, d)),
    "allele_counts": _counts,
    "missing_by_pop_locus": lambda s, d: rounded(counts.missing_by_pop_locus(genotypes(s, d)), "missing_share"),
    "pop_sizes": lambda s, d: counts.pop_sizes(genotypes(s, d)),
    "overview": lambda s, d: counts.overview(genotypes(s, d)),
    "pop_codes": lambda s, d: counts.pop_codes(genotypes(s, d)),
    "locus_order": lambda s, d: counts.locus_order(genotypes(s, d)),
    "complete_genotypes": lambda s, d: counts.complete_individuals(genotypes(s, d)).select("indiv", "pop", "locus", "a1", "a2"),
    "pairs_template": lambda s, d: counts.pairs_template(genotypes(s, d)),
    "filtered_genotypes": lambda s, d: counts.valid_genotypes(genotypes(s, d), populations=[3, 7], loci=["L2", "L5"]).select("indiv", "pop", "locus", "a1", "a2"),
    "wc84_components": wc84_components,
    "wc84_observed": lambda s, d: rounded(wc84.observed(_counts(s, d)), *F_COLS),
    "wc84_overall": lambda s, d: rounded(wc84.overall(wc84.locus_stats(_counts(s, d))), *F_COLS),
    "wc84_per_allele": lambda s, d: rounded(wc84.per_allele(_counts(s, d)), "freq", "fis", "fst", "fit"),
    "fis_msg_locus": lambda s, d: rounded(wc84.fis_by_locus(_counts(s, d)), "fis"),
    "fis_msg_overall": lambda s, d: rounded(wc84.fis_overall(_counts(s, d)), "fis"),
    "fis_by_pop_wc84": lambda s, d: rounded(wc84.fis_by_pop(_counts(s, d)), "fis"),
    "fis_by_pop_nei": lambda s, d: rounded(diversity.fis_by_pop_biased(_counts(s, d)), "fis"),
    "fis_locus_pop": lambda s, d: rounded(wc84.fis_locus_pop(_counts(s, d)), "fis"),
    "nei_het": lambda s, d: rounded(diversity.nei(_counts(s, d)), "ho", "hs", "ht"),
    "basic_stats": lambda s, d: rounded(diversity.basic_stats(_counts(s, d)), *BASIC),
    "fst_max_meirmans": lambda s, d: rounded(diversity.fst_max(_counts(s, d)), "fst_max"),
    "hs_by_pop_locus": lambda s, d: rounded(diversity.hs_by_pop_locus(_counts(s, d)), "ho", "hs"),
    "hs_by_pop_wide": lambda s, d: rounded(diversity.hs_wide(_counts(s, d), POPS), *[f"p{p}" for p in POPS]),
    "pop_stats_overall": lambda s, d: rounded(diversity.pop_stats_overall(_counts(s, d)), "ho", "hs", "fis"),
    "pop_stats_one": lambda s, d: rounded(diversity.pop_stats_one(_counts(s, d), 4), "ho", "hs", "fis"),
    "fit_hi_hs": lambda s, d: rounded(diversity.hi_hs(_counts(s, d)), "fst", "fit", "hi", "hs"),
    "fit_overall": lambda s, d: rounded(wc84.overall(wc84.locus_stats(_counts(s, d))).select("fit"), "fit"),
    "hs_f": lambda s, d: rounded(diversity.hs_f(_counts(s, d)), "hi", "hs"),
    "allele_freq_long": lambda s, d: frequencies.long_table(genotypes(s, d)),
    "allele_freq_wide": lambda s, d: frequencies.wide_report(frequencies.long_table(genotypes(s, d)), POPS),
    "allele_freq_one": lambda s, d: frequencies.long_table(genotypes(s, d), population=4, marker="L3"),
    "g_locus": lambda s, d: rounded(gstat.g_by_locus(_counts(s, d)), "g"),
    "g_overall": lambda s, d: rounded(gstat.g_overall(gstat.g_by_locus(_counts(s, d))), "g"),
    "g_complete": lambda s, d: rounded(gstat.g_by_locus(counts.allele_counts(counts.complete_individuals(genotypes(s, d))), min_alleles=2), "g"),
    "ld_g": lambda s, d: rounded(gstat.linkage(genotypes(s, d)), "g"),
    "ld_g_all": lambda s, d: rounded(gstat.ld_all(gstat.linkage(genotypes(s, d))), "g"),
}

PRIVATE = """pv AS (SELECT indiv, pop, locus, pop || '|' || a1 AS a1, pop || '|' || a2 AS a2 FROM valid)"""
COMPLETE = """full_ AS (SELECT indiv FROM valid GROUP BY indiv HAVING count(DISTINCT locus) = (SELECT count(DISTINCT locus) FROM valid)),
complete AS (SELECT v.* FROM valid v JOIN full_ USING (indiv))"""
CL = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END"
_BS = f"""
bs AS (SELECT h.locus AS id, h.ho, h.hs, raw.ht, f.fit, f.fis, f.fst, mf.fst AS fst_max, raw.r::DOUBLE AS k FROM hs h JOIN raw USING (locus) LEFT JOIN f USING (locus) LEFT JOIN m_f mf USING (locus)
  UNION ALL SELECT 'Overall', (SELECT avg(ho) FROM hs), (SELECT avg(hs) FROM hs), (SELECT avg(ht) FROM raw), {CL("o.fit")}, {CL("o.fis")}, {CL("o.fst")}, mo.fst, (SELECT count(DISTINCT pop) FROM n)::DOUBLE FROM o, m_o mo)"""
_BSEL = f"""SELECT id, R(ho) AS ho, R(hs) AS hs, R(ht) AS ht, R({CL("fit")}) AS fit_wc, R({CL("fis")}) AS fis_wc, R({CL("fst")}) AS fst_wc, R({CL("CASE WHEN hs > 0 THEN 1 - ho / hs END")}) AS fis_nei,
R({CL("CASE WHEN ht > 0 THEN 1 - hs / ht END")}) AS fst_nei, R({CL("fst_max")}) AS fst_max, R({CL("CASE WHEN fst_max > 0 THEN fst / fst_max END")}) AS fst_prime_meirmans, R({CL("CASE WHEN hs < 1 THEN fst / (1 - hs) END")}) AS fst_prime_hedrick,
R({CL("CASE WHEN ht > 0 THEN 1 - hs / ht END")}) AS gst, R({CL("CASE WHEN k > 1 AND hs <> 1 AND k * ht <> hs THEN k * (ht - hs) / ((k * ht - hs) * (1 - hs)) END")}) AS gst2 FROM bs"""
LONG = """
cn AS (SELECT pop, locus, allele, count(*) AS n FROM (SELECT pop, locus, unnest([a1, a2]) AS allele FROM geno WHERE a1 > 0) GROUP BY ALL),
tt AS (SELECT pop, locus, sum(n)::BIGINT AS t FROM cn GROUP BY ALL),
gr AS (SELECT p.pop, u.locus, u.allele FROM (SELECT DISTINCT pop FROM cn) p, (SELECT DISTINCT locus, allele FROM cn) u),
fq AS (SELECT gr.*, coalesce(n, 0)::BIGINT AS n, coalesce(t, 0) AS t, coalesce(n / t, 0.0) AS fr FROM gr LEFT JOIN cn USING (pop, locus, allele) LEFT JOIN tt USING (pop, locus)),
dv2 AS (SELECT pop, locus, count(*) AS na, 1.0 / sum(fr * fr) AS ne, 1.0 - sum(fr * fr) AS he FROM fq WHERE fr > 0 GROUP BY ALL),
sm AS (SELECT pop, locus, count(*) FILTER (WHERE a1 > 0) AS g, count(*) FILTER (WHERE NOT a1 > 0) AS m, count(*) FILTER (WHERE a1 > 0 AND a1 <> a2) AS ht FROM geno GROUP BY ALL),
lg AS (SELECT fq.pop, fq.locus AS marker, fq.allele::VARCHAR AS allele, round(fr, 4) AS frequency, n AS count, t AS n_alleles, g AS n_genotyped, m AS n_missing, na, round(ne, 3) AS ne, round(he, 3) AS he,
  round(CASE WHEN g > 0 THEN ht / g END, 3) AS ho, round(CASE WHEN he > 0 AND g > 0 THEN (he - ht / g) / he END, 3) AS fis FROM fq LEFT JOIN dv2 USING (pop, locus) LEFT JOIN sm USING (pop, locus))"""
PAIRS = """nrm AS (SELECT indiv, pop, locus, least(a1, a2) || '/' || greatest(a1, a2) AS g FROM valid),
prs AS (SELECT a.indiv, a.pop, a.locus AS locus1, b.locus AS locus2, a.g AS g1, b.g AS g2 FROM nrm a JOIN nrm b USING (indiv) WHERE a.locus < b.locus)"""


def ld_sql(src: str = "prs", k: str = "") -> str:
    by = f"{k}pop, locus1, locus2"
    return f"""
ce AS (SELECT {by}, g1, g2, count(*) AS o FROM {src} GROUP BY ALL),
lr AS (SELECT {by}, g1, sum(o) AS rw FROM ce GROUP BY ALL), lc AS (SELECT {by}, g2, sum(o) AS cl FROM ce GROUP BY ALL), lt AS (SELECT {by}, sum(o) AS n, count(*) AS cells, count(DISTINCT g1) AS r1, count(DISTINCT g2) AS r2 FROM ce GROUP BY ALL),
ld AS (SELECT {by}, any_value(n)::BIGINT AS n, 2 * sum(o * ln(o * n / (rw * cl)::DOUBLE)) AS g FROM ce JOIN lr USING ({by}, g1) JOIN lc USING ({by}, g2) JOIN lt USING ({by}) WHERE n >= 2 AND cells > 1 AND r1 > 1 AND r2 > 1 GROUP BY {by})"""


def _wide_sql() -> str:
    col = lambda v, p: f"coalesce(max({v}) FILTER (WHERE pop = {p}), '') AS p{p}"
    cols = lambda v: ", ".join(col(v, p) for p in POPS)
    d = lambda c: f"format('{{:.3f}}', {c})"
    one = "(SELECT DISTINCT pop, marker, n_genotyped, n_missing, na, ne, he, ho, fis FROM lg)"
    parts = [f"SELECT marker, 'stat' AS row_type, 'N genotyped' AS row_label, 1.0 AS position, {cols('n_genotyped::VARCHAR')}, sum(n_genotyped)::VARCHAR AS global FROM {one} GROUP BY marker",
             f"SELECT marker, 'stat', 'N missing', 2.0, {cols('n_missing::VARCHAR')}, sum(n_missing)::VARCHAR FROM {one} GROUP BY marker",
             f"SELECT marker, 'allele', allele, 3.0 + allele::DOUBLE / 1e9, {cols(chr(102) + 'ormat(' + chr(39) + '{:.4f}' + chr(39) + ', frequency)')}, format('{{:.4f}}', sum(count) / any_value(mt.t)) FROM lg JOIN (SELECT marker, sum(count) AS t FROM lg GROUP BY marker) mt USING (marker) GROUP BY marker, allele"]
    parts += [f"SELECT marker, 'div_stat', '{s}', {1001 + i}.0, {cols('na::VARCHAR' if s == 'Na' else d(s.lower()))}, '' FROM {one} GROUP BY marker" for i, s in enumerate(("Na", "Ne", "He", "Ho", "Fis"))]
    return "\nUNION ALL ".join(f"({p})" for p in parts)


q = oracle.query
_ORACLE: dict[str, str] = {
    "geno_decode": q("SELECT indiv, pop, locus, (CASE WHEN a1 > 0 AND a2 > 0 THEN a1 * 1000 + a2 ELSE 0 END)::BIGINT AS gt, a1::INT AS a1, a2::INT AS a2 FROM geno"),
    "geno_counts": q("SELECT locus, pop, count(*) AS n, sum((a1 <> a2)::INT)::BIGINT AS n_het FROM valid GROUP BY ALL"),
    "allele_counts": q(oracle.counts(), "SELECT locus, pop, allele, c, h::BIGINT AS h FROM cnt"),
    "missing_by_pop_locus": q("SELECT pop, locus, count(*) AS sample_size, count(*) FILTER (WHERE NOT a1 > 0) AS missing, count(*) FILTER (WHERE a1 > 0) AS genotyped, R(1 - count(*) FILTER (WHERE a1 > 0) / count(*)) AS missing_share FROM geno GROUP BY ALL"),
    "pop_sizes": q("SELECT pop, count(DISTINCT indiv) AS sample_size FROM geno GROUP BY pop"),
    "overview": q("SELECT count(DISTINCT indiv) AS n_individuals, count(DISTINCT pop) AS n_pops, count(DISTINCT locus) AS n_loci, count(*) AS n_cells, count(*) FILTER (WHERE NOT (a1 > 0 AND a2 > 0)) AS n_missing FROM geno"),
    "pop_codes": q("SELECT pop, (dense_rank() OVER (ORDER BY pop))::INT AS pop_code FROM (SELECT DISTINCT pop FROM geno)"),
    "locus_order": q("SELECT locus, min(indiv) AS first_seen FROM geno GROUP BY locus"),
    "complete_genotypes": q(COMPLETE, "SELECT indiv, pop, locus, a1, a2 FROM complete"),
    "pairs_template": q("ps AS (SELECT DISTINCT pop FROM geno)", "SELECT a.pop AS pop1, b.pop AS pop2, NULL::DOUBLE AS distance FROM ps a JOIN ps b ON a.pop < b.pop"),
    "filtered_genotypes": q("SELECT indiv, pop, locus, a1, a2 FROM valid WHERE pop IN (3, 7) AND locus IN ('L2', 'L5')"),
    "wc84_components": q(*WC, "SELECT locus, R(a) AS a, R(b) AS b, R(c) AS c, R(hs) AS hs, R(ht) AS ht FROM loc"),
    "wc84_observed": q(*WC, f"SELECT locus, {RF} FROM f"),
    "wc84_overall": q(*WC, oracle.over(), f"SELECT {RF} FROM o"),
    "wc84_per_allele": q(*WC, "SELECT locus, allele, nt::BIGINT AS n_genotyped, r AS n_pops, R(p) AS freq, R(CASE WHEN b + c <> 0 THEN b / (b + c) END) AS fis, R(CASE WHEN a + b + c <> 0 THEN a / (a + b + c) END) AS fst, R(CASE WHEN a + b + c <> 0 THEN (a + b) / (a + b + c) END) AS fit FROM comp"),
    "fis_msg_locus": q(*WC, oracle.mean_squares("locus"), "SELECT locus, R(CASE WHEN sb + sw <> 0 THEN sb / (sb + sw) END) AS fis FROM ms"),
    "fis_msg_overall": q(*WC, oracle.mean_squares("locus"), "SELECT R(CASE WHEN sum(sb + sw) > 0 THEN sum(sb) / sum(sb + sw) END) AS fis FROM ms"),
    "fis_by_pop_wc84": q(*WC, oracle.mean_squares("pop, locus"), "SELECT pop, R(CASE WHEN sum(sb + sw) > 0 THEN sum(sb) / sum(sb + sw) END) AS fis FROM (SELECT DISTINCT pop, locus FROM n) LEFT JOIN ms USING (pop, locus) GROUP BY pop"),
    "fis_by_pop_nei": q(*WC, "SELECT pop, R(CASE WHEN avg(he) FILTER (WHERE he > 1e-15) > 0 THEN 1 - avg(n_het / n) FILTER (WHERE he > 1e-15) / avg(he) FILTER (WHERE he > 1e-15) END) AS fis FROM div GROUP BY pop"),
    "fis_locus_pop": q(*WC, oracle.mean_squares("pop, locus"), "SELECT pop, locus, R(CASE WHEN sb + sw <> 0 THEN sb / (sb + sw) END) AS fis FROM (SELECT DISTINCT pop, locus FROM n) LEFT JOIN ms USING (pop, locus)"),
    "nei_het": q(*WC, "SELECT locus, R(ho) AS ho, R(hs) AS hs, R(ht) AS ht, r AS k FROM hs JOIN raw USING (locus)"),
    "basic_stats": q(*WC, oracle.over(), PRIVATE, oracle.counts("pv", p="m_"), oracle.components(p="m_"), oracle.over(p="m_"), _BS, _BSEL),
    "fst_max_meirmans": q(PRIVATE, oracle.counts("pv"), oracle.components(), "SELECT locus, R(fst) AS fst_max FROM f"),
    "hs_by_pop_locus": q(*WC, "SELECT pop, locus, n::BIGINT AS n, n_het::BIGINT AS n_het, R(n_het / n) AS ho, R(CASE WHEN n > 1 THEN he * 2 * n / (2 * n - 1) END) AS hs FROM div"),
    "hs_by_pop_wide": q(*WC, "SELECT locus, " + ", ".join(f"R(max(CASE WHEN n > 1 THEN he * 2 * n / (2 * n - 1) END) FILTER (WHERE pop = {p})) AS p{p}" for p in POPS) + " FROM div GROUP BY locus"),
    "pop_stats_overall": q(*WC, "dd AS (SELECT *, CASE WHEN n > 1 THEN he * 2 * n / (2 * n - 1) END AS h FROM div)", "SELECT pop, R(avg(n_het / n)) AS ho, R(avg(h)) AS hs, R(1 - sum(n_het) FILTER (WHERE h > 0) / nullif(sum(n * h) FILTER (WHERE h > 0), 0)) AS fis FROM dd GROUP BY pop"),
    "pop_stats_one": q(*WC, "dd AS (SELECT *, CASE WHEN n > 1 THEN he * 2 * n / (2 * n - 1) END AS h FROM div WHERE pop = 4)", "SELECT locus, R(n_het / n) AS ho, R(h) AS hs, R(CASE WHEN h > 0 THEN 1 - n_het / n / h END) AS fis FROM dd"),
    "fit_hi_hs": q(*WC, "SELECT locus, R(CASE WHEN r > 1 AND a + b + c <> 0 THEN a / (a + b + c) END) AS fst, R(CASE WHEN r > 1 AND a + b + c <> 0 THEN (a + b) / (a + b + c) END) AS fit, R(CASE WHEN r > 1 THEN het / nt END) AS hi, R(CASE WHEN r > 1 THEN hs_b END) AS hs FROM raw JOIN hs USING (locus)"),
    "fit_overall": q(*WC, oracle.over(), "SELECT R(fit) AS fit FROM o"),
    "hs_f": q(*WC, "SELECT locus, R(ho) AS hi, R(hs_f) AS hs FROM hs"),
    "allele_freq_long": q(LONG, "SELECT * FROM lg"),
    "allele_freq_wide": q(LONG, _wide_sql()),
    "allele_freq_one": q(LONG.replace("FROM geno WHERE a1 > 0", "FROM geno WHERE a1 > 0 AND pop = 4 AND locus = 'L3'"), "SELECT * FROM lg"),
    "g_locus": q(oracle.counts(), oracle.g_sql(), "SELECT locus, R(g) AS g, n_geno::BIGINT AS n_geno FROM g"),
    "g_overall": q(oracle.counts(), oracle.g_sql(), "SELECT R(sum(g)) AS g FROM g"),
    "g_complete": q(COMPLETE, oracle.counts("complete"), oracle.g_sql(), "SELECT locus, R(CASE WHEN ka >= 2 THEN g END) AS g, n_geno::BIGINT AS n_geno FROM g"),
    "ld_g": q(PAIRS, ld_sql(), "SELECT pop, locus1, locus2, n, R(g) AS g FROM ld"),
    "ld_g_all": q(PAIRS, ld_sql(), "SELECT locus1, locus2, R(sum(g)) AS g, count(*) AS n_pops FROM ld GROUP BY ALL"),
}


def queries() -> dict[str, Query]:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
