"""Registered queries: assembled tables, ingest, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts, kernel
from ..sources import ingest, params
from . import oracle, pipelines
from .base_queries import PAIRS, WC, ld_sql, rounded
from .fixtures import genotypes
from .resample_queries import B, PEOPLE_SQL, POPS_SQL, REP, SEED, _ORACLE as RESAMPLE, _g, alleles_sql, engine, labels_sql, ld_engine

TABLE = ("observed", "boot_mean", "boot_median", "ci_l", "ci_u", "p_value")


def t_fis_by_pop(s, d, n=B):
    return rounded(pipelines.fis_by_pop(_g(s, d), n, n, SEED, engine=engine(n)), *TABLE)


def t_fis_by_locus(s, d, n=B):
    return rounded(pipelines.fis_by_locus(_g(s, d), n, n, SEED, engine=engine(n)), *TABLE)


def t_fit(s, d, n=B):
    return rounded(pipelines.fit_analysis(_g(s, d), n, n, SEED, engine=engine(n)), *TABLE)


def t_fst(s, d, n=B):
    return rounded(pipelines.fst_analysis(_g(s, d), n, n, SEED, engine=engine(n)), *TABLE)


def t_hs(s, d, n=B):
    return rounded(pipelines.hs_tables(_g(s, d), n, SEED, engine=engine(n)), "observed", "boot_mean", "boot_se", "ci_l", "ci_u")


def t_fst_summary(s, d, n=B):
    return rounded(pipelines.summary_scalars(pipelines.fst_analysis(_g(s, d), n, n, SEED, engine=engine(n))), "share_defined", "mean_ci_width", "mean_power_proxy")


def _ld(s, d, n=B):
    return pipelines.ld_matrix(_g(s, d), n, SEED, ld_engine(n))


def ld_pairs_summary(s, d, n=B):
    return rounded(pipelines.ld_summary(_ld(s, d, n)), "min_p", "mean_p")


def ld_pairs_filtered(s, d, n=B):
    return rounded(pipelines.ld_filtered(_ld(s, d, n), 0.06).select("locus1", "locus2", "min_p"), "min_p")


def _wide(s, d):
    """The genotypes as a file would have them: a text column for each locus."""
    g = genotypes(s, d).withColumn("g", F.concat_ws("/", "a1", "a2"))
    return g.groupBy("indiv", F.col("pop").cast("string").alias("Population")).pivot("locus", [f"L{i}" for i in range(1, 7)]).agg(F.first("g"))


def unpivot_string(s, d):
    return ingest.genotypes_string(_wide(s, d), "Population", [f"L{i}" for i in range(1, 7)]).select("indiv", F.col("pop").cast("int").alias("pop"), "locus", "a1", "a2")


def unpivot_paired(s, d):
    w = _wide(s, d)
    loci = [f"L{i}" for i in range(1, 7)]
    cells = [c for x in loci for c in (F.split(x, "/")[0].alias(x), F.split(x, "/")[1].alias(f"{x}_1"))]
    return ingest.genotypes_paired(w.select("indiv", "Population", *cells), "Population", [y for x in loci for y in (x, f"{x}_1")]).select("indiv", F.col("pop").cast("int").alias("pop"), "locus", "a1", "a2")


def packed_long_table(s, d):
    """A long table under other column names, with packed genotypes and populations in a second table."""
    from ..functions import pack_gt

    g = genotypes(s, d)
    hf = g.select(F.col("indiv").alias("individual"), F.col("locus").alias("locus_id"), pack_gt(F.col("a1"), F.col("a2")).alias("g"))
    meta = g.select(F.col("indiv").alias("individual"), F.col("pop").alias("Population")).distinct()
    return ingest.as_genotypes(hf, meta).select("indiv", "pop", "locus", "a1", "a2")


def preview_wide(s, d):
    return ingest.preview(genotypes(s, d).withColumn("locus_rank", F.substring("locus", 2, 1).cast("int")))


def params_kv(s, d):
    return params.Params().upsert(seed=7, markers=["L1", "L2"]).table(s)


def counts_updated(s, d):
    """Counts of two halves of the individuals added up."""
    g = genotypes(s, d)
    return counts.update_counts(counts.allele_counts(g.filter("indiv % 2 = 0")), counts.allele_counts(g.filter("indiv % 2 = 1")))


_QUERIES = [t_fis_by_pop, t_fis_by_locus, t_fit, t_fst, t_hs, t_fst_summary, ld_pairs_summary, ld_pairs_filtered, unpivot_string, unpivot_paired, packed_long_table, preview_wide, params_kv, counts_updated]

q = oracle.query


def _boots(sql: str) -> str:
    return sql.replace("prm AS", "prb AS")


def _assembled(rule: str = "type7", least: int = 0, p: str = "two_sided_abs", pv: str = "pt", po: str = "ot") -> tuple[str, str]:
    if rule == "type7":
        low, high = "quantile_cont(v::DOUBLE, 0.025)", "quantile_cont(v::DOUBLE, 0.975)"
    else:
        low, high = "list_sort(list(v))[floor(count(v) * 0.025)::INT + 1]", "list_sort(list(v))[least(count(v) - 1, floor(count(v) * 0.975))::INT + 1]"
    hit = "abs(x.v) >= abs(o.v) - 1e-9" if p == "two_sided_abs" else "x.v >= o.v - 1e-9"
    return (
        f"ci AS (SELECT id, avg(v) AS boot_mean, quantile_cont(v::DOUBLE, 0.5) AS boot_median, CASE WHEN count(v) >= {least} THEN {low} END AS ci_l, CASE WHEN count(v) >= {least} THEN {high} END AS ci_u FROM bt WHERE v IS NOT NULL GROUP BY id), pq AS (SELECT id, CASE WHEN count(x.v) FILTER (WHERE o.v IS NOT NULL) > 0 THEN (count(*) FILTER (WHERE {hit}) + 1) / (count(x.v) + 1) END AS p_value FROM {pv} x JOIN {po} o USING (id) GROUP BY id)",
        "SELECT id, R(ot.v) AS observed, R(boot_mean) AS boot_mean, R(boot_median) AS boot_median, R(ci_l) AS ci_l, R(ci_u) AS ci_u, R(p_value) AS p_value FROM ot LEFT JOIN ci USING (id) LEFT JOIN pq USING (id)",
    )


def _fis_pop(p: str, k: str) -> str:
    name = {"": "ot", "p_": "pt", "b_": "bt"}[p]
    own = f"SELECT {k}pop::VARCHAR AS id, CASE WHEN sum(sb + sw) > 0 THEN sum(sb) / sum(sb + sw) END AS v FROM (SELECT DISTINCT {k}pop, locus FROM {p}n) LEFT JOIN {p}ms USING ({k}pop, locus) GROUP BY {k}pop"
    return f"{name}0 AS ({own}), {name} AS (SELECT * FROM {name}0 UNION ALL SELECT {k}'Overall', avg(v) FROM {name}0 {'GROUP BY rep' if k else ''})"


def _fis_locus(p: str, k: str) -> str:
    name = {"": "ot", "p_": "pt", "b_": "bt"}[p]
    return f"{name} AS (SELECT {k}locus AS id, CASE WHEN sb + sw <> 0 THEN sb / (sb + sw) END AS v FROM {p}ms UNION ALL SELECT {k}'Overall', CASE WHEN sum(sb + sw) > 0 THEN sum(sb) / sum(sb + sw) END FROM {p}ms {'GROUP BY rep' if k else ''})"


def _reps(src: str, p: str, *extra: str) -> tuple[str, ...]:
    return (oracle.counts(src, REP, p), oracle.components(REP, p), *extra)


_PERM = _reps("prm", "p_")
_BOOT = _reps("prb", "b_")
_T_FST = (*WC, oracle.over(), oracle.g_sql(), labels_sql(), _boots(POPS_SQL), oracle.counts("prm", REP, "p_"), oracle.g_sql(REP, "p_"), *_BOOT, oracle.over(REP, "b_"),
          "ot AS (SELECT locus AS id, fst AS v FROM f UNION ALL SELECT 'Overall', fst FROM o), bt AS (SELECT rep, locus AS id, fst AS v FROM b_f UNION ALL SELECT rep, 'Overall', fst FROM b_o), og AS (SELECT locus AS id, g AS v FROM g UNION ALL SELECT 'Overall', sum(g) FROM g), pt AS (SELECT locus AS id, g AS v FROM p_g UNION ALL SELECT 'Overall', sum(g) FROM p_g GROUP BY rep)")
_ST = lambda unit, name, own, boot: f"SELECT '{unit}' AS unit, '{name}' AS statistic, id, R(o.v) AS observed, R(avg(b.v)) AS boot_mean, R(stddev_samp(b.v)) AS boot_se, R(quantile_cont(b.v::DOUBLE, 0.025)) AS ci_l, R(quantile_cont(b.v::DOUBLE, 0.975)) AS ci_u FROM {own} o JOIN {boot} b USING (id) GROUP BY id, o.v"
_LONG = lambda name, src, v, k="": f"{name} AS (SELECT {k}locus AS id, {v} AS v FROM {src} UNION ALL SELECT {k}'Overall', avg({v}) FROM {src} {'GROUP BY rep' if k else ''})"
_LDP = RESAMPLE["ld_perm"]
_LDM = f"SELECT locus1, locus2, min(p_value) AS min_p, count(*) FILTER (WHERE p_value < 0.05) AS n_significant, avg(p_value) AS mean_p FROM ({_LDP}) GROUP BY ALL"

_ORACLE = {
    "t_fis_by_pop": q(*WC, oracle.mean_squares("pop, locus"), alleles_sql(), *_PERM, oracle.mean_squares("rep, pop, locus", "p_"), _boots(PEOPLE_SQL), *_BOOT, oracle.mean_squares("rep, pop, locus", "b_"), _fis_pop("", ""), _fis_pop("p_", REP), _fis_pop("b_", REP), *_assembled()),
    "t_fis_by_locus": q(*WC, oracle.mean_squares("locus"), alleles_sql(), *_PERM, oracle.mean_squares("rep, locus", "p_"), _boots(PEOPLE_SQL), *_BOOT, oracle.mean_squares("rep, locus", "b_"), _fis_locus("", ""), _fis_locus("p_", REP), _fis_locus("b_", REP), *_assembled("floor")),
    "t_fit": q(*WC, oracle.over(), alleles_sql(False), *_PERM, oracle.over(REP, "p_"), _boots(POPS_SQL), *_BOOT, "ot AS (SELECT locus AS id, fit AS v FROM f UNION ALL SELECT 'Overall', fit FROM o), pt AS (SELECT rep, locus AS id, fit AS v FROM p_f UNION ALL SELECT rep, 'Overall', fit FROM p_o), bt AS (SELECT rep, locus AS id, fit AS v FROM b_f UNION ALL SELECT rep, 'Overall', avg(fit) FROM b_f GROUP BY rep)", *_assembled(least=10)),
    "t_fst": q(*_T_FST, *_assembled(p="greater", po="og")),
    "t_hs": q(*WC, PEOPLE_SQL, *_PERM, _boots(POPS_SQL), *_BOOT, ", ".join((_LONG("o1", "f", "hs"), _LONG("o2", "f", "ht"), _LONG("b1", "p_hs", "hs", REP), _LONG("b2", "b_f", "hs", REP), _LONG("b3", "b_f", "ht", REP))), " UNION ALL ".join((_ST("individuals", "HS", "o1", "b1"), _ST("populations", "HS", "o1", "b2"), _ST("populations", "HT", "o2", "b3")))),
    "t_fst_summary": q(*_T_FST, _assembled(p="greater", po="og")[0], "SELECT count(*) AS n_loci, R(count(ot.v) / count(*)) AS share_defined, (count(*) FILTER (WHERE p_value < 0.05))::BIGINT AS n_significant, R(avg(ci_u - ci_l)) AS mean_ci_width, R(avg(1 - p_value)) AS mean_power_proxy FROM ot LEFT JOIN ci USING (id) LEFT JOIN pq USING (id) WHERE id <> 'Overall'"),
    "ld_pairs_summary": oracle.expand(f"SELECT locus1, locus2, R(min_p) AS min_p, n_significant::INT AS n_significant, R(mean_p) AS mean_p FROM ({_LDM})"),
    "ld_pairs_filtered": oracle.expand(f"SELECT locus1, locus2, R(min_p) AS min_p FROM ({_LDM}) WHERE min_p < 0.06"),
    "unpivot_string": q("SELECT indiv, pop, locus, a1::INT AS a1, a2::INT AS a2 FROM geno"),
    "unpivot_paired": q("SELECT indiv, pop, locus, a1::INT AS a1, a2::INT AS a2 FROM geno"),
    "packed_long_table": q("SELECT indiv, pop, locus, a1::INT AS a1, a2::INT AS a2 FROM geno"),
    "preview_wide": q("SELECT indiv, pop, " + ", ".join(f"max(a1 || '/' || a2) FILTER (WHERE locus = 'L{i}') AS L{i}" for i in range(1, 7)) + " FROM geno WHERE indiv IN (SELECT DISTINCT indiv FROM geno ORDER BY indiv LIMIT 100) GROUP BY indiv, pop"),
    "params_kv": "SELECT * FROM (VALUES ('base', '1000'), ('missing', '\"0\"'), ('seed', '7'), ('conf', '0.95'), ('n_perm', '5000'), ('n_boot', '5000'), ('ploidy', '2'), ('genotype_format', '\"auto\"'), ('markers', '[\"L1\", \"L2\"]'), ('treatments', '{}')) t(key, value)",
    "counts_updated": q(oracle.counts(), "SELECT locus, pop, allele, c, h::BIGINT AS h FROM cnt"),
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def perm_kernel(s, d, n=B):
    """Permutations of all three schemes by the numpy engine, which draws as SQL does."""
    out = None
    for scheme in kernel.SCHEMES:
        x = kernel.permute(genotypes(s, d), n, SEED, scheme, "auto").withColumn("scheme", F.lit(scheme))
        out = x if out is None else out.unionByName(x)
    return rounded(out, "fst", "fit", "fis", "g")


def ld_kernel(s, d, n=B):
    """Linkage by the numpy engine, which draws as SQL does."""
    return rounded(kernel.ld_p_values(genotypes(s, d), n, SEED, ld_engine(n)), "g", "p_value")


_KERNEL = "SELECT '{}' AS scheme, rep, locus, R(fst) AS fst, R(fit) AS fit, R(fis) AS fis, R(g) AS g FROM r_f JOIN r_g USING (rep, locus)"
_MOVES = {"labels": labels_sql(), "alleles_within": alleles_sql(), "alleles_global": alleles_sql(False)}
_ORACLE["perm_kernel"] = " UNION ALL ".join(f"SELECT * FROM ({q(move, oracle.counts('prm', REP, 'r_'), oracle.components(REP, 'r_'), oracle.g_sql(REP, 'r_'), _KERNEL.format(scheme))})" for scheme, move in _MOVES.items())
_ORACLE["ld_kernel"] = _LDP


_QUERIES += [perm_kernel, ld_kernel]
