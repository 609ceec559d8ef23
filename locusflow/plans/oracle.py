"""SQL for an independent engine, from the definitions (populations x alleles grids, squared deviations), not from the sums that the operators use."""

from __future__ import annotations

import re

from .fixtures import SQL as GENO


def expand(sql: str) -> str:
    """U(a, b, ...) is the first 32 bits of the md5 of the joined parts, R(x) rounds to 8 digits without negative zero."""
    sql = re.sub(r"\bU\(([^()]*)\)", r"(('0x' || substr(md5(concat_ws('|', \1)), 1, 8))::BIGINT)", sql)
    while m := re.search(r"\bR\(", sql):
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        inner = sql[m.end() : at - 1]
        sql = f"{sql[: m.start()]}(round(({inner})::DOUBLE, 8) + 0.0){sql[at:]}"
    return sql


def counts(src: str = "valid", k: str = "", p: str = "") -> str:
    """CTEs cnt, n and grid; ``k`` is like ``"rep, "``, ``p`` goes before the names."""
    return f"""
{p}cnt AS (SELECT {k}locus, pop, allele, count(*) AS c, sum(h) AS h FROM (SELECT {k}locus, pop, unnest([a1, a2]) AS allele, (a1 <> a2)::INT AS h FROM {src}) GROUP BY ALL),
{p}n AS (SELECT {k}locus, pop, count(*)::DOUBLE AS n, sum((a1 <> a2)::INT)::DOUBLE AS n_het FROM {src} GROUP BY ALL)"""


def components(k: str = "", p: str = "") -> str:
    """CTEs grid, sz, pa, comp (by allele) and loc (by locus) over cnt and n."""
    return f"""
{p}grid AS (SELECT n.*, al.allele, coalesce(c, 0)::DOUBLE AS c, coalesce(h, 0)::DOUBLE AS h FROM {p}n n JOIN (SELECT DISTINCT {k}locus, allele FROM {p}cnt) al USING ({k}locus) LEFT JOIN {p}cnt USING ({k}locus, pop, allele)),
{p}sz AS (SELECT {k}locus, count(*) AS r, sum(n) AS nt, sum(n) / count(*) AS nbar, CASE WHEN count(*) > 1 THEN (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) END AS nc, sum(n_het) AS het FROM {p}n GROUP BY ALL),
{p}pa AS (SELECT {k}locus, allele, sum(c) / (2 * sum(n)) AS p, sum(h) / sum(n) AS hbar, avg(c / (2 * n)) AS mp FROM {p}grid GROUP BY ALL),
{p}dv AS (SELECT {k}locus, allele, sum(n * (c / (2 * n) - p) ** 2) AS ss FROM {p}grid JOIN {p}pa USING ({k}locus, allele) GROUP BY ALL),
{p}s2 AS (SELECT *, CASE WHEN r >= 2 AND nt > 1 AND nc > 0 AND nbar > 1 THEN ss / ((r - 1) * nbar) END AS s2 FROM {p}pa JOIN {p}dv USING ({k}locus, allele) JOIN {p}sz USING ({k}locus)),
{p}comp AS (SELECT *, nbar / nc * (s2 - 1 / (nbar - 1) * (p * (1 - p) - (r - 1) / r * s2 - hbar / 4)) AS a,
  nbar / (nbar - 1) * (p * (1 - p) - (r - 1) / r * s2 - (2 * nbar - 1) / (4 * nbar) * hbar) AS b, CASE WHEN s2 IS NOT NULL THEN hbar / 2 END AS c FROM {p}s2),
{p}div AS (SELECT {k}locus, pop, n, n_het, 1 - sum((c / (2 * n)) ** 2) AS he FROM {p}grid GROUP BY ALL),
{p}hs AS (SELECT {k}locus, avg(he * 2 * n / (2 * n - 1)) FILTER (WHERE n > 1) AS hs, sum(he * 2 * n / (2 * n - 1)) FILTER (WHERE n > 1) / count(*) AS hs_f, sum(n * he) / sum(n) AS hs_b, avg(n_het / n) AS ho FROM {p}div GROUP BY ALL),
{p}raw AS (SELECT {k}locus, r, nt, het, nbar, nc, sum(a) AS a, sum(b) AS b, sum(c) AS c, (1 - sum(mp * mp)) * 2 * any_value(nt) / (2 * any_value(nt) - 1) AS ht FROM {p}comp GROUP BY ALL),
{p}loc AS (SELECT {k}locus, r, nt, CASE WHEN a + b + c > 0 THEN a END AS a, CASE WHEN a + b + c > 0 THEN b END AS b, CASE WHEN a + b + c > 0 THEN c END AS c,
  CASE WHEN a + b + c > 0 THEN het / nt END AS hi, CASE WHEN a + b + c > 0 THEN hs END AS hs, CASE WHEN a + b + c > 0 THEN ht END AS ht FROM {p}raw JOIN {p}hs USING ({k}locus)),
{p}f AS (SELECT *, a / (a + b + c) AS fst, (a + b) / (a + b + c) AS fit, CASE WHEN b + c > 0 THEN b / (b + c) END AS fis FROM {p}loc)"""


def over(k: str = "", p: str = "") -> str:
    """CTE o: ratios of sums over loci, and means."""
    group = f"GROUP BY {k.rstrip(', ')}" if k else ""
    return f"""
{p}o AS (SELECT {k}CASE WHEN sum(a + b + c) > 0 THEN sum(a) / sum(a + b + c) END AS fst, CASE WHEN sum(a + b + c) > 0 THEN sum(a + b) / sum(a + b + c) END AS fit, CASE WHEN sum(b + c) > 0 THEN sum(b) / sum(b + c) END AS fis,
  avg(hi) AS hi, avg(hs) AS hs, avg(ht) AS ht FROM {p}loc {group})"""


def mean_squares(by: str, p: str = "") -> str:
    """CTE ms: FIS components by mean squares within and among individuals, from the definition; ``by`` is like ``"rep, locus"``."""
    return f"""
{p}per AS (SELECT {by}, sum(n) AS nt, count(*) AS k FROM {p}n GROUP BY ALL),
{p}sq AS (SELECT {by}, allele, sum(n * c / (2 * n) - (c - h) / 2) AS ssg, sum(n * (c / (2 * n) - 2 * (c / (2 * n)) ** 2) + (c - h) / 2) AS ssi FROM {p}grid GROUP BY ALL),
{p}ms AS (SELECT {by}, sum(ssg / nt) AS sw, sum(0.5 * (ssi / (nt - k) - ssg / nt)) AS sb FROM {p}sq JOIN {p}per USING ({by}) WHERE nt >= 2 AND nt > k GROUP BY ALL)"""


def query(*parts: str, geno: bool = True) -> str:
    """WITH all parts but the last, which is the SELECT."""
    ctes = [GENO.strip()] * geno + [p.strip() for p in parts[:-1]]
    return expand("WITH " + ",\n".join(ctes) + "\n" + parts[-1])


def g_sql(k: str = "", p: str = "") -> str:
    """CTE g: 2 sum O ln(O / E) by locus."""
    return f"""
{p}gt AS (SELECT {k}locus, sum(c) AS t, count(DISTINCT pop) AS r, count(DISTINCT allele) AS ka FROM {p}cnt GROUP BY ALL),
{p}gr AS (SELECT {k}locus, pop, sum(c) AS rw FROM {p}cnt GROUP BY ALL),
{p}gc AS (SELECT {k}locus, allele, sum(c) AS cl FROM {p}cnt GROUP BY ALL),
{p}g AS (SELECT {k}locus, CASE WHEN any_value(r) >= 2 AND any_value(t) >= 4 THEN 2 * sum(c * ln(c * t / (rw * cl)::DOUBLE)) END AS g, any_value(t) // 2 AS n_geno, any_value(ka) AS ka FROM {p}cnt JOIN {p}gt USING ({k}locus) JOIN {p}gr USING ({k}locus, pop) JOIN {p}gc USING ({k}locus, allele) GROUP BY {k}locus)"""
