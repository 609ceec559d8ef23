"""Registered queries with the default settings' replicates: the tables, p-values and intervals that others hold against SQL with 20.  No SQL, as it would be too slow."""

from __future__ import annotations

import functools

from ..sources.params import Params
from . import null_queries, resample_queries, table_queries

REPLICATES = Params().n_perm
SUFFIX = "_full"
#: What replicates are made into; queries of the replicates themselves have no use for more.
NAMES = {
    resample_queries: ("perm_fst_p", "perm_fis_grid", "perm_fit_global", "perm_hi_hs_centered", "gtest_perm", "boot_pop_fit_ci", "boot_indiv_hs_per_pop", "boot_loci", "ci_type7", "ci_floor"),
    null_queries: ("boot_loci_ena", "boot_loci_pair", "boot_loci_dcse", "boot_loci_shared", "partial_mantel", "mantel_null_quantiles", "mantel_plus1", "mantel_plain", "mantel_cross", "mantel_slope", "mantel_spearman", "mrm", "mrm_standardized"),
    table_queries: ("t_fis_by_pop", "t_fis_by_locus", "t_fit", "t_fst", "t_hs", "t_fst_summary", "ld_pairs_summary", "ld_pairs_filtered", "ld_kernel"),
}


def queries() -> dict:
    return {name + SUFFIX: functools.partial(module.queries()[name], n=REPLICATES) for module, names in NAMES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    return {}
