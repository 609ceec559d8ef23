import inspect

import pytest

from locusflow.functions import cache
from locusflow.plans import fixtures, pipelines, registry


def test_full_queries_take_the_default_replicates():
    q = registry.queries()
    full = {n: f for n, f in q.items() if n.endswith("_full")}
    assert {n.removesuffix("_full") for n in full} >= {"t_fst", "t_fit", "t_hs", "ld_pairs_summary", "perm_fst_p", "ci_type7", "mrm"}
    for name, f in full.items():
        assert f.keywords == {"n": 5000}
        assert inspect.signature(q[name.removesuffix("_full")]).parameters["n"].default == 20
    assert not full.keys() & registry.oracle_sql().keys()


def test_replicates_reach_the_result(spark):
    """Loci that repeat each other: with 20 shuffles no p is below 0.05."""
    rows = [(i, 1 + i % 2, x, 1 + i // 2 % 3, 1 + i // 2 % 3) for i in range(40) for x in ("L1", "L2")]
    g = spark.createDataFrame(rows, "indiv long, pop int, locus string, a1 int, a2 int")
    few, more = (pipelines.ld_summary(pipelines.ld_matrix(g, n, 1)).first() for n in (20, 60))
    assert few.n_significant == 0 and few.min_p == 0.05
    assert more.n_significant == 3 and more.min_p == 1 / 60


@pytest.mark.parametrize("analysis", [pipelines.fis_by_pop, pipelines.fit_analysis, pipelines.fst_analysis, pipelines.hs_tables])
def test_replicates_of_a_table_are_made_once(spark, analysis):
    """Rows by locus and Overall start from cached tables."""
    geno = fixtures.genotypes(spark, "/root/testdata/sf0.001")
    n = {k: 20 for k in ("n_perm", "n_boot") if k in inspect.signature(analysis).parameters}
    leaves = analysis(geno, **n)._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.length())} == {"InMemoryRelation"}
    cache.release()
