"""Files in and out, settings, streams, and the driver's entry."""

import importlib
import sys

import pytest
from locusflow.operators import counts, wc84
from locusflow.functions import cache
from locusflow.sources import export, folders, ingest, pairs
from locusflow.sources.params import Params, Store
from pyspark.sql import functions as F


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_string_format(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Population,Lat,Lon,HostInd,B12,C07\nÎle,45.1,5.2,1,192/194,100/100\nÎle,45.1,5.2,2,192-192,0\nVal,46.1,5.9,3,195.0/194,NA\nVal,46.1,5.9,4,,102:104\n")
    raw = ingest.read_delimited(spark, path)
    missing = ingest.missing_code("0")
    found = ingest.detect_columns(raw.rows, raw.columns, missing)
    assert (found.population, found.latitude, found.longitude) == ("Population", "Lat", "Lon")
    assert found.markers == ["B12", "C07"] and found.marker_range == "5:6" and "HostInd" in found.metadata
    got = {(r.indiv, r.locus): (r.a1, r.a2) for r in ingest.build_genotypes(raw, found, missing).collect()}
    assert got == {(0, "B12"): (192, 194), (0, "C07"): (100, 100), (1, "B12"): (192, 192), (1, "C07"): (0, 0), (2, "B12"): (195, 194), (2, "C07"): (0, 0), (3, "B12"): (0, 0), (3, "C07"): (102, 104)}
    meta = ingest.build_meta(raw, found).orderBy("individual").collect()
    assert meta[0].Population == "Île" and meta[2].Latitude == 46.1
    assert ingest.genotypes_string(raw.rows, "Population", ["B12"], drop_null=True).count() == 3
    assert ingest.infer_base(ingest.build_genotypes(raw, found)) == 1000


def test_paired_format_latin1_and_duplicate_headers(spark, tmp_path):
    path = write(tmp_path / "b.csv", "Pop;B12;B12;C07;C07\nGenève;10;12;5;5\nGenève;0;12;7;8\nX;10;10;5\nY;11;11;6;6;9\n", "latin-1")
    raw = ingest.read_delimited(spark, path)
    assert (raw.encoding, raw.sep, raw.malformed) == ("ISO-8859-1", ";", 2)
    assert raw.columns == ["Pop", "B12", "B12_1", "C07", "C07_1"]
    got = {(r.indiv, r.locus): (r["pop"], r.a1, r.a2) for r in ingest.genotypes_paired(raw.rows, "Pop", raw.columns[1:]).collect()}
    assert got[0, "B12"] == ("Genève", 10, 12) and got[1, "B12"] == ("Genève", 0, 12) and got[1, "C07"] == ("Genève", 7, 8)
    with pytest.raises(ValueError, match="D1"):
        ingest.genotypes_paired(raw.rows, "Pop", ["B12", "B12_1", "D1"])


def test_row_numbers_follow_the_file(spark, tmp_path):
    path = write(tmp_path / "c.txt", "Pop\tA\n" + "".join(f"p{i}\t{i}/{i}\n" for i in range(1, 3000)))
    raw = ingest.read_delimited(spark, path, sep="\t")
    assert all(r.Pop == f"p{r.indiv + 1}" for r in raw.rows.collect()) and raw.rows.count() == 2999


def test_helpers():
    assert ingest.parse_ranges("3:5, 1,9-8,x,99", 10) == [1, 3, 4, 5, 8, 9]
    assert ingest.compress_ranges([5, 1, 2, 3, 9]) == "1-3,5,9"
    assert ingest.longest_run([1, 2, 4, 5, 6, 9, 10, 11]) == [4, 5, 6]
    assert ingest.unique_names(["B", "B", "B_1", "B"]) == ["B", "B_2", "B_1", "B_3"]
    assert ingest.missing_code("-9").texts >= {"9/9"} and ingest.missing_code(" 0-0 ").genotype == "0/0" and ingest.missing_code(None).genotype == "0/0"
    assert ingest.paired_loci(["A", "A_1", "B", "B.2", "C"]) == {"A": ("A", "A_1"), "B": ("B", "B.2")}
    assert [ingest.guess_separator(h) for h in ("a;b;c", "a\tb", "a,b;c,d", "a")] == [";", "\t", ",", ","]


def test_params(spark):
    p = Params(markers=["A"], treatments={"A": "null_homo"}).upsert(seed=9)
    assert Params.of(p.table(spark)) == p


def test_stored_settings(spark, tmp_path):
    store = Store(spark, "own_params", str(tmp_path / "params"))
    store.clear()
    assert store.all() == {} and store.get("seed", 3) == 3 and store.upsert() == {}
    store.upsert(seed=1, markers=["A", "B"], note=None)
    assert store.upsert(seed=2, empty="") == {"seed": 2, "markers": ["A", "B"], "note": None, "empty": ""} == Store(spark, "own_params").all()
    assert store.get("markers") == ["A", "B"] and store.get("empty", "x") == "x" and store.get("note", "y") == "y"
    store.clear()
    assert store.all() == {} and spark.catalog.tableExists("own_params")
    spark.sql("DROP TABLE own_params")


def test_files_of_pairs(spark, tmp_path):
    path = write(tmp_path / "p.csv", "x,ID1,ID2,FST_ENA,fr_raw,FST_raw,Dgeo_m,lnDgeo\n1,B,A,0.5,7,0.2,10,NA\n2, C,A,-0.1,,NA,0,\n3,B,C,2,1,0.1,,3\n")
    raw = pairs.read_pairs(spark, path)
    got = {(r.pop1, r.pop2): r for r in pairs.genetic_table(raw).collect()}
    assert set(got) == {("B", "A"), ("C", "A"), ("B", "C")}
    a, c, b = got["B", "A"], got["C", "A"], got["B", "C"]
    assert (a.fr_ena, a.fr_raw, a.d) == (1.0, 7.0, 10.0) and a.ln_d == pytest.approx(2.302585) and a.dcse_raw is None
    assert c.fr_ena == 0 and c.fr_raw is None and c.ln_d is None and b.fr_ena == pytest.approx(9999) and b.ln_d == 3
    distances = pairs.distance_table(raw)
    assert [r.Distance for r in distances.orderBy("row").collect()] == ["10", "0", None]
    t = spark.createDataFrame([("A", "B", 0.1), ("A", "Z", 0.2)], "pop1 string, pop2 string, v double")
    extra = pairs.read_pairs(spark, write(tmp_path / "e.csv", "p;q;alt;wet\nB;A;5;1\nA;B;6;2\nA;C;7;x\n"))
    assert sorted((r.pop2, r.alt, r.wet) for r in pairs.merge_extra(t, extra).collect()) == [("B", 5.0, 1.0), ("Z", None, None)]
    with pytest.raises(ValueError, match="fewer than 3"):
        pairs.read_pairs(spark, write(tmp_path / "s.csv", "a,b,c\n1,2,3\n4,5,6\n"))
    with pytest.raises(ValueError, match="different"):
        pairs.populations(["x", "Pop1"])
    with pytest.raises(ValueError, match="three columns"):
        pairs.distance_table(ingest.Raw(t, ["pop1", "pop2"], 0, "UTF-8", ","))


def test_guessed_columns_and_warnings():
    assert pairs.guess_columns(["a", "b", "Dist_km", "FST_raw"], ["Dist_km", "FST_raw"]) == {"pop1": "a", "pop2": "b", "x": "Dist_km", "y": "FST_raw"}
    assert pairs.guess_columns(["Pop2", "Pop1"], []) == {"pop1": "Pop1", "pop2": "Pop2", "x": None, "y": None}
    assert pairs.raw_distance_warning("Dgeo_m") and pairs.raw_distance_warning("DISTANCE")
    assert not any(map(pairs.raw_distance_warning, ("lnDgeo", "log_dist", "altitude", "", None)))


def test_shared_folders(spark, tmp_path):
    assert folders.shared_folder(spark)

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        folders.shared_folder(Cluster())
    spark.range(3).write.parquet(f"{tmp_path}/gone")
    folders.delete(spark, f"{tmp_path}/gone")
    assert not (tmp_path / "gone").exists()


def test_cached_tables_are_freed(spark):
    cache.release()
    df = cache.keep(spark.range(5))
    assert df.is_cached and cache.release() == 1 and not df.is_cached and cache.release() == 0


def test_profiles(spark):
    rows = [(f"p{i % 3}", f"{i}.5", str(i), "101/102" if i else "0", "7") for i in range(20)]
    names = ["a", "b", "c", "d", "e"]
    got = ingest.profile(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), names, ingest.missing_code("0"))
    assert [got[n]["numeric"] for n in names] == [0, 1, 1, 0.05, 1]
    assert got["b"]["dotted"] == 1 and got["c"]["ids"] == 1 and got["c"]["id_variety"] == 1 and got["d"]["paired"] == 1
    assert (got["e"]["codes"], got["e"]["code_variety"], got["e"]["code_top"]) == (1, 0.05, 7)
    assert ingest.profile(spark.createDataFrame([], "a string"), ["a"], ingest.missing_code("0"))["a"]["numeric"] == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5), ("B", None)], "id string, v double")
    path = str(tmp_path / "r.csv")
    export.write_report(df, path, export.header("Title", subsamples=[1, 2], n_perm=5000, extra={"k": "v"}))
    lines = open(path, encoding="utf-8").read().splitlines()
    assert lines[0] == "# table = Title" and "# permutations = 5000" in lines and "# populations = 2 [1; 2]" in lines and "# k = v" in lines and lines[-3:] == ['"id","v"', '"A",1.5', '"B",NA']
    export.write_report(df.limit(0), path, [])  # over the former file
    assert open(path, encoding="utf-8").read() == '"id","v"\n' and {p.name for p in tmp_path.iterdir() if p.name.startswith("r.csv")} == {"r.csv"}
    many = spark.range(0, 5000, 1, 7).selectExpr("id", "cast(NULL AS string) AS x")
    export.write_report(many, f"file://{tmp_path}/new/many.txt", ["# é"], "\t")
    assert (tmp_path / "new" / "many.txt").read_text(encoding="utf-8") == "# é\nid\tx\n" + "".join(f"{i}\tNA\n" for i in range(5000))
    m = spark.createDataFrame([("L", "a", "b", 0.1, 1.0), ("L", "a", "c", None, 2.0), ("L", "b", "c", 0.3, 3.0), ("K", "a", "b", 5.0, None)], "locus string, pop1 string, pop2 string, v double, w double")
    text = "\n".join(r["value"] for r in export.half_matrices(m, ["v", "w"], ["a", "b", "c"], ["L", "K"]).collect())
    assert text.split("\n\n")[0].split("\n") == ["L: v", "\ta\tb", "b\t0.1\t", "c\tNA\t0.3"] and [b.split("\n")[0] for b in text.split("\n\n")] == ["L: v", "L: w", "K: v", "K: w"]
    assert text.split("\n\n")[2].split("\n")[2:] == ["b\t5.0\t", "c\tNA\tNA"]
    assert [r["value"] for r in export.half_matrices(m, ["v"], ["a"], ["L"]).collect()] == ["L: v\n\n"]
    export.write_table(df, str(tmp_path / "t"), "\t", single=True)
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    schema = "indiv long, pop int, locus string, a1 int, a2 int"
    rows = [(i, i % 3, "A", 1 + i % 2, 1 + i % 3) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).write.parquet(f"{tmp_path}/in/{k}")
    from locusflow import streaming

    q = streaming.start_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "live_counts", f"{tmp_path}/cp")
    try:
        q.processAllAvailable()
        live = sorted(map(tuple, spark.table("live_counts").select("locus", "pop", "allele", "c", "h").collect()))
    finally:
        q.stop()
    want = counts.allele_counts(spark.createDataFrame(rows, schema))
    assert live == sorted(map(tuple, want.select("locus", "pop", "allele", "c", "h").collect()))
    step = streaming.merge_batch(f"{tmp_path}/stored")
    for k in range(3):
        step(spark.read.parquet(f"{tmp_path}/in/{k}"), k)
    stored = spark.read.parquet(f"{tmp_path}/stored/batch=2")
    assert wc84.observed(stored).collect() == wc84.observed(want).collect()


def test_entry_registers_queries_with_sql():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert len([n for n in q if not n.startswith("op") and n in sql]) > 90


def test_entry_works_without_the_other_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("locusflow.llm", "__spark_entry__", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "locusflow.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "wc84_observed" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


SAMPLE = ["geno_decode", "wc84_observed", "basic_stats", "allele_freq_long", "ld_g", "perm_fst_p", "boot_pop_fst", "null_t2", "fst_pair", "dcse_pair", "mrm", "t_fst", "unpivot_string"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, name):
    """The driver compares all of them; here one of each kind, at the smallest scale."""
    import os

    import duckdb
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    clean = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    key = lambda row: tuple(str(v) for v in row)
    want = sorted((tuple(clean(v) for v in row) for row in res.fetchall()), key=key)
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    have = sorted((tuple(clean(r[c]) for c in names) for r in got.collect()), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, float) for v in a) else key(a) == key(b)
