"""Delimited files to genotype tables.

Text stays text until the genotypes are built.  A row's place in the file is its individual id: ids come from
partition-wise row numbers and the row counts of the partitions before, without sorting or gathering rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name lists and patterns by which columns are told (fixed values).
POP_NAMES = (
    "pop", "population", "populations", "pop_id", "popid", "deme", "site", "locality", "location", "sampling_site", "samplinglocation", "group", "cluster", "subpop", "subpopulation",
    "strata", "stratum", "region", "zone", "area", "areas", "local", "localite", "localité", "provenance", "village", "pays", "collection", "origin", "origine", "habitat", "patch",
)
POP_CODE_NAMES = ("pop", "popid", "popcode", "populationid", "siteid", "localityid", "locationid")
LAT_NAMES = ("lat", "latitude", "latdd", "latitudedd", "decimallatitude", "y", "ywgs84", "coordy", "northing")
LON_NAMES = ("lon", "lng", "long", "longitude", "londd", "longitudedd", "decimallongitude", "x", "xwgs84", "coordx", "easting")
ID_NAME = re.compile(r"^id$|^ind$|^indiv|hostind|host|specimen|sample|code|barcode|tag|uid|uuid|run|rep|plate|well|popid")
NA_TEXTS = ("NA", "NaN", "N/A", "na", "nan", "n/a")
PAIR_SUFFIX = re.compile(r"(_1|\.[0-9]+)$")
GENOTYPE = re.compile(r"^[0-9]+\s*[/\-_|:]\s*[0-9]+$")
SEPARATORS = (",", ";", "\t")
PREVIEW_ROWS = 100


# -- reading ---------------------------------------------------------------------------


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _1, _2, ... in order; names that are taken are passed over."""
    taken, used, out = set(names), set(), []
    for name in names:
        new, n = name, 0
        while new in used:
            n += 1
            candidate = f"{name}_{n}"
            if candidate not in taken and candidate not in used:
                new = candidate
        used.add(new)
        out.append(new)
    return out


def guess_separator(header: str) -> str:
    """The separator that the header has most of; a comma if it has none."""
    return max(SEPARATORS, key=lambda s: (header.count(s), s == ","))


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether all lines are valid UTF-8."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count() == 0


@dataclass
class Raw:
    """A file's rows as text, with ``indiv``, and how many rows had too many or too few cells (these are left out)."""

    rows: DataFrame
    columns: list[str]
    malformed: int
    encoding: str
    sep: str


def numbered(df: DataFrame, name: str = "indiv") -> DataFrame:
    """Adds row numbers from 0 in file order."""
    whole = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    sizes = whole.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()  # a row for each partition of the file
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before[r["_part"]] = total
        total += r["_n"]
    if not before:
        return df.withColumn(name, F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame([(int(k), int(v)) for k, v in before.items()], "_part long, _before long")
    return whole.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_part", "_before")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, encoding: str | None = None) -> Raw:
    """All columns as text; encoding is probed (UTF-8, else Latin-1), the separator told from the header if not given."""
    encoding = encoding or ("UTF-8" if is_utf8(spark, path) else "ISO-8859-1")
    first = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    line = first[0][0]
    sep = sep or guess_separator(line)
    cells = [r for r in spark.read.option("sep", sep).option("encoding", encoding).csv(path).limit(1).collect()][0]
    names = unique_names([(c or f"V{i}").strip() for i, c in enumerate(cells, 1)]) if header else [f"V{i}" for i in range(1, len(cells) + 1)]
    plain = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in plain) + ", _bad string"
    # lines are numbered before they are parsed, so nothing has to be cached for the corrupt-record column
    lines = spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).option("header", header).option("enforceSchema", True).csv(path)
    parsed = numbered(lines).select("indiv", F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    malformed = parsed.filter(F.col("r._bad").isNotNull()).count()
    rows = parsed.filter(F.col("r._bad").isNull()).select("indiv", *[F.col(f"r.{p}").alias(n) for p, n in zip(plain, names, strict=True)])
    return Raw(rows, names, malformed, encoding, sep)


# -- what columns are --------------------------------------------------------------------


@dataclass
class Missing:
    genotype: str
    texts: set[str]


def missing_code(text: str | None) -> Missing:
    """``0`` means 0/0; a code with a separator is taken as it is. The set holds it with each separator, and texts like NA."""
    s = (text or "").strip() or "0"
    if re.search(r"[/_-]", s):
        parts = [p.strip() for p in re.split(r"[/_-]", s) if p.strip()]
        gt = "/".join((parts * 2)[:2]) if parts else "0/0"
    else:
        gt = f"{s}/{s}"
    return Missing(gt, {gt, gt.replace("/", "-"), gt.replace("/", "_"), s, re.sub("[-_]", "/", s), *NA_TEXTS})


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


#: Shares and limits by which contents are told (fixed values): cells that are numbers or coordinates; cells that are genotypes; integers among codes and ids; distinct codes, and distinct ids; and the largest code.
NUMERIC_SHARE, GENOTYPE_SHARE, INTEGER_SHARE, CODE_VARIETY, ID_VARIETY, TOP_CODE = 0.8, 0.5, 0.9, 0.8, 0.8, 5000


def profile(rows: DataFrame, names: list[str], missing: Missing) -> dict[str, dict]:
    """What each column's cells look like, in one aggregate over a row for each cell.

    ``numeric``: share of all cells that are numbers.  ``dotted``, ``lat``, ``lon``: shares of the numbers that are written with a point, or
    lie within 90 or 180.  ``paired``: share of the known cells (neither blank nor missing) that are two numbers with a separator.
    ``codes``, ``code_variety``, ``code_top``: share of the known cells that are integers, the distinct ones of these, and the largest.  ``ids``, ``id_variety``: the
    same shares of all cells that aren't blank.  Shares of nothing are 0.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.trim(F.col(f"`{n}`").cast("string")).alias("t")) for i, n in enumerate(names)])
    t = F.col("t")
    cell = rows.select(F.explode(cells).alias("c")).select("c.*").withColumn("x", t.try_cast("double")).withColumn("whole", F.when(t.rlike("^[0-9]+$"), t.try_cast("decimal(38,0)")))
    known = (t != "") & ~F.lower(t).isin([m.lower() for m in missing.texts])
    number, whole, code = F.col("x").isNotNull(), F.col("whole").isNotNull(), F.when(known, F.col("whole"))
    share = lambda part, of: F.coalesce(F.count_if(part) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    # the preview bounds the sets
    variety = lambda x: F.coalesce(F.size(F.collect_set(x)) / F.nullif(F.count(x), F.lit(0)), F.lit(0.0))
    out = cell.groupBy("i").agg(
        share(number, F.lit(True)).alias("numeric"),
        share(number & t.contains("."), number).alias("dotted"),
        share(F.abs("x") <= 90, number).alias("lat"),
        share(F.abs("x") <= 180, number).alias("lon"),
        share(known & t.rlike(GENOTYPE.pattern), known).alias("paired"),
        share(known & whole, known).alias("codes"),
        variety(code).alias("code_variety"),
        F.coalesce(F.max(code), F.lit(0)).cast("double").alias("code_top"),
        share(whole, t != "").alias("ids"),
        variety(F.col("whole")).alias("id_variety"),
    )
    found = {names[r["i"]]: r.asDict() for r in out.collect()}  # a row for each column
    blank = dict.fromkeys(("numeric", "dotted", "lat", "lon", "paired", "codes", "code_variety", "code_top", "ids", "id_variety"), 0.0)
    return {n: found.get(n, blank) for n in names}


@dataclass
class Columns:
    population: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    markers: list[str] = field(default_factory=list)
    marker_range: str | None = None
    metadata: list[str] = field(default_factory=list)


def longest_run(numbers: list[int]) -> list[int]:
    """The longest run of consecutive numbers; the first of equals."""
    best: list[int] = []
    run: list[int] = []
    for n in sorted(set(numbers)):
        run = [*run, n] if run and n == run[-1] + 1 else [n]
        if len(run) > len(best):
            best = run
    return best


def parse_ranges(text: str | None, n_max: int) -> list[int]:
    """``"3:14"`` or ``"1,2,5-7"`` as sorted numbers from 1 to n_max; anything else is passed over."""
    out = set()
    for part in re.sub(r"\s+", "", text or "").split(","):
        if m := re.fullmatch(r"([0-9]+)(?:[:-]([0-9]+))?", part):
            a, b = int(m[1]), int(m[2] or m[1])
            out |= set(range(min(a, b), min(max(a, b), n_max) + 1))
    return sorted(x for x in out if 1 <= x <= n_max)


def compress_ranges(numbers: list[int]) -> str:
    out: list[list[int]] = []
    for n in sorted(set(numbers)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def detect_columns(rows: DataFrame, names: list[str], missing: Missing) -> Columns:
    """What the columns are, from their names and the first hundred rows."""
    of = profile(rows.select(*[f"`{n}`" for n in names]).limit(PREVIEW_ROWS), names, missing)
    out = Columns()
    pops = [n for n in names if n.strip().lower() in POP_NAMES]
    out.population = next((n for n in pops if of[n]["numeric"] < NUMERIC_SHARE), pops[0] if pops else None)

    def coordinate(known: tuple[str, ...], within: str) -> str | None:
        fit = [n for n in names if of[n]["numeric"] >= NUMERIC_SHARE and of[n][within] >= NUMERIC_SHARE]
        named = [n for n in fit if _plain(n) in known]
        return next(iter(named or [n for n in fit if of[n]["dotted"] >= NUMERIC_SHARE]), None)

    out.latitude, out.longitude = coordinate(LAT_NAMES, "lat"), coordinate(LON_NAMES, "lon")
    others = {out.population, out.latitude, out.longitude}
    for n, x in of.items():
        ids = x["ids"] >= INTEGER_SHARE and x["id_variety"] >= ID_VARIETY
        if ids or ID_NAME.search(_plain(n)) or _plain(n) in POP_CODE_NAMES and x["numeric"] >= NUMERIC_SHARE:
            others.add(n)
        coded = x["codes"] >= INTEGER_SHARE and x["code_variety"] <= CODE_VARIETY and x["code_top"] <= TOP_CODE
        if n not in others and (x["paired"] >= GENOTYPE_SHARE or coded):
            out.markers.append(n)
    run = longest_run([names.index(n) + 1 for n in out.markers])
    out.marker_range = f"{run[0]}:{run[-1]}" if run else None
    out.metadata = [n for n in names if n != out.population and n not in out.markers]
    return out


def resolve(df: DataFrame, *aliases: str) -> str:
    """The first of the aliases that is a column."""
    for a in aliases:
        if a in df.columns:
            return a
    raise ValueError(f"none of {aliases} is a column")


def as_genotypes(hf: DataFrame, meta: DataFrame | None = None, base: int = 1000) -> DataFrame:
    """``indiv, pop, locus, a1, a2`` from a long table with packed genotypes, under any of the usual column names.

    The population comes from the table itself, or from ``meta`` (kept only for individuals that it has).
    """
    from ..functions import unpack_gt

    ind, loc, gt = resolve(hf, "indiv_id", "individual", "indiv"), resolve(hf, "locus_id", "locus", "Marker"), resolve(hf, "gt", "g")
    a1, a2 = unpack_gt(F.col(gt), base)
    x = hf
    if meta is not None:
        mi = resolve(meta, "individual", "indiv_id", "indiv")
        x = hf.join(meta.select(F.col(mi).alias("_mi"), F.col(resolve(meta, "Population", "population", "pop", "pop_code")).alias("_pop")), F.col(ind).cast("string") == F.col("_mi").cast("string"))
        pop = F.col("_pop")
    else:
        pop = F.col(resolve(hf, "Population", "population", "pop", "pop_code"))
    return x.select(F.col(ind).alias("indiv"), pop.alias("pop"), F.col(loc).alias("locus"), a1.alias("a1"), a2.alias("a2"))


# -- genotypes -----------------------------------------------------------------------------


def _allele(x: Column) -> Column:
    """A rounded number, 0 where the text is none or isn't positive; so 195.0 is 195."""
    v = F.expr("try_cast(NULL AS DOUBLE)") if x is None else x.try_cast("double")
    return F.coalesce(F.when(v > 0, F.round(v)), F.lit(0.0)).cast("int")


def is_paired(markers: list[str]) -> bool:
    return any(PAIR_SUFFIX.search(m) for m in markers)


def paired_loci(markers: list[str]) -> dict[str, tuple[str, str]]:
    """Loci with both columns: ``B12`` and ``B12_1`` (or ``B12.1`` to ``B12.9``)."""
    out = {}
    for m in markers:
        base = PAIR_SUFFIX.sub("", m)
        if base in markers and base not in out:
            second = next((c for c in [f"{base}_1", *(f"{base}.{i}" for i in range(1, 10))] if c in markers), None)
            if second:
                out[base] = (base, second)
    return out


def genotypes_paired(rows: DataFrame, population: str, markers: list[str]) -> DataFrame:
    """Two columns a locus; a marker without its second column raises."""
    loci = paired_loci(markers)
    lost = sorted({PAIR_SUFFIX.sub("", m) for m in markers} - set(loci))
    if lost:
        raise ValueError(f"second allele column not found: {', '.join(lost)}")
    cells = F.array(*[F.struct(F.lit(n).alias("locus"), F.lit(i).alias("locus_rank"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for i, (n, (a, b)) in enumerate(loci.items())])
    return rows.select("indiv", F.col(f"`{population}`").alias("pop"), F.explode(cells).alias("s")).select("indiv", "pop", "s.locus", "s.locus_rank", _allele(F.col("s.x")).alias("a1"), _allele(F.col("s.y")).alias("a2"))


def genotypes_string(rows: DataFrame, population: str, markers: list[str], missing: Missing | None = None, drop_null: bool = False) -> DataFrame:
    """One column a locus, with any of ``/ - _ | :`` between the alleles; codes of the missing set are missing.

    Null cells are missing genotypes; ``drop_null`` leaves them out, as an UNPIVOT does.
    """
    missing = missing or missing_code(None)
    cells = F.array(*[F.struct(F.lit(n).alias("locus"), F.lit(i).alias("locus_rank"), F.trim(F.col(f"`{n}`")).alias("x")) for i, n in enumerate(markers)])
    x = rows.select("indiv", F.col(f"`{population}`").alias("pop"), F.explode(cells).alias("s")).select("indiv", "pop", "s.*")
    if drop_null:
        x = x.filter(F.col("x").isNotNull())
    parts = F.split("x", r"\s*[/\-_|:]\s*")
    ok = F.col("x").isNotNull() & ~F.lower("x").isin([t.lower() for t in missing.texts]) & (F.size(parts) == 2)
    a, b = _allele(F.when(ok, F.get(parts, F.lit(0)))), _allele(F.when(ok, F.get(parts, F.lit(1))))
    return x.select("indiv", "pop", "locus", "locus_rank", F.when((a > 0) & (b > 0), a).otherwise(0).alias("a1"), F.when((a > 0) & (b > 0), b).otherwise(0).alias("a2"))


def build_genotypes(raw: Raw, columns: Columns, missing: Missing | None = None) -> DataFrame:
    if columns.population is None or not columns.markers:
        raise ValueError("a population column and markers are needed")
    if is_paired(columns.markers):
        return genotypes_paired(raw.rows, columns.population, columns.markers)
    return genotypes_string(raw.rows, columns.population, columns.markers, missing)


def build_meta(raw: Raw, columns: Columns) -> DataFrame:
    """``individual, Population, Latitude, Longitude`` and the other metadata as text."""
    number = lambda c: F.col(f"`{c}`").try_cast("double") if c else F.lit(None).cast("double")
    rest = [c for c in columns.metadata if c not in (columns.latitude, columns.longitude, columns.population)]
    return raw.rows.select(F.col("indiv").alias("individual"), F.col(f"`{columns.population}`").alias("Population"), number(columns.latitude).alias("Latitude"), number(columns.longitude).alias("Longitude"), *[F.col(f"`{c}`") for c in rest])


def infer_base(geno: DataFrame) -> int:
    """10 to the power of the digits of the largest allele, 1000 without any."""
    top = geno.agg(F.max(F.greatest("a1", "a2"))).first()[0]
    return 10 ** len(str(top)) if top else 1000


def preview(geno: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """A row an individual and a column a locus, as ``a1/a2``, of the first individuals."""
    first = geno.select("indiv", "pop").distinct().orderBy("indiv").limit(limit)
    loci = [r["locus"] for r in geno.select("locus", "locus_rank").distinct().orderBy("locus_rank").collect()] if "locus_rank" in geno.columns else None
    x = geno.join(F.broadcast(first.select("indiv")), "indiv").withColumn("g", F.concat_ws("/", "a1", "a2")).groupBy("indiv", "pop")
    return (x.pivot("locus", loci) if loci else x.pivot("locus")).agg(F.first("g"))
