"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..sources.folders import delete, shared_folder  # noqa: F401

#: A word is a maximal run outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names (a temporary one for a local master without it).  Shuffle files of the query go at once, as nothing reads them again."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # a plan keeps the setting under which it was made, and that of df itself may be older
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the column's text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def extended(schema: StructType, **added: str) -> StructType:
    """A copy of the schema with more fields (``StructType.add`` would change the DataFrame's own)."""
    return StructType([*schema.fields, *_parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in added.items())).fields])


#: Bits of the bitmap that ``likely`` broadcasts: 2 MB, whatever the size of the input.
BITMAP_BITS = 1 << 24
_ROW_BITS = 32_768  # of one row of the bitmap, as Spark's bitmap functions have them


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` (a hash) may be among those of ``wanted``: all that are, and a share of the others that grows with the keys wanted.

    A bitmap of fixed size goes to all tasks, so that an exact join has less to move.
    """
    place = lambda: F.pmod(F.col(key), F.lit(BITMAP_BITS))
    own = wanted.select(F.floor(place() / _ROW_BITS).cast("int").alias("_row"), (place() % _ROW_BITS).cast("long").alias("_bit"))
    bitmap = own.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))  # BITMAP_BITS / _ROW_BITS rows of 4 KB at most
    bit = (place() % _ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, bit % 8) == 1
    return rows.withColumn("_row", F.floor(place() / _ROW_BITS).cast("int")).join(F.broadcast(bitmap), "_row").filter(hit).select(*rows.columns)
