import time

from pyspark.sql import functions as F

from locusflow.llm import common


def test_likely_rows_hold_all_that_are_wanted(spark, monkeypatch):
    rows = spark.range(3000).select(F.xxhash64("id").alias("key"), "id")
    wanted = rows.filter("id % 10 = 0").select("key")
    got = {r.id for r in common.likely(rows, "key", wanted).collect()}
    assert got >= set(range(0, 3000, 10)) and len(got) < 320
    assert common.likely(rows, "key", wanted).columns == rows.columns
    assert common.likely(rows, "key", wanted.limit(0)).count() == 0
    monkeypatch.setattr(common, "BITMAP_BITS", common._ROW_BITS)  # one row: more chance hits, still all that are wanted
    few = {r.id for r in common.likely(rows, "key", wanted).collect()}
    assert few >= set(range(0, 3000, 10)) and len(few) < 600


def test_spare_names():
    class Frame:
        columns = ["A", "_a", "b"]

    assert common.spare(Frame, "a", "c", "C") == ["__a", "c", "_C"]


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(common.CLEANUP, None)
    rows = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").repartition(3, "k"), "k")
    got = common.checkpointed(rows)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert sorted(r["count"] for r in got.collect()) == [14] * 5 + [15] * 2 == sorted(r["count"] for r in rows.collect())
    assert spark.conf.get(common.CLEANUP, None) == setting
