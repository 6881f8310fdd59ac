"""The store in buckets: what a batch rewrites and what a lookup opens."""

from pyspark.sql import functions as F

from ledgerlake.sources import buckets


def files(df):
    return set(df.inputFiles())


def test_buckets(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("a").alias("v"), F.lit(0).alias("o"))
    assert buckets.read(spark, folder) is None
    assert buckets.upsert(rows, folder, "k", "o", "1", 16) == list(range(16))
    before = buckets.read(spark, folder)
    old = files(before)
    batch = spark.createDataFrame([("k5", "b", 1), ("k5", "c", 2), ("new", "d", 1), (None, "e", 1)], "k string, v string, o int")
    touched = buckets.upsert(batch, folder, "k", "o", "2")
    now = buckets.read(spark, folder)
    assert len(touched) <= 2 and now.count() == 2001 and {(r["k"], r["v"]) for r in now.where("v <> 'a'").collect()} == {("k5", "c"), ("new", "d")}
    assert len(old - files(now)) == len(touched) and len(old & files(now)) == 16 - len(touched)
    assert before.count() == 2000 and before.where("v <> 'a'").count() == 0  # an older version's readers keep it
    assert buckets.upsert(batch, folder, "k", "o", "2") == []
    found = buckets.by_key(spark, folder, "k5")
    assert len(files(found)) == 1 and [tuple(r) for r in found.collect()] == [("k5", "c")] and "PushedFilters: [IsNotNull(k), EqualTo(k,k5)]" in found._jdf.queryExecution().toString()
    assert buckets.by_key(spark, folder, "nowhere").count() == 0


def test_bucket_without_rows(spark, tmp_path):
    one = spark.createDataFrame([(7, "x", 0)], "k long, v string, o int")
    assert buckets.upsert(one.limit(0), str(tmp_path), "k", "o", "0") == []
    assert buckets.read(spark, str(tmp_path)).count() == 0
    assert len(buckets.upsert(one, str(tmp_path), "k", "o", "1")) == 1
    assert sum(buckets.by_key(spark, str(tmp_path), k).count() for k in range(12)) == 1
