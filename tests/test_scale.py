"""What keeps tasks and Python small on large tables."""

import random
import unicodedata

from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.sources import tables


def test_only_texts_that_may_change_go_to_python(spark):
    rng = random.Random(5)
    letters = [chr(c) for a, b in [*text._BLOCKS, (0x20, 0x7E), (0x300, 0x36F), (0x1100, 0x11FF), (0xFF01, 0xFF5E), (0x1F600, 0x1F64F)] for c in (range(a, b + 1) if b - a < 1000 else range(a, b, 97))]
    rows = [(c,) for c in letters] + [("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))),) for _ in range(20_000)] + [("Größe ñ été “x” – 한국어 日本語 カナ Москва",)]
    seen = spark.createDataFrame(rows, "t string").select("t", F.col("t").rlike(text.CHANGED).alias("may"), text.nfkc(F.col("t")).alias("n")).collect()
    assert all(r.n == unicodedata.normalize("NFKC", r.t) for r in seen)
    assert all(r.may or unicodedata.normalize("NFKC", r.t) == r.t for r in seen)
    assert not seen[-1].may and sum(not r.may for r in seen) > 1000


def test_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert tables.read_parquet(spark, str(tmp_path), "pages", spread=True).rdd.getNumPartitions() == cores
    monkeypatch.setattr(tables, "PART_BYTES", 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # many splits of one row group
    try:
        df = tables.read_parquet(spark, str(tmp_path), "pages", spread=True)
        sizes = df.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.rdd.getNumPartitions() > 2 * cores and max(r["count"] for r in sizes) < 1000
