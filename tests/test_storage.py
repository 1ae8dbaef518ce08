"""Sketches that merge, and joins that take buckets as they are."""

from pyspark.sql import functions as F

from docquarry.operators import changes, chunks
from docquarry.sources import tables


def test_sketches_of_parts_are_those_of_the_whole(spark):
    tokens = spark.range(3000).select((F.col("id") % 3).cast("int").alias("chunk_no"), F.concat(F.lit("t"), "id").alias("token"))
    whole, rows = chunks.sketches(tokens), lambda df: sorted((r.chunk_no, bytes(r.low), bytes(r.high)) for r in df.collect())
    parts = [chunks.sketches(tokens.where(F.crc32(F.encode("token", "utf-8")) % 4 == k)) for k in range(4)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert rows(chunks.merged(both)) == rows(whole) and all(len(x) == 4096 for r in rows(whole) for x in r[1:])
    # no token is missed, few others pass
    assert all(whole.where(chunks.may_hold([f"t{i}"])).where(F.col("chunk_no") == i % 3).count() == 1 for i in (0, 1, 2, 2999))
    assert whole.where(chunks.may_hold(["absent"])).count() <= 1 and whole.where(chunks.may_hold(["t0", "t1"])).count() <= 1


def test_the_index_in_buckets_is_not_shuffled(spark, tmp_path):
    index = spark.range(500).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("2024-01-01").alias("source_lastmod"), F.col("id").cast("string").alias("article_id"))
    items = spark.range(100, 600).select(F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 5 == 0, "2024-02-02").otherwise("2024-01-01").alias("lastmod"))
    name = tables.write_buckets(index, str(tmp_path / "b"), "url", 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = changes.change_set(items, spark.table(name))
        assert sorted(map(str, found.collect())) == sorted(map(str, changes.change_set(items, index).collect()))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        executed = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    scan = next(x for x in executed.split("\n") if "FileScan parquet" in x)
    above = executed[: executed.index(scan)]
    depth = scan.index("FileScan")
    # lines above the scan with a smaller indent are what its rows go through
    for line in reversed(above.split("\n")):
        at = len(line) - len(line.lstrip(" :+-*"))
        if at < depth:
            depth = at
            assert "Exchange" not in line and "Shuffle" not in line, executed
            if "Join" in line:
                break
    assert "Bucketed: true" in scan and plan
