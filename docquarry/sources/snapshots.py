"""Versions of an index in chunks, copy on write.

data/version=V/chunk_no=N holds the rows of chunk N as version V wrote them. manifests/version=V tells for each chunk of version V which version has its
rows, and how many there are. A merge reads and writes only the chunks that it touches; all others are taken over by name. The manifest is written last, as one file,
so a reader, who takes one manifest and what it names, sees a version whole whatever is being written. A version that was begun and not finished is written anew.
The driver sees one row for each chunk, of which there is a stated number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import changes, chunks

from .tables import written

MANIFEST = "chunk_no int, at int, n long"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _number(name: str) -> int:
    return int(name.partition("=")[2])


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions, ascending."""
    done = [x for x in _folders(spark, f"{path}/manifests") if x.startswith("version=")]
    return sorted(_number(x) for x in done if _path(spark, f"{path}/manifests/{x}/_SUCCESS")[0].exists(_path(spark, f"{path}/manifests/{x}/_SUCCESS")[1]))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(chunk_no, at, n) of a version, the latest if none is named; no rows before the first."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else None
    elif version not in known:
        raise ValueError(f"no version {version} in {path}")
    return spark.createDataFrame([], MANIFEST) if version is None else spark.read.schema(MANIFEST).parquet(f"{path}/manifests/version={version}")


def _of_chunks(spark: SparkSession, path: str, schema: str, named: list, missing: str) -> DataFrame:
    found = [f"{path}/data/version={r.at}/chunk_no={r.chunk_no}" for r in named if r.n]
    if missing == "skip":
        found = [x for x in found if _path(spark, x)[0].exists(_path(spark, x)[1])]
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version int").option("basePath", f"{path}/data").parquet(*found)
    return rows.select(*spark.createDataFrame([], schema).columns)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None, missing: str = "fail") -> DataFrame:
    """The rows of a version. ``schema``: their columns, chunk_no among them. ``missing``: whether a chunk whose files are gone is an error or is skipped."""
    return _of_chunks(spark, path, schema, manifest(spark, path, version).collect(), missing)


def commit(rows: DataFrame, path: str, version: int, touched: set[int] | None = None) -> None:
    """Make ``version`` of the one before it and ``rows`` (chunk_no), which are all rows of the chunks ``touched``; of all chunks by default."""
    spark = rows.sparkSession
    before = [v for v in versions(spark, path) if v < version]
    if version in versions(spark, path):
        return
    rows.repartition("chunk_no").write.mode("overwrite").partitionBy("chunk_no").parquet(f"{path}/data/version={version}")
    new = spark.read.schema("chunk_no int").parquet(f"{path}/data/version={version}").groupBy("chunk_no").agg(F.count("*").alias("n")).select("chunk_no", F.lit(version).alias("at"), "n")
    if before and touched is not None:
        new = new.unionByName(manifest(spark, path, before[-1]).where(~F.col("chunk_no").isin(*touched) if touched else F.lit(True)))
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/version={version}")


def merge(spark: SparkSession, path: str, schema: str, upserts: DataFrame, removed: DataFrame, n_chunks: int, version: int | None = None, once: bool = True) -> set[int]:
    """Put ``upserts`` (columns of ``schema`` but chunk_no) in place of their urls, without the urls of ``removed``; returns the chunks written.

    Chunks are by hash of url into ``n_chunks``, the same for all versions. ``version``: the next by default; a version that is there already is left alone. ``once``: see changes.rows_of().
    """
    known = versions(spark, path)
    version = (known[-1] + 1 if known else 0) if version is None else version
    if version in known:
        return set()
    upserts = written(upserts.withColumn("chunk_no", chunks.by_hash(F.col("url"), n_chunks)))
    removed = written(removed.select("url", chunks.by_hash(F.col("url"), n_chunks).alias("chunk_no")))
    touched = {r.chunk_no for r in upserts.select("chunk_no").unionByName(removed.select("chunk_no")).distinct().collect()}
    earlier = [v for v in known if v < version]
    named = [r for r in manifest(spark, path, earlier[-1]).collect() if r.chunk_no in touched] if earlier else []
    old = _of_chunks(spark, path, schema, named, "fail")
    commit(changes.apply_changes(old, upserts, removed, once), path, version, touched)
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all but the last ``keep`` versions, and the files that none of them names, those of unfinished versions before them included."""
    known = versions(spark, path)
    stay = known[-keep:]
    used = {(r.at, r.chunk_no) for v in stay for r in manifest(spark, path, v).collect() if r.n}
    gone = [f"{path}/manifests/version={v}" for v in known if v not in stay]
    for v in _folders(spark, f"{path}/data"):
        if stay and _number(v) < stay[-1]:
            names = [c for c in _folders(spark, f"{path}/data/{v}") if c.startswith("chunk_no=")]
            gone += [f"{path}/data/{v}/{c}" for c in names if (_number(v), _number(c)) not in used]
    for x in gone:
        fs, p = _path(spark, x)
        fs.delete(p, True)
