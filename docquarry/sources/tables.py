"""Readers and writers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SITEMAPS = "url string, xml string, root_rank int"
ITEMS = "url string, lastmod string"
PAGES = "page_id long, url string, html string"
KB_TITLES = "article_id string, title string, url string, source_lastmod string, language string, checked_at timestamp"
KB_BODIES = "article_id string, title string, text string, url string, checked_at timestamp, language string, chunk_no int"
_PART = "array<struct<plain_text:string,text:struct<content:string>>>"
WIKI_PAGES = f"object string, id string, url string, last_edited_time string, name string, title {_PART}, properties map<string,struct<type:string,title:{_PART}>>"
BLOCKS = "page_id string, block_id string, parent_id string, pos int, type string, has_children boolean, payload string"
WIKI_INDEX = "id string, title string, url string, last_edited string, text string, text_length int, error string"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder under the shared checkpoint folder; only a local master (tests) may do without one and gets a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of files for each partition of a table that is spread: what a task is to take, however large the table is.
PART_BYTES = 8 << 20


def read_parquet(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a folder. ``spread``: over all cores, and PART_BYTES to a partition, where it has fewer files: a file may be one row group, which no split of it divides."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not spread:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return df.repartition(wanted) if min(len(df.inputFiles()), df.rdd.getNumPartitions()) < wanted else df


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Artifacts of one JSON object each, plain or gzipped, with an array ``records`` of ``schema``."""
    return spark.read.schema(f"records array<struct<{', '.join(_colons(schema))}>>").option("multiLine", True).json(path).select(F.inline("records"))


def _colons(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields]


def write_records(df: DataFrame, path: str) -> None:
    """Plain JSON artifacts, one object with an array ``records`` for each chunk_no, in a folder of its own; chunks are of bounded size."""
    columns = [F.col(c) for c in df.columns if c != "chunk_no"]
    df.groupBy("chunk_no").agg(F.collect_list(F.struct(*columns)).alias("records")).write.mode("overwrite").partitionBy("chunk_no").json(path)


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page objects, one JSON line each, with ``ord``, their place in the listing, where the lines have one."""
    return spark.read.schema(f"{WIKI_PAGES}, ord long").json(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of wiki pages, one JSON line each; the payload stays text."""
    return spark.read.schema(BLOCKS).json(path)


def read_raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(raw VARIANT): one JSON object a line, of any shape; null where a line is no JSON. See blocks.from_raw()."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("raw"))


def write_chunks(df: DataFrame, path: str) -> None:
    """One gzipped JSON line for each record, in a folder for each chunk_no."""
    df.write.mode("overwrite").option("compression", "gzip").partitionBy("chunk_no").json(path)


def read_chunks(spark: SparkSession, path: str, schema: str, expected: int | None = None) -> DataFrame:
    """All chunks of a run; with ``expected``, an error if one is missing."""
    out = spark.read.schema(schema).json(path)
    if expected is not None and (found := out.select("chunk_no").distinct().count()) != expected:
        raise ValueError(f"{found} of {expected} chunks in {path}")
    return out


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """Write ``df`` to ``path`` in buckets of ``key``, sorted in each, as a table of the session's catalogue, and return its name.

    Joins and aggregates by ``key`` take the buckets as they are; what is joined to them is dealt to as many.
    """
    name = f"buckets_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return name


def read_sitemap_items(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of sitemap files; lastmod stays text."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html): a file for each page, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def publish(index: DataFrame, path: str, failed: int, created_at, version: int = 1, language: str = "en") -> None:
    """The records as the next publication under ``path``, and beside them one row of version, language, created_at, page_count and failed_count.

    Rows are counted by the job that writes them. The header is written last, as one file, and read_published() goes by headers: until it is there, readers see the publication before.
    """
    spark, counted = index.sparkSession, Observation()
    last = _publications(spark, path)
    # a publication that was begun and not finished is written anew
    now = f"publication={last + 1}"
    index.observe(counted, F.count(F.lit(1)).alias("page_count")).write.mode("overwrite").parquet(f"{path}/records/{now}")
    header = spark.range(1).select(
        F.lit(version).alias("version"), F.lit(language).alias("language"), F.lit(created_at).alias("created_at"), F.lit(counted.get["page_count"]).cast("long").alias("page_count"), F.lit(failed).alias("failed_count")
    )
    header.coalesce(1).write.mode("overwrite").parquet(f"{path}/header/{now}")


def _publications(spark: SparkSession, path: str) -> int:
    """The number of the last finished publication, 0 if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [x.getName() for x in found if x.getName().startswith("publication=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return max((int(x.partition("=")[2]) for x in done), default=0)


def read_published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, header) of the last finished publication."""
    now = f"publication={_publications(spark, path)}"
    return spark.read.parquet(f"{path}/records/{now}"), spark.read.parquet(f"{path}/header/{now}")
