"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class of Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's folder under the cluster's ``spark.checkpoint.dir``. Only a local master (tests) may do without one and gets a new local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into a new folder under the shared checkpoint folder, and read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_columns(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The columns of ``docs`` but for some as one struct, so that names of an operator's own can't clash with them."""
    return F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c not in without])


def words(text: Column) -> Column:
    """The words of a text (null: none): maximal runs without ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, even where it is used within lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
