"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut

#: A table is broadcast up to this many rows of two or three long columns; more go through an ordinary join.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is small. It is counted, so it should be a written table."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b) links, whose component is the smallest node reachable.

    Large-star and small-star steps by turns: each node's neighbours are hung on the smallest node it knows. The
    minima are partial aggregates; they are joined back by broadcast where the counted links bound them, else
    by an ordinary join. Both steps of a turn are one job, and a count with a checksum tells when nothing moves.
    Nulls and links of a node with itself are left out; repeated links count once. No link gives no row.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = cut(pairs), None
    while (now := _checksum(pairs)) != before and now[0]:
        before = now
        near = F.broadcast if 2 * now[0] <= SMALL_ROWS else (lambda df: df)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(near(lowest), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        hung = large.join(near(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        star = hung.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = cut(star.where("u <> v").distinct())
    root = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)


def _checksum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
