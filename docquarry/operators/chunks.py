"""Chunks of an index: by hash or by position in title order, their counts, token sets and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import index_tokens
from docquarry.sources.tables import written

#: Fixed size of a sketch: bits and probes.
BITS, PROBES = 65_536, 4


def by_hash(url: Column, n: int) -> Column:
    """A url's chunk, the same whatever else is in the index: eight hex digits of its MD5, which any engine has."""
    return (F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % n).cast("int")


def ordinals(df: DataFrame, *order: Column) -> DataFrame:
    """Append ``ordinal``, 0 for the first in the global order, without bringing all rows to one task.

    Rows are dealt by range; ranks within each range add to the sizes of the ranges before it, a table of one row for each range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    ranged = written(ranged)  # the ranges are fixed from here on
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    # monotonically_increasing_id counts rows within a range in its lower 33 bits
    within = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_before") + within).drop("_part", "_mono", "_before")


def by_position(df: DataFrame, size: int = 250, *order: Column) -> DataFrame:
    """Append chunk_no: 1 for the first ``size`` rows of the order, and so on."""
    return ordinals(df, *order).withColumn("chunk_no", (F.floor(F.col("ordinal") / size) + 1).cast("int")).drop("ordinal")


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy("chunk_no").agg(F.count("*").alias("n"))


def token_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    """(chunk_no, token), each once: the exact form of a chunk's sketch. ``df``: chunk_no, normal (text). ``most`` bounds the tokens of a document, if wanted."""
    return df.select("chunk_no", F.explode(index_tokens(F.col("normal"), most)).alias("token")).distinct()


def probes(token: Column) -> Column:
    """array<int>: the PROBES bits of a token, each four hex digits of its MD5, which any engine has."""
    digest = F.md5(token)
    return F.array(*[F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("int") for k in range(PROBES)])


#: Bits of one bitmap of Spark's bitmap functions; a sketch has two.
HALF = BITS // 2


def sketches(tokens: DataFrame) -> DataFrame:
    """(chunk_no, low, high): each chunk's sketch, BITS bits as two packed bitmaps. ``tokens``: chunk_no, token, repeated or not."""
    bits = tokens.select("chunk_no", F.explode(probes(F.col("token"))).alias("bit"))
    half = lambda name, which: F.expr(f"bitmap_construct_agg(cast(bit % {HALF} as bigint)) FILTER (WHERE bit {which} {HALF})").alias(name)
    return bits.groupBy("chunk_no").agg(half("low", "<"), half("high", ">="))


def merged(sketch: DataFrame) -> DataFrame:
    """One sketch for each chunk of ``sketch``, which may have several, made of parts of the chunk: the same as of the whole."""
    return sketch.groupBy("chunk_no").agg(F.bitmap_or_agg("low").alias("low"), F.bitmap_or_agg("high").alias("high"))


def set_bits(sketch: DataFrame) -> DataFrame:
    """(chunk_no, n_bits)."""
    return sketch.select("chunk_no", (F.bitmap_count("low") + F.bitmap_count("high")).alias("n_bits"))


def _has(bit: Column) -> Column:
    part, at = F.when(bit < HALF, F.col("low")).otherwise(F.col("high")), bit % HALF
    byte = F.conv(F.hex(F.substring(part, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


def may_hold(words: list[str]) -> Column:
    """Whether a chunk's sketch (low, high) has all words. It is about whole tokens, while search is about substrings: a lossy filter."""
    out = F.lit(True)
    for w in words:
        out = out & F.forall(probes(F.lit(w)), _has)
    return out


def prune(df: DataFrame, sketch: DataFrame, words: list[str], most: int | None = None) -> DataFrame:
    """Rows of the chunks that may hold all words; ``most`` of the first such chunks if a cut is wanted (none by default)."""
    good = sketch.where(may_hold(words)).select("chunk_no").orderBy("chunk_no")
    return df.join(good.limit(most) if most else good, "chunk_no", "left_semi")
