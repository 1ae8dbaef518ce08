"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash of its id. A source whose target is ``e`` whole passes
plus a remainder takes every document ``e`` times, and once more those whose hash lies below
the source's threshold. The threshold comes from nested histograms: words by (source, first
12 bits of the hash) give the bucket in which the running sum crosses the remainder, and only
that bucket is refined by the next 12 bits, until it holds one hash value. No document is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import SPACE, cut

BITS, LEVELS = 12, 5
#: Sources up to this number are joined by broadcast; more go through an ordinary join.
BROADCAST_SOURCES = 50_000


def order_hash(doc_id: Column) -> Column:
    """A 60-bit hash of the id as text, the same in other engines: the first 15 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Append, for each name, the sum over all rows before in ``order``, which has no ties.

    Rows are dealt by range; what lies before a range is told by the sums of the ranges, one row for each. Whole numbers in doubles
    add up exactly in any grouping.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # ranges are fixed from here on
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    of_ranges = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_in_{n}") for n, c in sums.items()])
    ranges = ranges.select("_part", *[F.coalesce(F.sum(f"_in_{n}").over(of_ranges), F.lit(0)).alias(f"_to_{n}") for n in sums])
    told = {n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_to_{n}") for n, c in sums.items()}
    return ranged.join(F.broadcast(ranges), "_part").withColumns(told).drop("_part", *[f"_to_{n}" for n in sums])


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Append weight and target to one row per source (source, source_size); sources may be very many.

    Sources by code point, null last, take ``weights`` in turn. The whole budget is ``share``
    times all sizes; targets stop at ``cap`` times the source's size and what that leaves
    over is shared again by weight among the others until none is above. That fixed point is
    min(cap * size, level * weight): sources in order of cap * size / weight are capped as long as
    sharing the rest by weight would put them above.
    """
    ranked = _with_sums_before(totals, [F.col("source").isNull(), F.col("source")], {"_rank": F.lit(1)})
    nth = (F.col("_rank") % len(weights)).cast("int") + 1
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth)).withColumn("_full", cap * F.col("source_size").cast("double"))
    order = [F.col("_full") / F.col("weight"), F.col("_rank")]
    summed = _with_sums_before(weighed, order, {"_filled": F.col("_full"), "_weighed": F.col("weight")})
    whole = summed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    levelled = (
        summed.withColumn("_rest", share * F.lit(float(whole["size"] or 0)) - F.col("_filled"))
        .withColumn("_level", F.greatest(F.lit(0.0), F.col("_rest")) / (F.lit(whole["weight"] or 0.0) - F.col("_weighed")))
        .withColumn("_capped", F.col("_full") <= F.col("_level") * F.col("weight"))
    )
    # the level of the first source that isn't capped holds for all that follow it
    first = levelled.where(~F.col("_capped")).agg(F.min(F.struct(*order, "_level"))["_level"].alias("level")).first()["level"]
    shared = F.col("_full") if first is None else F.least(F.col("_full"), first * F.col("weight"))
    return levelled.select("source", "source_size", "weight", F.when(F.col("_capped"), F.col("_full")).otherwise(shared).alias("target"))


def _with_sources(left: DataFrame, right: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null; a broadcast only for a checked number of sources."""
    r = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(r) if few else r, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def thresholds(sized: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """(source, _limit): the hash below which, limit included, documents get one more copy; -1 for none.

    ``wanted``: (source, _need), the words still missing after whole passes. Each level makes one
    histogram of the bucket at hand; the last one decides by which side of the need is nearer.
    """
    state = wanted.select("source", F.lit(0).cast("long").alias("_prefix"), F.col("_need"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = _with_sources(sized, state.withColumnRenamed("_need", "_left"), few).where(F.shiftright("_hash", shift + BITS) == F.col("_prefix"))
        histogram = inside.groupBy("source", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
        running = W.partitionBy("source").orderBy("_bucket")
        summed = histogram.withColumn("_upto", F.sum("_words").over(running))
        # the first bucket whose running sum reaches the need; where none does (rounding), the last bucket
        edge = summed.groupBy("source").agg(
            F.coalesce(
                F.min(F.when(F.col("_upto") >= F.col("_left"), F.struct("_bucket", "_upto", "_words", "_left"))),
                F.max(F.struct("_bucket", "_upto", "_words", "_left")),
            ).alias("e")
        )
        state = edge.select("source", F.col("e._bucket").alias("_prefix"), (F.col("e._left") - F.col("e._upto") + F.col("e._words")).alias("_need"), F.col("e._words").alias("_words"))
        state = cut(state)
    nearer = F.when(F.col("_need") * 2 >= F.col("_words"), F.col("_prefix")).otherwise(F.col("_prefix") - 1)
    return state.select("source", nearer.alias("_limit"))


def mixing_plan(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, bool]:
    """One row per source: (source, source_size, target, _passes, _limit); and whether the sources are few.

    ``sized``: (source, size, _hash), read several times.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, weights, share, cap))
    few = targets.count() <= BROADCAST_SOURCES
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("long")
    planned = targets.withColumn("_passes", passes).withColumn("_need", F.col("target") - F.col("_passes") * F.col("source_size"))
    limits = thresholds(sized, planned.where((F.col("_need") > 0) & (F.col("_passes") < int(cap))).select("source", "_need"), few)
    plan = _with_sources(planned, limits, few, "left")
    return plan.select("source", "source_size", "target", "_passes", F.coalesce("_limit", F.lit(-1)).alias("_limit")), few


def _sized(docs: DataFrame, text: str) -> DataFrame:
    counted = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return cut(docs.select("doc_id", "source", counted.alias("size"), order_hash(F.col("doc_id")).alias("_hash")))


#: Copies of a document, once the plan of its source and its _hash are beside it.
COPIES = "_passes + cast(_hash <= _limit as bigint)"


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each document.

    size: words of the text (null or empty: 0). copies: how often the mix takes the document, at most
    ``cap`` times; taken = size * copies. A source's taken words differ from its target by half of
    the document at its threshold at most. Repeated rows of one id stand or fall together.
    An empty table gives no rows. Runs agree, since only ids and sizes decide.
    """
    sized = _sized(docs, text)
    plan, few = mixing_plan(sized, weights, share, cap)
    copies = F.expr(COPIES)
    return _with_sources(sized, plan, few).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, text: str = "text") -> DataFrame:
    """``docs`` as often as mix() takes them, with their own columns; texts meet only the plan of their source."""
    columns = docs.columns
    plan, few = mixing_plan(_sized(docs, text), weights, share, cap)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_own"), "source", order_hash(F.col("doc_id")).alias("_hash"))
    joined = _with_sources(own, plan, few).withColumn("_copies", F.expr(COPIES)).where("_copies > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_own.*")
