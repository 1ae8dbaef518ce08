"""One row for each key, first or last by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: str, best, order: list[Column], **more: Column) -> DataFrame:
    others = [c for c in df.columns if c != key]
    chosen = best(F.struct(F.lit(0), *others), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    rows = df.groupBy(key).agg(chosen.alias("_row"), *[c.alias(name) for name, c in more.items()])
    return rows.select(key, *[F.col(f"_row.{c}").alias(c) for c in others], *more)


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of smallest ``order`` for each key. An aggregate, combined before the shuffle, so hot keys are no matter."""
    return _pick(df, key, F.min_by, list(order))


def keep_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of largest ``order`` for each key, null among them, at the position ``first_at`` of the key's first row; one aggregate."""
    return _pick(df, key, F.max_by, [order], first_at=F.min(order))


def first_in_listing(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Pages by (last_edited descending, ord), cut to ``most`` as the listing asks, then the first of each id; no empty ids."""
    listed = pages.where(F.coalesce("id", F.lit("")) != "")
    if most:
        listed = listed.orderBy(F.desc("last_edited"), "ord").limit(most)
    # latest first: the largest date, and of equal dates the smallest ordinal
    return _pick(listed, "id", F.max_by, [F.col("last_edited"), -F.col("ord")])
