"""Ranking, paging, counting and showing hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import escape_markdown

from .chunks import ordinals


def by_score(collation: str | None = None) -> list[Column]:
    """Score first, then title (under a collation if given), then id, so that ranks are fixed."""
    title = F.collate(F.col("title"), collation) if collation else F.col("title")
    return [F.desc("score"), title, F.col("id")]


def by_date() -> list[Column]:
    return [F.desc("score"), F.desc(F.coalesce(F.unix_millis(F.try_to_timestamp("last_edited")), F.lit(0))), F.col("id")]


def ranked(hits: DataFrame, order: list[Column] | None = None, partition: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Append rank, 1 for the best of each query."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(*partition).orderBy(*(order or by_score()))))


def top(hits: DataFrame, k: int, order: list[Column] | None = None, partition: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query (or source); Spark cuts each task to k before the shuffle."""
    return ranked(hits, order, partition).where(F.col("rank") <= k)


def page_of(page: int, total: Column, per_page: int) -> tuple[Column, Column]:
    """(total pages, the page shown) for a page asked for."""
    pages = F.greatest(F.lit(1), F.ceil(total / per_page)).cast("int")
    return pages, F.least(F.lit(max(1, min(page, 100_000))), pages)


def page(hits: DataFrame, number: int, per_page: int = 10, order: list[Column] | None = None) -> DataFrame:
    """One page of each query's ranked hits, with total, total_pages and page. per_page is 10 or 20; pages past the end show the last.

    Hits are dealt by ranges of the order, so that the hits of one query needn't meet in one task.
    """
    per_page = 20 if per_page == 20 else 10
    placed = ordinals(hits, F.col("query_id"), *(order or by_score()))
    totals = placed.groupBy("query_id").agg(F.count("*").alias("total"), F.min("ordinal").alias("_first"))
    pages, shown = page_of(number, F.col("total"), per_page)
    totals = totals.withColumns({"total_pages": pages, "page": shown})
    last = placed.join(totals, "query_id").withColumn("rank", (F.col("ordinal") - F.col("_first") + 1).cast("int")).drop("ordinal", "_first")
    return last.where((F.col("rank") > (F.col("page") - 1) * per_page) & (F.col("rank") <= F.col("page") * per_page))


def source_counts(hits: DataFrame) -> DataFrame:
    """(query_id, source, n) with a row "all" for each query."""
    counted = hits.rollup("query_id", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g <= 1")
    return counted.select("query_id", F.when(F.col("g") == 1, "all").otherwise(F.col("source")).alias("source"), "n")


def of_source(hits: DataFrame, source: str = "all") -> DataFrame:
    return hits if source == "all" else hits.where(F.col("source") == source)


def project(ranked_hits: DataFrame) -> DataFrame:
    """The fields of a result with their defaults."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return ranked_hits.select("query_id", "rank", text("id"), text("title"), text("url"), text("snippet"), flag("title_match"), flag("body_match"), F.coalesce("score", F.lit(0)).alias("score"), text("source"))


def digest(hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, source, total, lines): the count and the k best of each source as numbered links."""
    key = ("query_id", "source")
    totals = hits.groupBy(*key).agg(F.count("*").alias("total"))
    line = F.format_string("%d. [%s] [%s](%s)", "rank", "source", escape_markdown(F.col("title")), F.col("url"))
    best = top(hits, k, partition=key).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return totals.join(best, list(key))


def with_text(best: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Fetch text for a few ranked hits, so that only they carry it."""
    return docs.select("id", *columns).join(best, "id")
