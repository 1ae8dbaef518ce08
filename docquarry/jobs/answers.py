"""Batch search over wiki and knowledge base: hits, merged, ranked, with snippets for what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import query as Q
from docquarry.operators import results, search
from docquarry.sources.tables import written


def hits(wiki: DataFrame, kb: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, title, score, title_match, body_match, source): all hits of both corpora.

    ``wiki`` and ``kb`` as search.documents() makes them; for the knowledge base, title and body hits of an article merge.
    """
    shown = lambda df: df.withColumns({"url": F.col("id"), "snippet": F.lit("")})
    own = search.search(wiki, queries, search.WIKI).select("query_id", "id", "title", "score", "title_match", "body_match", F.lit("wiki").alias("source"))
    both = search.merge_title_and_body(shown(search.search(kb, queries, search.KB_TITLE)), shown(search.search(kb, queries, search.KB_BODY)))
    return own.unionByName(both.select("query_id", F.col("url").alias("id"), "title", "score", "title_match", "body_match", F.lit("kb").alias("source")))


def store(docs: DataFrame, path: str) -> None:
    """Write the searchable form of search.documents() once, so that queries needn't normalize texts again."""
    docs.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def page(wiki: DataFrame, kb: DataFrame, queries: DataFrame, number: int = 1, per_page: int = 10, source: str = "all") -> DataFrame:
    """One page of ranked hits for each query; text is fetched and cut to snippets only for the rows on it."""
    found = results.of_source(hits(wiki, kb, queries), source)
    shown = results.page(found, number, per_page, [F.desc("score"), F.col("title"), F.col("source"), F.col("id")])
    texts = wiki.select("id", "text", F.lit("wiki").alias("source")).unionByName(kb.select("id", "text", F.lit("kb").alias("source")))
    asked = written(queries.select("query_id", "raw"))
    shown = written(shown)
    few = F.broadcast if asked.count() <= search.BLOCK else (lambda df: df)  # then a page has at most twenty rows for each of so many queries
    with_text = texts.join(few(shown), ["id", "source"]).join(few(asked), "query_id")
    return with_text.withColumn("snippet", Q.wiki_snippet(F.col("text"), F.col("raw"))).drop("text")
