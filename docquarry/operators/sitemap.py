"""Sitemaps: parsing XML columns, walking from a root to the articles, choosing the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import decode_entities, trim
from docquarry.sources.tables import written

from .dedupe import keep_last


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?i)<{tag}\b[^>]*>([\s\S]*?)</{tag}>"), F.lit(1))


def _field(block: Column, tag: str) -> Column:
    return trim(decode_entities(F.regexp_extract(block, rf"(?i)<{tag}[^>]*>([\s\S]*?)</{tag}>", 1)))


def parse(sitemaps: DataFrame) -> DataFrame:
    """(url, kind, loc, lastmod, pos) for each entry of each sitemap (url, xml): kind page or sitemap.

    A sitemap with neither <url> nor <sitemap> blocks gives its bare <loc> elements as pages.
    """
    entry = lambda kind, loc, lastmod: F.struct(F.lit(kind).alias("kind"), loc.alias("loc"), F.nullif(lastmod, F.lit("")).alias("lastmod"))
    pages = F.transform(_blocks(F.col("xml"), "url"), lambda b: entry("page", _field(b, "loc"), _field(b, "lastmod")))
    nested = F.transform(_blocks(F.col("xml"), "sitemap"), lambda b: entry("sitemap", _field(b, "loc"), F.lit("")))
    bare = F.transform(_blocks(F.col("xml"), "loc"), lambda b: entry("page", trim(decode_entities(b)), F.lit("")))
    found = sitemaps.select("url", F.concat(pages, nested).alias("e"), bare.alias("b"))
    return found.select("url", F.posexplode(F.when(F.size("e") > 0, F.col("e")).otherwise(F.col("b"))).alias("pos", "x")).select("url", "x.kind", "x.loc", "x.lastmod", "pos").where("loc <> ''")


def reach(entries: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(root, url, level, path): the sitemaps that each root reaches within ``depth`` levels, each once.

    level: the first at which it is reached; path: the places at which sitemaps are named on the way, the first such path in reading order, which
    takes a sitemap's own entries and then its nested sitemaps one after the other. Cycles end at the depth. One equi-join for each level.
    """
    edges = written(entries.where("kind = 'sitemap'").groupBy(F.col("url").alias("_from"), F.col("loc").alias("_to")).agg(F.min("pos").alias("_pos")))
    frontier = roots.select(F.col("url").alias("root"), "url", F.lit(0).alias("level"), F.array().cast("array<int>").alias("path"))
    seen = frontier
    for level in range(1, depth + 1):
        step = frontier.join(edges, F.col("url") == F.col("_from")).groupBy("root", F.col("_to").alias("url"))
        frontier = written(step.agg(F.min(F.concat("path", F.array("_pos"))).alias("path")).select("root", "url", F.lit(level).alias("level"), "path"))
        seen = seen.unionByName(frontier)
    return seen.groupBy("root", "url").agg(F.min("level").alias("level"), F.min("path").alias("path"))


def items(entries: DataFrame, reached: DataFrame, canonical=lambda c: c, newest: bool = False) -> DataFrame:
    """(root, url, lastmod, ord): articles in reading order, the last entry of each canonical url at its first place; ``newest``: the latest lastmod of its entries instead."""
    found = entries.where("kind = 'page'").join(reached.select("root", F.col("url").alias("_map"), "path"), F.col("url") == F.col("_map"))
    listed = found.select("root", canonical(F.col("loc")).alias("url"), "lastmod", F.struct("path", "pos").alias("at")).where("url is not null")
    if newest:
        return listed.groupBy("root", "url").agg(F.max("lastmod").alias("lastmod"), F.min("at").alias("ord"))
    key = listed.withColumn("k", F.struct("root", "url")).drop("root", "url")
    return keep_last(key, "k", F.col("at")).select("k.root", "k.url", "lastmod", F.col("first_at").alias("ord"))


def choose_root(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Items of the first root (by root_rank) that has any."""
    counted = found.groupBy("root").agg(F.count("*").alias("n")).join(roots.select(F.col("url").alias("root"), "root_rank"), "root")
    first = counted.agg(F.min_by("root", "root_rank").alias("root"))
    return found.join(first, "root", "left_semi")


def extra_urls(spark, text: str, canonical=lambda c: c) -> DataFrame:
    """(url) from a list separated by commas and line feeds."""
    one = spark.range(1).select(F.explode(F.split(F.lit(text), r"[\n,]")).alias("u"))
    return one.select(canonical(trim(F.col("u"))).alias("url")).where("url <> ''").distinct()
