"""Wiki: page listing and block forests to a text index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.urls import wiki_url
from docquarry.operators import blocks, dedupe


def listing(raw: DataFrame, most: int | None = None) -> DataFrame:
    """(id, title, url, last_edited) of raw page objects, one for each id; other objects and rows without an id drop out.

    ``ord``, if there is one, is the place in the listing and decides among pages of one date.
    """
    pages = raw.where("object = 'page'").select(
        "id",
        blocks.page_title(F.col("properties"), F.col("title"), F.col("name")).alias("title"),
        F.coalesce("url", wiki_url(F.col("id"))).alias("url"),
        F.col("last_edited_time").alias("last_edited"),
        F.col("ord") if "ord" in raw.columns else F.lit(0).alias("ord"),
    )
    return dedupe.first_in_listing(pages, most).drop("ord")


def build(raw: DataFrame, forest: DataFrame, max_depth: int = 5, max_blocks: int = 500, failed: DataFrame | None = None) -> DataFrame:
    """The wiki index of raw page objects and a block forest (page_id, block_id, parent_id, pos, type, payload)."""
    told = forest.withColumn("text", blocks.block_text(F.col("type"), F.col("payload")))
    texts = blocks.page_texts(blocks.preorder(told, max_depth, max_blocks))
    return blocks.wiki_index(listing(raw), texts, failed)
