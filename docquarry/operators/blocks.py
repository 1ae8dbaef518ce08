"""Block forests of wiki pages: text of a block, preorder walks with caps on depth and count, text of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import normalize_space
from docquarry.sources.tables import written

RICH = "array<struct<plain_text:string,text:struct<content:string>>>"
#: What a block's payload may hold.
PAYLOAD = f"rich_text {RICH}, caption {RICH}, title string, url string, expression string"
UNTITLED = "제목 없음"


def rich_text(parts: Column) -> Column:
    """Plain text of rich text parts."""
    one = lambda p: F.coalesce(F.nullif(p["plain_text"], F.lit("")), p["text"]["content"], F.lit(""))
    return F.coalesce(normalize_space(F.array_join(F.transform(parts, one), "")), F.lit(""))


def page_title(properties: Column, title: Column, name: Column) -> Column:
    """The first property of type title that has a text, else the title parts, else the name, else a fixed note."""
    texts = F.transform(F.filter(F.map_values(properties), lambda p: p["type"] == "title"), lambda p: rich_text(p["title"]))
    named = F.get(F.filter(texts, lambda t: t != ""), F.lit(0))
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(named), filled(rich_text(title)), filled(name), F.lit(UNTITLED))


def block_text(kind: Column, payload: Column) -> Column:
    """A block's text: rich text and caption, a child page's title, a link's URL, an equation; else nothing."""
    data = F.from_json(payload, PAYLOAD)
    rich = normalize_space(F.array_join(F.filter(F.array(rich_text(data["rich_text"]), rich_text(data["caption"])), lambda x: x != ""), " "))
    return F.coalesce(
        F.when(data["rich_text"].isNotNull(), rich)
        .when(kind.isin("child_page", "child_database"), normalize_space(data["title"]))
        .when(kind.isin("bookmark", "embed", "link_preview"), data["url"])
        .when(kind == "equation", data["expression"]),
        F.lit(""),
    )


def from_raw(raw: DataFrame) -> DataFrame:
    """(page_id, block_id, parent_id, pos, type, has_children, text) of raw block objects (raw VARIANT), in which what a block holds stands under the name of its type.

    Each field is taken by itself, so that an object of an odd shape loses only that field; a row that was no JSON has nulls and no text.
    """
    get = lambda path, kind: F.try_variant_get("raw", path, kind)
    kind = get("$.type", "string")
    # a name that could not stand in a path has no payload
    payload = lambda field, to: get(F.when(kind.rlike("^[a-z][a-z0-9_]*$"), F.concat(F.lit("$."), kind, F.lit(f".{field}"))), to)
    rich, caption = payload("rich_text", RICH), payload("caption", RICH)
    joined = normalize_space(F.array_join(F.filter(F.array(rich_text(rich), rich_text(caption)), lambda x: x != ""), " "))
    text = (
        F.when(rich.isNotNull() | caption.isNotNull(), joined)
        .when(kind.isin("child_page", "child_database"), normalize_space(payload("title", "string")))
        .when(kind.isin("bookmark", "embed", "link_preview"), payload("url", "string"))
        .when(kind == "equation", payload("expression", "string"))
    )
    return raw.select(
        get("$.page_id", "string").alias("page_id"), get("$.id", "string").alias("block_id"), get("$.parent.block_id", "string").alias("parent_id"), get("$.pos", "int").alias("pos"),
        kind.alias("type"), F.coalesce(get("$.has_children", "boolean"), F.lit(False)).alias("has_children"), F.coalesce(text, F.lit("")).alias("text"),
    )


def preorder(blocks: DataFrame, max_depth: int = 5, max_blocks: int = 500) -> DataFrame:
    """(page_id, block_id, depth, path, text) of the first ``max_blocks`` blocks of each page down to ``max_depth``.

    ``blocks``: page_id, block_id, parent_id (null at the top), pos, text. One equi-join for each level, carrying the path of
    positions, by which arrays sort in preorder. Blocks without text count towards the cap, as the feature has it.
    """
    children = blocks.select(F.col("page_id").alias("_page"), F.col("block_id").alias("_id"), F.col("parent_id").alias("_parent"), F.col("pos").alias("_pos"), F.col("text").alias("_text"))
    level = blocks.where("parent_id is null").select("page_id", "block_id", F.lit(0).alias("depth"), F.array("pos").alias("path"), "text")
    walked = level
    for depth in range(1, max_depth + 1):
        level = level.join(children, (F.col("page_id") == F.col("_page")) & (F.col("block_id") == F.col("_parent"))).select(
            "page_id", F.col("_id").alias("block_id"), F.lit(depth).alias("depth"), F.concat("path", F.array("_pos")).alias("path"), F.col("_text").alias("text")
        )
        walked = walked.unionByName(level)
    place = F.row_number().over(W.partitionBy("page_id").orderBy("path"))
    return walked.withColumn("_n", place).where(F.col("_n") <= max_blocks).drop("_n")


def preorder_deep(blocks: DataFrame, max_depth: int | None = None, max_blocks: int = 500) -> DataFrame:
    """The same as preorder() for trees of any depth, in as many joins as the depth has binary digits.

    Each block holds its path up to an ancestor; a step puts the ancestor's own path before it, which doubles the reach. Blocks in a cycle or without a way to the
    top never get there and drop out: a step that brings nobody to the top is the last. Paths are as long as blocks are deep.
    """
    texts = blocks.select("page_id", "block_id", "text")
    here = written(blocks.select("page_id", "block_id", F.col("parent_id").alias("up"), F.array("pos").alias("path")))
    rooted = -1
    while (now := here.where("up is null").count()) > rooted:
        rooted = now
        above = here.select(F.col("page_id").alias("_page"), F.col("block_id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        open_ = here.where("up is not null").join(above, (F.col("page_id") == F.col("_page")) & (F.col("up") == F.col("_id")))
        reached = open_.select("page_id", "block_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        here = written(here.where("up is null").unionByName(reached))
    walked = here.where("up is null").withColumn("depth", F.size("path") - 1).join(texts, ["page_id", "block_id"])
    walked = walked if max_depth is None else walked.where(F.col("depth") <= max_depth)
    return walked.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("path"))).where(F.col("_n") <= max_blocks).select("page_id", "block_id", "depth", "path", "text")


def page_texts(walked: DataFrame) -> DataFrame:
    """(page_id, text, text_length): the blocks' texts in preorder, one line each, normalized."""
    lines = F.array_sort(F.collect_list(F.struct("path", "text")))
    joined = F.array_join(F.filter(F.transform(lines, lambda x: x["text"]), lambda t: t != ""), "\n")
    return walked.groupBy("page_id").agg(normalize_space(joined).alias("text")).withColumn("text_length", F.length("text"))


def wiki_index(listing: DataFrame, texts: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The listing (id, title, url, last_edited) with text, text_length and error; pages without blocks have no text."""
    out = listing.join(texts.withColumnRenamed("page_id", "id"), "id", "left").withColumns({"text": F.coalesce("text", F.lit("")), "text_length": F.coalesce("text_length", F.lit(0))})
    return out.join(failed.select("id", "error"), "id", "left") if failed is not None else out.withColumn("error", F.lit(None).cast("string"))
