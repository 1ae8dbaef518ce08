"""Queries against their SQL on pages that share urls, and on queries whose words hold a line feed."""

import duckdb
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry import catalog

from .test_catalog import FOLDER, TABLES, same

NAMED = {
    "F1": "apply_changes", "F2": "build_repeated_pages", "F3": "change_set", "F4": "change_set_from_buckets", "F5": "chunk_assign", "F6": "chunked_refresh", "F7": "index_stats", "F8": "kb_build", "F9": "kb_build_with_reuse",
    "F10": "kb_from_sitemaps", "F11": "kb_refresh", "F12": "keyed_stream", "F14": "plan_with_extras",
}
ALIKE = ["unchanged_urls", "reuse_or_refetch", "publish_with_failures", "published_headers", "refresh_with_bodies", "sitemap_items", "streamed_refresh", "title_places"]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest tables with every ninth page's url that of the page before it, and benchmark items whose third to sixth words hold line feeds."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    pages = read("pages")
    before = F.lag("url").over(W.orderBy("page_id"))
    pages.select("page_id", F.coalesce(F.when(F.col("page_id") % 9 == 0, before), "url").alias("url"), "html").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    line = read("documents").where("text like '%\n%'").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("a"), F.split_part("text", F.lit("\n"), F.lit(2)).alias("b"), "doc_id")
    last, first = F.element_at(F.split("a", " "), -1), F.split_part("b", F.lit(" "), F.lit(1))
    held = F.concat(last, F.lit("\n"), first)
    second = F.split_part("b", F.lit(" "), F.lit(2))
    texts = line.where(~F.concat_ws(" ", last, first, second).rlike("[&|]") & last.rlike(r"\S") & first.rlike(r"\S") & second.rlike(r"\S")).orderBy("doc_id").limit(20).select(F.concat(F.lit("one two "), held, F.lit(" "), second, F.lit(" "), held, F.lit(" the")).alias("text"))
    texts.coalesce(1).select(F.monotonically_increasing_id().alias("item_id"), "text").write.parquet(f"{folder}/benchmark.parquet")
    for name in set(TABLES) - {"pages", "benchmark"}:
        read(name).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(repeated):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{repeated}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", [*NAMED.values(), *ALIKE, "many_queries"])
def test_same_as_sql(spark, duck, repeated, name, monkeypatch):
    monkeypatch.setattr("tests.test_catalog.FOLDER", repeated)
    same(spark, duck, name)


def test_the_tables_have_what_is_tested(duck):
    assert duck.sql("SELECT count(*) - count(DISTINCT url) FROM pages").fetchall()[0][0] >= 5
    assert duck.sql("SELECT count(*) FROM benchmark WHERE contains(split_part(text, ' ', 3), chr(10))").fetchall()[0][0] == 20


def test_equal_urls_are_dealt_by_page(spark, tmp_path):
    """The order of chunk_assign is a whole one: pages that share a url come by page_id, whatever way they are read."""
    spark.range(120).select((119 - F.col("id")).alias("page_id"), F.lit("https://e.example/x").alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.chunk_no for r in catalog.chunk_assign(spark, str(tmp_path)).collect()} == {i: i // 50 + 1 for i in range(120)}
