"""Queries against their SQL on pages of which up to five share a url."""

import duckdb
import pytest
from pyspark.sql import functions as F

from .test_catalog import FOLDER, same


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """The smallest pages: five by five under one url up to the 25th, then three and two, then each its own."""
    folder, k = str(tmp_path_factory.mktemp("shared")), F.col("page_id")
    first = F.when(k < 25, k - k % 5).when(k < 28, 25).when(k < 31, 29).otherwise(k)
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    urls = pages.select(k.alias("first"), "url")
    pages.drop("url").withColumn("first", first).join(urls, "first").select("page_id", "url", "html").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(shared):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{shared}/pages.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["refresh_repeated_pages", "sitemap_last_entries"])
def test_same_as_sql(spark, duck, shared, name, monkeypatch):
    monkeypatch.setattr("tests.test_catalog.FOLDER", shared)
    same(spark, duck, name)
