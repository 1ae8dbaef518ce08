"""One row for each url whatever the input, and records that outlive a failed fetch."""

from pyspark.sql import functions as F

from docquarry.jobs import kb
from docquarry.operators import changes, dedupe, search

def now():
    return F.expr("timestamp '2024-06-01 00:00:00'")


GOOD = "<h1>{}</h1><article>" + "word " * 60 + "</article>"


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, "a", 2), (None, "b", 1), ("k", "c", 1)], "k string, v string, o int")
    assert {(r.k, r.v, r.first_at) for r in dedupe.keep_last(df, "k", F.col("o")).collect()} == {(None, "a", 1), ("k", "c", 1)}
    assert {(r.k, r.v) for r in dedupe.keep_first(df, "k", F.col("o")).collect()} == {(None, "b"), ("k", "c")}


def test_the_last_row_of_a_url_counts(spark):
    df = spark.createDataFrame([("u", "z", 1), ("u", "a", 2), (None, "b", 3), ("", "b", 3)], "url string, lastmod string, ord int")
    assert [tuple(r) for r in changes.filled(df).collect()] == [("u", "a")]
    assert [tuple(r) for r in changes.filled(df.drop("ord")).collect()] == [("u", "z")]
    assert [tuple(r) for r in changes.filled(df.select("url")).collect()] == [("u",)]
    index = spark.createDataFrame([("u", "old"), ("v", "old")], "url string, lastmod string")
    assert sorted(tuple(r) for r in changes.apply_changes(index, df.where("url = 'u'"), index.where("false").select("url")).collect()) == [("u", "a"), ("v", "old")]


def test_build_and_refresh_give_one_row_for_each_url(spark):
    items = spark.createDataFrame([("u1", "2024-02-02", 1), ("u1", "2024-01-01", 2)], "url string, lastmod string, ord int")
    pages = spark.createDataFrame([("u1", GOOD.format("Hello"), 1), ("u1", GOOD.format("Ahoy"), 2)], "url string, html string, ord int")
    assert [(r.url, r.title, r.source_lastmod) for r in kb.build(items, pages, now()).collect()] == [("u1", "Ahoy", "2024-01-01")]
    index = kb.build(items, pages, now()).where("false")
    assert [(r.url, r.title) for r in kb.refresh(index, items, pages, now())[0].collect()] == [("u1", "Ahoy")]


def test_a_failed_page_keeps_its_record(spark):
    items = spark.createDataFrame([("u1", "2024-02-02"), ("u2", "2024-02-02"), ("u3", None), ("u4", None)], "url string, lastmod string")
    pages = spark.createDataFrame([], "url string, html string")
    old = spark.createDataFrame([("u1", "Old one", "text"), ("u2", "Old two", ""), ("u3", "старый", "text")], "url string, title string, text string")
    got = {r.url: (r.outcome, r.title, r.in_bodies) for r in kb.build(items, pages, now(), old).collect()}
    assert got == {"u1": ("kept", "Old one", True), "u2": ("kept", "Old two", False), "u3": ("failed", None, False), "u4": ("failed", None, False)}


def test_more_queries_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    docs = search.documents(spark.createDataFrame([(1, "a b c", "d e")], "id int, title string, text string"), F.col("id"), F.col("title"), F.col("text"))
    asked = search.parsed(search.query_table(spark, ["a", "b & c", "d | a", "zz", "e", "x & a"]))
    assert sorted(r.query_id for r in search.search(docs, asked).collect()) == [1, 2, 3, 5]
    assert sorted(r.query_id for r in search.old_boolean(docs, asked).collect()) == [2, 3]
    assert sorted(r.query_id for r in search.token_ranker(docs, asked.where("not has_ops")).collect()) == [1, 5]
