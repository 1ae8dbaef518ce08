"""Versions of an index, and the stream that writes them."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from docquarry.jobs import kb
from docquarry.sources import snapshots
from docquarry.streaming import refresh

SCHEMA = "url string, v string, chunk_no int"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/data/" in d}


def rows(df):
    return sorted((r.url, r.v) for r in df.collect())


def test_only_touched_chunks_are_written(spark, tmp_path):
    path, made = str(tmp_path / "i"), lambda x: spark.createDataFrame(x, "url string, v string")
    none = made([]).select("url")
    assert snapshots.versions(spark, path) == [] and rows(snapshots.read(spark, path, SCHEMA)) == []
    snapshots.merge(spark, path, SCHEMA, made([(f"u{i}", "a") for i in range(100)]), none, 16)
    first = files(path)
    touched = snapshots.merge(spark, path, SCHEMA, made([("u1", "b"), ("new", "b")]), made([("u2", "")]), 16)
    second = files(path)
    assert first < second and len(touched) <= 3 and all(f"chunk_no={c}" in "".join(second - first) for c in touched)
    assert all(int(f.rpartition("chunk_no=")[2].partition("/")[0]) in touched for f in second - first)
    assert rows(snapshots.read(spark, path, SCHEMA)) == sorted([(f"u{i}", "b" if i == 1 else "a") for i in range(100) if i != 2] + [("new", "b")])
    assert rows(snapshots.read(spark, path, SCHEMA, 0)) == sorted((f"u{i}", "a") for i in range(100))
    assert snapshots.merge(spark, path, SCHEMA, made([("x", "x")]), none, 16, version=1) == set()  # done already
    assert snapshots.merge(spark, path, SCHEMA, made([]), none, 16) == set() and snapshots.versions(spark, path) == [0, 1, 2]
    # all rows of a chunk go
    gone = snapshots.merge(spark, path, SCHEMA, made([]), made([(f"u{i}", "") for i in range(100)]), 16)
    assert len(gone) == 16 and rows(snapshots.read(spark, path, SCHEMA)) == [("new", "b")]
    snapshots.vacuum(spark, path, 1)
    assert snapshots.versions(spark, path) == [3] and rows(snapshots.read(spark, path, SCHEMA)) == [("new", "b")] and len(files(path)) < len(second)
    with pytest.raises(ValueError, match="no version 1"):
        snapshots.read(spark, path, SCHEMA, 1)


def test_a_version_that_was_not_finished(spark, tmp_path):
    path, made = str(tmp_path / "i"), lambda x: spark.createDataFrame(x, SCHEMA)
    snapshots.commit(made([("a", "1", 0), ("b", "1", 1)]), path, 0)
    made([("a", "half", 0), ("z", "half", 5)]).write.partitionBy("chunk_no").parquet(f"{path}/data/version=1")
    assert rows(snapshots.read(spark, path, SCHEMA)) == [("a", "1"), ("b", "1")]
    snapshots.commit(made([("a", "2", 0)]), path, 1, {0})
    assert rows(snapshots.read(spark, path, SCHEMA)) == [("a", "2"), ("b", "1")]


def test_a_missing_chunk(spark, tmp_path):
    import shutil

    path = str(tmp_path / "i")
    snapshots.commit(spark.createDataFrame([("a", "1", 0), ("b", "1", 1)], SCHEMA), path, 0)
    shutil.rmtree(f"{path}/data/version=0/chunk_no=1")
    assert rows(snapshots.read(spark, path, SCHEMA, missing="skip")) == [("a", "1")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        snapshots.read(spark, path, SCHEMA).collect()


def test_refresh_of_chunks_names_what_it_wrote(spark, tmp_path):
    path, now = str(tmp_path / "i"), F.expr("timestamp '2024-06-01 00:00:00'")
    page = lambda t: f"<h1>{t}</h1><article>{'word ' * 60}</article>"
    items = spark.createDataFrame([(f"u{i}", "2024-01-01") for i in range(40)], "url string, lastmod string")
    pages = spark.createDataFrame([(f"u{i}", page(f"Page {i}")) for i in range(40)], "url string, html string")
    kb.refresh_chunks(spark, path, items, pages, now, 8)
    before = files(path)
    later = items.where("url <> 'u3'").withColumn("lastmod", F.when(F.col("url") == "u7", "2024-02-02").otherwise(F.col("lastmod")))
    told, touched = kb.refresh_chunks(spark, path, later, pages.withColumn("html", F.lit(page("Other"))), now, 8)
    assert {(r.url, r.outcome) for r in told.collect()} == {("u3", "removed"), ("u7", "upsert")} and len(touched) <= 2
    assert before < files(path)
    got = {r.url: r.title for r in snapshots.read(spark, path, kb.INDEX).collect()}
    assert got == {f"u{i}": "Other" if i == 7 else f"Page {i}" for i in range(40) if i != 3}


def test_a_killed_batch_is_repeated_from_the_same_state(spark, tmp_path, monkeypatch):
    page = lambda t: f"<h1>{t}</h1><article>{'word ' * 60}</article>"
    day = lambda d: dt.datetime(2024, 1, d)
    drop = lambda x, n: spark.createDataFrame(x, refresh.DROP).coalesce(1).write.parquet(str(tmp_path / "drops" / n))
    args = spark, str(tmp_path / "drops/*"), str(tmp_path / "index"), str(tmp_path / "ck")
    drop([("a", page("A"), day(1)), ("b", page("B"), day(1)), (None, page("N"), day(1)), ("n", page("N"), None)], "1")
    refresh.run(*args, fresh_days=3)
    drop([("a", page("A soon"), day(3)), ("b", page("B2"), day(9)), ("b", page("B3"), day(10)), ("c", page("C"), day(2))], "2")
    commit = snapshots.commit

    def dies(rows, path, version, touched=None):
        rows.withColumn("title", F.lit("half")).write.partitionBy("chunk_no").parquet(f"{path}/data/version={version}")
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshots, "commit", dies)
    with pytest.raises(Exception, match="killed"):
        refresh.run(*args, fresh_days=3)
    assert {(r.url, r.title) for r in snapshots.read(spark, args[2], refresh.INDEX).collect()} == {("a", "A"), ("b", "B")}
    monkeypatch.setattr(snapshots, "commit", commit)
    got = refresh.run(*args, fresh_days=3)
    assert {(r.url, r.title, r.checked_at.day) for r in got.collect()} == {("a", "A", 1), ("b", "B2", 9), ("c", "C", 2)}
    drop([("b", page("B late"), day(8)), ("c", None, day(20)), ("a", page("A2"), day(4))], "3")
    got = refresh.run(*args, fresh_days=3)
    assert {(r.url, r.title) for r in got.collect()} == {("a", "A2"), ("b", "B2"), ("c", "C")}
    assert refresh.run(*args, fresh_days=3).count() == 3  # nothing new
