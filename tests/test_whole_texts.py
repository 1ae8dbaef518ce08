"""Queries that read whole texts, on pages whose letters change behind the first thousands of characters."""

import duckdb
import pytest

from docquarry import catalog
from docquarry.functions import language
from docquarry.jobs import kb

from .test_catalog import same

#: By page: so many Latin words, then so many Hangul ones, then Latin ones again.
TEXTS = {1: (1800, 1800, 0), 2: (1800, 0, 0), 3: (1500, 40, 0), 4: (10, 200, 5000), 5: (0, 1700, 6000), 6: (3000, 400, 0), 7: (900, 900, 0), 8: (50, 0, 0)}


def text(latin, localized, rest):
    return " ".join(["word"] * latin + ["가나"] * localized + ["more"] * rest)


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    rows = [(7 * k + 4, f"https://e.example/{k}", f"<h1>Page {k}</h1><article>{text(*t)}</article>") for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(long):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{long}/pages.parquet/*.parquet'")
    return con


#: Queries whose SQL states a cut; they take it as a parameter.
CUT = ["outcome_counters", "record_gate", "index_stats", "published_headers", "title_places", "publish_with_failures", "build_repeated_pages", "refresh_repeated_pages", "kb_from_sitemaps", "kb_build_with_reuse", "kb_refresh", "refresh_with_bodies", "chunked_refresh", "streamed_refresh", "keyed_stream"]


@pytest.mark.parametrize("name", ["latin_gate", "kb_build", *CUT])
def test_same_as_sql(spark, duck, long, name, monkeypatch):
    monkeypatch.setattr("tests.test_catalog.FOLDER", long)
    same(spark, duck, name)


def passes(k):
    latin, localized = 4 * (TEXTS[k][0] + TEXTS[k][2]), 2 * TEXTS[k][1]
    return not localized >= 0.08 * (latin + localized) or localized < 12


def test_the_gate_reads_whole_texts(spark, long):
    got = {(r.page_id - 4) // 7: (r.by_body, r.by_title, r.legacy) for r in catalog.latin_gate(spark, long).collect()}
    assert {k: got[k][0] for k in TEXTS} == {k: passes(k) for k in TEXTS} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True}
    assert all(got[k][1:] == (got[k][0],) * 2 for k in TEXTS)


def test_the_build_uses_whole_texts(spark, long):
    got = {int(r.url.rsplit("/", 1)[1]): r for r in catalog.kb_build(spark, long).collect() if not r.url.endswith("missing")}
    assert {k: got[k].text_length for k in TEXTS} == {k: len(text(*t)) for k, t in TEXTS.items()}
    assert {k: (got[k].outcome, got[k].in_bodies) for k in TEXTS} == {k: ("english" if passes(k) else "skipped", passes(k)) for k in TEXTS}


def test_extracts_are_whole_or_as_long_as_asked(spark):
    pages = spark.createDataFrame([("https://e.example/1", f"<h1>A</h1><article>{text(1800, 1800, 0)}</article>")], "url string, html string")
    whole, cut = kb.extract(pages).first(), kb.extract(pages, kb.Extent(stored=4000, read=8000)).first()
    assert (len(whole.text), whole.passes, whole.fits) == (len(text(1800, 1800, 0)), False, False)
    assert (len(cut.text), cut.passes, cut.fits) == (4000, True, True)


def test_a_cut_is_taken_where_it_is_asked_for(one):
    page = lambda by: one(lambda t, b, u: language.is_latin_page(t, b, u, by), "A", text(2000, 2000, 0), "https://x.example/a")
    for by in (language.TITLE, language.BODY, language.LEGACY):
        assert not page(by) and page(by.first(8000))
