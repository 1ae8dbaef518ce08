import pytest
from pyspark.sql import functions as F

from docquarry.operators import blocks, changes, chunks, dedupe, results, search, sitemap


@pytest.fixture
def hits(spark):
    def run(title, body, raw, by=search.WIKI, article_id=""):
        docs = spark.createDataFrame([(1, title, body, article_id)], "id long, title string, text string, a string")
        docs = search.documents(docs, F.col("id"), F.col("title"), F.col("text"), F.col("a"))
        return search.search(docs, search.parsed(search.query_table(spark, [raw])), by).collect()

    return run


def test_wiki_ranker(hits):
    asked = "reporter & license | reporter server"
    assert hits("Reporter guide", "install the license server", "reporter license") == []
    (a,) = hits("Reporter guide", "install the license server", asked)
    assert (a.score, a.matched_terms, a.boolean_match) == (2400, ["reporter", "license"], True)
    (b,) = hits("reporter server", "y", asked)
    assert b.score == 1450
    assert hits("license", "x", asked) == []
    (c,) = hits("a phrase", "a phrase", "A  Phrase")
    assert c.score == 4000
    assert hits("x", "y", "&") == [] and hits("x", "y", "  ") == []


def test_kb_rankers(hits):
    (a,) = hits("Reporter guide", "", "reporter license", search.KB_TITLE)
    assert a.score == 400
    (b,) = hits("Guide", "", "12345 & guide", search.KB_TITLE, "12345")
    assert b.score == 1500
    assert hits("phrase", "", "phrase", search.KB_BODY) == []
    (c,) = hits("x", "the phrase", "phrase", search.KB_BODY)
    assert (c.score, c.title_match, c.body_match) == (1600, False, True)


def test_merge(spark):
    schema = "query_id int, url string, title string, score int, title_match boolean, body_match boolean, snippet string"
    t = spark.createDataFrame([(1, "u", "T", 2200, True, False, "")], schema)
    b = spark.createDataFrame([(1, "u", "B", 1600, False, True, "s"), (1, "v", "B", 1600, False, True, "s")], schema)
    got = {r.url: r for r in search.merge_title_and_body(t, b).collect()}
    assert (got["u"].score, got["u"].title, got["u"].title_match, got["u"].body_match, got["u"].snippet) == (2450, "T", True, True, "s")
    assert got["v"].score == 1600


def test_paging(spark):
    many = spark.range(25).select(F.lit(1).alias("query_id"), "id", F.lit("t").alias("title"), (100 - F.col("id")).alias("score"))
    rows = results.page(many, 9).collect()
    assert sorted(r["rank"] for r in rows) == [21, 22, 23, 24, 25]
    assert {(r.total, r.total_pages, r.page) for r in rows} == {(25, 3, 3)}
    assert results.page(many.where("id < 0"), 1).count() == 0
    assert [r.id for r in results.top(many, 2).orderBy("rank").collect()] == [0, 1]


def test_ranks_are_dense_and_counts_roll_up(spark):
    h = spark.createDataFrame([(1, "a", "t", 5, "wiki"), (1, "b", "t", 5, "kb"), (2, "c", "t", 1, "kb")], "query_id int, id string, title string, score int, source string")
    assert [(r.query_id, r["rank"]) for r in results.ranked(h).orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (2, 1)]
    assert {tuple(r) for r in results.source_counts(h).collect()} == {(1, "wiki", 1), (1, "kb", 1), (1, "all", 2), (2, "kb", 1), (2, "all", 1)}


def test_dedupe(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, "c"), ("m", 1, "x")], "k string, o int, v string")
    assert {tuple(r) for r in dedupe.keep_first(df, "k", F.col("o")).select("k", "v").collect()} == {("k", "a"), ("m", "x")}
    assert {(r.k, r.v, r.first_at) for r in dedupe.keep_last(df, "k", F.col("o")).collect()} == {("k", "c", 1), ("m", "x", 1)}
    listing = spark.createDataFrame([("a", "2024-01-02", 0), ("a", "2024-01-03", 1), ("", "2024-01-09", 2), ("b", "2024-01-01", 3)], "id string, last_edited string, ord int")
    assert {tuple(r) for r in dedupe.first_in_listing(listing).select("id", "last_edited").collect()} == {("a", "2024-01-03"), ("b", "2024-01-01")}
    assert [r.id for r in dedupe.first_in_listing(listing, 1).collect()] == ["a"]


@pytest.fixture
def snapshots(spark):
    items = spark.createDataFrame([("new", "1"), ("same", "1"), ("moved", "2"), ("unknown", "2"), ("dateless", None)], "url string, lastmod string")
    index = spark.createDataFrame([("same", "1", "11"), ("moved", "1", "12"), ("unknown", None, "13"), ("dateless", "1", "14"), ("gone", "1", "15")], "url string, source_lastmod string, article_id string")
    return items, index


def test_change_set(snapshots):
    items, index = snapshots
    got = {(r.url, r.reason, r.article_id) for r in changes.change_set(items, index).collect()}
    assert got == {("new", "new", None), ("moved", "lastmod", None), ("gone", "removed", "15")}
    same = {r.url for r in changes.unchanged(items, index).collect()}
    assert same == {"same", "unknown", "dateless"}
    assert {u for u, *_ in got} | same == {r.url for r in items.collect()} | {r.url for r in index.collect()}


def test_apply_changes(snapshots):
    items, index = snapshots
    none = index.where("false")
    assert sorted(map(tuple, changes.apply_changes(index, none, none).collect())) == sorted(map(tuple, index.collect()))
    plan = changes.change_set(items, index)
    ups = plan.where("reason <> 'removed'").select("url", F.col("lastmod").alias("source_lastmod"), F.lit("9").alias("article_id"))
    once = changes.apply_changes(index, ups, plan.where("reason = 'removed'"))
    twice = changes.apply_changes(once, ups, plan.where("reason = 'removed'"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.url for r in once.collect()} == {r.url for r in items.collect()}


def test_reuse(spark):
    now = F.expr("timestamp '2024-02-01 00:00:00'")
    plan = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), ("c", None, "t"), ("d", None, "u")], "url string, lastmod string, title string")
    old = spark.createDataFrame([(u, "t", "1", d) for u, d in (("a", "2024-01-01"), ("b", "2024-01-31"), ("c", "2024-01-31"), ("d", "2024-01-31"))], "url string, title string, source_lastmod string, day string")
    old = old.withColumn("checked_at", F.to_timestamp("day"))
    assert {r.url for r in changes.reuse(plan, old, now, 30).where("reuse").collect()} == {"b", "c"}
    assert {r.url for r in changes.reuse(plan, old, now, 7, True).where("reuse").collect()} == {"a", "c", "d"}


def test_progress(spark):
    row = spark.range(1).select(changes.progress(F.lit(1), F.lit(3)).alias("a"), changes.progress(F.lit(0), F.lit(0)).alias("b")).first()
    assert tuple(row) == (33.3, 100.0)


def test_sitemaps(spark):
    xml = {
        "root": "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>",
        "a": "<urlset><url><loc> x&amp;y </loc><lastmod>1</lastmod></url><url><loc>z</loc></url></urlset>",
        "b": "<sitemapindex><sitemap><loc>root</loc></sitemap><sitemap><loc>c</loc></sitemap></sitemapindex>",
        "c": "<list><loc>bare</loc><loc>z</loc></list>",
        "none": "",
    }
    maps = spark.createDataFrame(list(xml.items()), "url string, xml string")
    roots = spark.createDataFrame([("none", 1), ("root", 2)], "url string, root_rank int")
    entries = sitemap.parse(maps)
    reached = sitemap.reach(entries, roots)
    assert {(r.root, r.url, r.level) for r in reached.collect()} == {("none", "none", 0), ("root", "root", 0), ("root", "a", 1), ("root", "b", 1), ("root", "c", 2)}
    assert {r.url for r in sitemap.reach(entries, roots, 1).where("root = 'root'").collect()} == {"root", "a", "b"}
    found = sitemap.items(entries, reached)
    assert {(r.url, r.lastmod) for r in found.collect()} == {("x&y", "1"), ("z", None), ("bare", None)}
    assert sitemap.choose_root(found, roots).select("root").distinct().collect()[0].root == "root"
    assert {r.url for r in sitemap.extra_urls(spark, "a, b\n\nb").collect()} == {"a", "b"}


def test_blocks(spark):
    forest = spark.createDataFrame(
        [("p", "A", None, 0, "A"), ("p", "A1", "A", 0, "A1"), ("p", "A1a", "A1", 0, "A1a"), ("p", "B", None, 1, "B"), ("q", "Q", None, 0, "")],
        "page_id string, block_id string, parent_id string, pos int, text string",
    )
    text = lambda **k: {r.page_id: r.text for r in blocks.page_texts(blocks.preorder(forest, **k)).collect()}
    assert text(max_blocks=3) == {"p": "A\nA1\nA1a", "q": ""}
    assert text(max_blocks=3, max_depth=1) == {"p": "A\nA1\nB", "q": ""}


def test_wiki_job(spark):
    from docquarry.jobs import wiki
    from docquarry.sources.tables import BLOCKS, WIKI_PAGES

    raw = spark.createDataFrame(
        [
            ("page", "a-1", None, "2024-01-02", "", None, {"T": ("title", [("Hello", None)])}),
            ("page", "b", "u", "2024-01-01", "named", None, None),
            ("database", "c", "u", "2024-01-01", "x", None, None),
        ],
        WIKI_PAGES,
    )
    forest = spark.createDataFrame(
        [("a-1", "1", None, 0, "paragraph", True, '{"rich_text":[{"plain_text":"one"},{"text":{"content":" two"}}],"caption":[{"plain_text":"cap"}]}'), ("a-1", "2", "1", 0, "equation", False, '{"expression":"x=1"}'), ("a-1", "3", None, 1, "bookmark", False, '{"url":"http://e"}')],
        BLOCKS,
    )
    got = {r.id: r for r in wiki.build(raw, forest).collect()}
    assert set(got) == {"a-1", "b"}
    assert (got["a-1"].title, got["a-1"].text, got["a-1"].text_length) == ("Hello", "one two cap\nx=1\nhttp://e", 24)
    assert (got["b"].title, got["b"].text, got["b"].error) == ("named", "", None)


def test_chunks(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("url"), "id")
    got = chunks.by_position(df.repartition(5), 250, F.col("id")).collect()
    assert all(r.chunk_no == r.id // 250 + 1 for r in got) and len(got) == 1000
    words = spark.createDataFrame([(1, "the license server"), (2, "another text")], "chunk_no int, normal string")
    sketch = chunks.sketches(chunks.token_rows(words))
    assert [r.chunk_no for r in chunks.prune(words, sketch, ["license"]).collect()] == [1]


def test_tables_round_trip(spark, tmp_path):
    from docquarry.sources import tables

    df = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_no int, url string")
    tables.write_chunks(df, str(tmp_path / "c"))
    assert tables.read_chunks(spark, str(tmp_path / "c"), "url string, chunk_no int", 2).count() == 2
    with pytest.raises(ValueError):
        tables.read_chunks(spark, str(tmp_path / "c"), "url string, chunk_no int", 3)
    (tmp_path / "r.json").write_text('{"version": 1, "records": [{"url": "x", "lastmod": null}]}')
    assert tables.read_records(spark, str(tmp_path / "r.json"), tables.ITEMS).first().url == "x"
    (tmp_path / "s.xml").write_text("<urlset><url><loc>a</loc><lastmod>2024-01-01</lastmod></url></urlset>")
    assert tuple(tables.read_sitemap_items(spark, str(tmp_path / "s.xml")).first()) == ("a", "2024-01-01")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.html").write_text("<p>a\nb</p>")
    read = tables.read_html_files(spark, str(tmp_path / "p")).first()
    assert read.url.endswith("1.html") and read.html == "<p>a\nb</p>"
    (tmp_path / "b.json").write_text('{"page_id": "p", "block_id": "1", "pos": 0, "type": "paragraph", "payload": "{}"}\n')
    assert tables.read_blocks(spark, str(tmp_path / "b.json")).first().block_id == "1"
    tables.publish(df, str(tmp_path / "i"), 3, "2024-01-01")
    assert tables.read_published(spark, str(tmp_path / "i"))[1].first().page_count == 2
    tables.publish(df.limit(1), str(tmp_path / "i"), 0, "2024-01-02")
    df.limit(0).write.parquet(str(tmp_path / "i/records/publication=3"))  # begun, without a header
    records, header = tables.read_published(spark, str(tmp_path / "i"))
    assert (records.count(), header.first().page_count, header.first().failed_count) == (1, 1, 0)


def test_stream_refresh(spark, tmp_path):
    from docquarry.sources import snapshots
    from docquarry.streaming import refresh

    page = lambda title: f"<h1>{title}</h1><article>{'word ' * 60}</article>"
    drop = lambda rows, name: spark.createDataFrame(rows, "url string, html string, seen_at timestamp").coalesce(1).write.parquet(str(tmp_path / "drops" / name))
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    args = spark, str(tmp_path / "drops/*"), str(tmp_path / "index"), str(tmp_path / "ck")
    drop([("a", page("A"), day(1)), ("a", page("A2"), day(2)), ("b", page("B"), day(1)), ("c", page("다라마"), day(1))], "1")
    refresh.start(*args).awaitTermination()
    drop([("a", None, day(3)), ("b", page("바"), day(3)), ("d", page("D"), day(3))], "2")
    refresh.start(*args).awaitTermination()
    assert {(r.url, r.title) for r in snapshots.read(spark, str(tmp_path / "index"), refresh.INDEX).collect()} == {("a", "A2"), ("d", "D")}


def test_answers_job(spark):
    from docquarry.jobs import answers

    docs = spark.createDataFrame([("1", "of the title", "body"), ("2", "x", "some of the text"), ("3", "x", "none")], "id string, title string, text string")
    made = search.documents(docs, F.col("id"), F.col("title"), F.col("text"))
    asked = search.parsed(search.query_table(spark, ["of the"]))
    rows = answers.page(made, made, asked).orderBy("rank").collect()
    assert [(r["rank"], r.id, r.source, r.score) for r in rows] == [(1, "1", "wiki", 2400), (2, "1", "kb", 2200), (3, "2", "kb", 1850), (4, "2", "wiki", 1600)]
    assert all(r.snippet for r in rows)


def test_queries_and_documents_meet_in_compatibility_form(hits):
    wide = "".join(chr(0xFF21 + k) for k in range(3))  # full-width ABC
    assert hits(f"{wide} guide", "x", wide)[0].score == hits(f"{wide} guide", "x", "abc")[0].score == 2400
    assert hits("o\ufb03ce", "x", "office") and hits("\uac00", "x", "\u1100\u1161")  # a ligature; Hangul letters
    assert hits(f"{wide} | x", "the", f"{wide} & the")[0].matched_terms == [wide, "the"]


def test_reading_order_of_sitemaps(spark):
    """Two maps list a url with different dates: the one read last counts, however deep it lies."""
    xml = {
        "root": "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>z</loc></sitemap></sitemapindex>",
        "a": "<sitemapindex><sitemap><loc>deep</loc></sitemap></sitemapindex>",
        "deep": "<urlset><url><loc>u</loc><lastmod>deep</lastmod></url><url><loc>v</loc></url></urlset>",
        "z": "<urlset><url><loc>w</loc></url><url><loc>u</loc><lastmod>late</lastmod></url></urlset>",
    }
    entries = sitemap.parse(spark.createDataFrame(list(xml.items()), "url string, xml string"))
    found = sitemap.items(entries, sitemap.reach(entries, spark.createDataFrame([("root",)], "url string")))
    assert [(r.url, r.lastmod) for r in found.orderBy("ord").collect()] == [("u", "late"), ("v", None), ("w", None)]


def test_change_set_without_urls_and_repeated(spark):
    items = spark.createDataFrame([(None, "1"), ("", "1"), ("a", "1"), ("a", "2")], "url string, lastmod string")
    index = spark.createDataFrame([("b", "1", "7"), ("b", "1", "7"), (None, "1", "8")], "url string, source_lastmod string, article_id string")
    assert sorted((r.url, r.lastmod, r.reason) for r in changes.change_set(items, index).collect()) == [("a", "2", "new"), ("b", None, "removed")]


def test_extras_and_candidate_chunks(spark):
    plan = spark.createDataFrame([("a", "1")], "url string, lastmod string")
    extras = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    assert sorted((r.url, r.lastmod) for r in changes.add_extras(plan, extras).collect()) == [("a", "1"), ("b", None)]
    words = spark.createDataFrame([(k, "license") for k in range(5)], "chunk_no int, normal string")
    sketch = chunks.sketches(chunks.token_rows(words))
    assert sorted(r.chunk_no for r in chunks.prune(words, sketch, ["license"], most=2).collect()) == [0, 1]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from docquarry.sources import tables

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda x: None)
    with pytest.raises(ValueError, match="checkpoint"):
        tables.checkpoint_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_extracted_texts_are_composed(spark):
    from docquarry.jobs import kb

    wide = "".join(chr(0xFF21 + k) for k in range(3))
    pages = spark.createDataFrame([("u", f"<h1>{wide}</h1><p>o\ufb03ce</p>"), ("v", None), ("w", "<h1>A</h1>")], "url string, html string")
    got = {r.url: (r.title, r.text) for r in kb.extract(pages).collect()}
    assert got == {"u": ("ABC", "ABC office"), "v": ("", ""), "w": ("A", "A")}
