from pyspark.sql import functions as F

from docquarry.functions import html, language, query, text, urls


def test_normal_forms(one):
    wide = "".join(chr(c) for c in (0xFF21, 0xFF22, 0xFF23))
    assert one(text.normalize_for_search, f"  {wide}  x\n\n\n\ny ") == "abc x\n\ny"
    assert one(text.normalize_for_search, None) == ""
    assert one(lambda c: text.tokens(c), "a bb bb ccc") == ["bb", "ccc"]
    assert one(text.collapse, "　a   b\n c﻿") == "a b c"
    assert one(text.index_tokens, "x license. a-b 日本 license.") == ["license.", "a-b"]


def test_entities_and_cleaning(one):
    assert one(text.decode_entities, "&amp;lt;") == "<"
    assert one(text.clean, "<p>a&nbsp;&amp; b</p>\n<i>c</i>") == "a & b c"
    assert one(text.clean_lines, "a<br>b<p>c</p>d") == "a\nb c\nd"
    assert one(lambda c: text.truncate(c, 20), "x" * 30) == "xxxxxxxx …(생략)"
    assert one(text.escape_markdown, "a_b[c]") == r"a\_b\[c\]"
    assert one(text.escape_html, "<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"


def test_titles(one):
    assert one(html.title, "<h1>Support Portal</h1><h2>Fix <b>it</b></h2>") == "Fix it"
    assert one(html.title, '<meta property="og:title" content="Og"><title>T</title>') == "Og"
    assert one(html.title, "<title>T &amp; U</title>") == "T & U"
    assert one(html.title, None) == ""
    assert one(lambda c: html.title(c, meta_name=True), "<title>Fix it - Support Portal x</title>") == "Fix it"


def test_bodies(one):
    short, long = "<article>short</article>", "<main>" + "long " * 50 + "</main>"
    assert one(html.body, short + long) == ("long " * 50).strip()
    assert one(html.body, "<nav>n</nav>" + short) == "short"
    assert one(html.body, "<script>x</script>y<style>z") == "y z"
    assert len(one(lambda c: html.body(c, most=10), long)) == 10


def test_article(one):
    got = one(lambda c: html.article(c, F.lit(""), F.lit("7")), "<p>text</p>")
    assert (got.title, got.text) == ("KB 7", "text")


def test_gate(one):
    page = lambda title, body, by: one(lambda t, b, u: language.is_latin_page(t, b, u, by), title, body, "https://x.example/a")
    assert not page("A", "x" * 99 + "가" * 12, language.TITLE)
    assert page("A", "x" * 99 + "가" * 4, language.TITLE)
    five = "x" * 15 + "д" * 5
    assert not page("A", five, language.TITLE)
    assert page("A", five, language.BODY)
    assert not page("", "text", language.TITLE) and page("", "text", language.BODY)
    assert not page("a%20b", "text", language.TITLE)
    assert page("1", "", language.TITLE)


def test_gate_urls(one):
    assert not one(lambda u: language.is_latin_url(u), "https://x.example/%EA%B0%80")
    assert one(lambda u: language.is_latin_url(u), "https://x.example/a+b")
    assert not one(lambda u: language.is_latin_url(u), "https://x.example/%zz")
    assert one(lambda u: language.is_latin_url(u, True), "https://x.example/%zz")


def test_urls(one):
    base = "https://knowledge.example.com/external/article"
    assert one(urls.canonical, f"{base}?articleId=7&x=1#f") == f"{base}/7"
    assert one(urls.canonical, f"{base}?articleNumber=8") == f"{base}/8"
    assert one(urls.canonical, f"{base}/9/slug?x=1#f") == f"{base}/9/slug"
    assert one(urls.canonical, f"{base}?articleId=x") is None
    assert one(urls.canonical, "https://other.example/external/article/7") is None
    assert one(urls.canonical, "no url") is None
    assert one(urls.article_id, f"{base}/9/slug") == "9"
    assert one(urls.title_from_url, f"{base}/9/how-to_fix%20it.html") == "How to fix it"
    assert one(urls.title_from_url, f"{base}/9") == "KB 9"
    assert one(urls.title_from_url, "https://x.example/") is None
    assert one(urls.wiki_url, "a-b-c").endswith("/abc")


def test_query_parsing(one):
    assert one(query.groups, "a & b | c &") == [["a", "b"], ["c"]]
    assert one(query.groups, "&") == []
    assert one(query.mode, "a&b|c") == "AND·OR"
    assert one(query.mode, "a b") == "plain"


def test_snippets(one):
    long = "x" * 200 + " needle " + "y" * 300
    got = one(lambda c: query.wiki_snippet(c, F.lit("needle")), long)
    assert got.startswith("…") and got.endswith("…") and "needle" in got and len(got) == 2 + 80 + 6 + 180
    assert one(lambda c: query.wiki_snippet(c, F.lit("absent needle")), long).count("needle") == 1
    assert len(one(lambda c: query.wiki_snippet(c, F.lit("absent")), "z" * 300)) == 208 + len(" …(생략)")
    assert len(one(lambda c: query.body_snippet(c, F.lit("absent")), "z" * 300)) == 260
    assert one(lambda c: query.first_term_snippet(c, [F.lit("b")]), "a b") == "a b"


def test_highlight(one):
    assert one(lambda c: query.highlight(c, "of the"), "Of the end of") == "**Of the** end **of**"
    assert one(lambda c: query.highlight(c, "aa & b.b", ("<mark>", "</mark>"), True), "aa b.b bxb") == "<mark>aa</mark> <mark>b.b</mark> bxb"


def test_dates(spark):
    at = F.expr("timestamp '2024-01-01 15:04:05'")
    row = spark.range(1).select(text.local_time(at).alias("a"), text.short_time(at).alias("b"), text.local_time(F.lit(None).cast("timestamp")).alias("c"), text.short_time(F.lit(None).cast("timestamp")).alias("d"), text.date_value(F.lit("nonsense")).alias("e")).first()
    assert tuple(row) == ("2024. 01. 02. 오전 12:04:05", "01.02 00:04", "", "-", 0)
