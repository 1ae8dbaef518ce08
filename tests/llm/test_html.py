"""What of odd markup a page shows, how its tables are aligned, and that no nesting takes long."""

import time

import pytest

from docquarry.llm.html_text import visible_text as v


def test_comments_and_what_is_no_tag():
    assert v("<!-->visible<p>text") == "visible\n\ntext" and v("<!--->a") == "a" and v("<!-- x --!>a<!-- > -->b") == "ab" and v("a<!-- x") == "a"
    assert v("a</>b</3 x>c") == "abc" and v("a </ b>c") == "a c" and v("1 < 2 <3") == "1 < 2 <3" and v("a</") == "a</"
    assert v("<script><!-- <script>x</script> y --></script>shown") == "shown" and v("<script>if (a<!--b) </script>x") == "x" and v("<script>x") == ""


def test_stray_end_tags_of_paragraphs():
    assert v("<p>one<div>two</div>three</p>four") == "one\n\ntwo\nthree\n\nfour"
    assert v("a</p>b") == "a\n\nb" and v("a</div>b") == "ab" and v("<p>a</p></p>b") == "a\n\nb"


def test_visibility():
    assert v("<div style='visibility:hidden'>a<p style='visibility:visible'>b<i>c</i></p>d</div>e") == "bc\n\ne"
    assert v("<div style='display:none'>a<p style='display:block;visibility:visible'>b</div>c") == "c"
    assert v("<p hidden style='display:block'>a</p><p hidden>b</p><p style='visibility:hidden'><b>c</b></p>d") == "a\n\nd"
    assert v("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>") == "- b"
    assert v("<dialog>a</dialog><dialog open>b</dialog>") == "b" and v("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>") == "ab"
    assert v("<details>x<summary>s</summary>y<p>z</details>w") == "s\nw" and v("<details open><summary>s</summary>y</details>") == "s\ny"


def test_cells_begin_at_their_columns():
    wide = "".join(f"<td>{c * 30}" for c in "abc")
    assert v(f"<table><tr>{wide}<td>x<tr><td colspan=3>s<td>y</table>").split("\n")[1].index("y") == 96
    assert v(f"<table><tr>{wide.replace('<td>', '<td rowspan=2>')}<td>x<tr><td>y</table>").split("\n")[1].index("y") == 96
    long = "z" * 100
    assert v(f"<table><tr><td>{long}<td>x<tr><td>a<td>y</table>") == f"{long}  x\na  y"


@pytest.mark.parametrize(
    "source",
    [
        "<p><button>" + "<b><div>x" * 100_000, "<div>" * 200_000, "<table><tr><td>" * 70_000, "<ul><li>" * 100_000, "</p>" * 250_000, "<p>" * 330_000, "<table>" + "<tr><td rowspan=0>a" * 50_000,
        "<table><tr>" + "<td colspan=1000 rowspan=0>" * 100 + "<tr><td>x" * 100_000, "<script><!--" * 80_000, "<" * 1_000_000, "<a b='" * 150_000, "<!--" * 250_000, "<svg><text>" * 90_000, "<a></b>" * 140_000,
    ],
)
def test_a_megabyte_of_any_nesting(source):
    began = time.process_time()
    v(source)
    assert time.process_time() - began < 10
