"""Titles and bodies of raw HTML by pattern, so that one projection serves title, sample and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, clean_lines, let, or_empty

#: Fixed: elements left out of bodies, the headings tried for a title, and headings that name the site.
REMOVED = ("script", "style", "noscript", "svg", "header", "footer", "nav")
HEADINGS = ("h1", "h2", "h3")
SITE_NAMES = r"(?i)\A(?:support portal|knowledge base)\z"
BODY_CLASSES = "article|knowledge|content|body"


def element(html: Column, name: str) -> Column:
    """The inside of the first element of this name, empty if there is none."""
    return F.regexp_extract(html, rf"(?i)<{name}[^>]*>([\s\S]*?)</{name}>", 1)


def _unless_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def meta(html: Column, attribute: str, name: str) -> Column:
    return F.regexp_extract(html, rf"""(?i)<meta[^>]+{attribute}=["']{name}["'][^>]+content=["']([^"']+)["']""", 1)


def title(html: Column, meta_name: bool = False, with_nfkc: bool = False) -> Column:
    """The first h1, h2 or h3 with a text that isn't the site's name, else og:title, else <title>.

    ``meta_name``: also try <meta name=title>, and cut the site's name off the end of <title>.
    """
    source = or_empty(html)
    tried = []
    usable = lambda x: F.when(~x.rlike(SITE_NAMES), _unless_empty(x))
    for name in HEADINGS:
        found = clean(element(source, name), with_nfkc)
        tried.append(usable(found) if with_nfkc else let(found, usable))
    last = element(source, "title")
    if meta_name:
        last = F.regexp_replace(last, r"(?i)\s+-\s+Support Portal[\s\S]*\z", "")
    named = [_unless_empty(meta(source, "property", "og:title"))]
    named += [_unless_empty(meta(source, "name", "title"))] * meta_name
    return F.coalesce(*tried, clean(F.coalesce(*named, last), with_nfkc))


def without_chrome(html: Column) -> Column:
    source = or_empty(html)
    for name in REMOVED:
        source = F.regexp_replace(source, rf"(?i)<{name}[\s\S]*?</{name}>", " ")
    return source


def body(html: Column, at_least: int = 200, most: int | None = None, keep_lines: bool = False, with_nfkc: bool = False) -> Column:
    """The text of the first article, main, or div classed as content with ``at_least`` characters, else of the page."""
    cleaned = clean_lines if keep_lines else (lambda x: clean(x, with_nfkc))
    classed = rf"""(?i)<div[^>]+class=["'][^"']*(?:{BODY_CLASSES})[^"']*["'][^>]*>([\s\S]*?)</div>"""
    candidates = (lambda s: element(s, "article"), lambda s: element(s, "main"), lambda s: F.regexp_extract(s, classed, 1))
    long_enough = lambda x: F.when(F.length(x) >= at_least, x)
    if with_nfkc:  # a Python function can't stand within a lambda
        source = without_chrome(html)
        found = F.coalesce(*[long_enough(cleaned(c(source))) for c in candidates], cleaned(source))
    else:
        found = let(without_chrome(html), lambda s: F.coalesce(*[let(cleaned(c(s)), long_enough) for c in candidates], cleaned(s)))
    return F.substring(found, 1, most) if most else found


def article(html: Column, fallback_title: Column, fallback_id: Column, most: int = 4000) -> Column:
    """struct(title, text): the extracted title, else the given one, else one made of the id; the cut body."""
    made = F.concat(F.lit("KB "), fallback_id)
    return F.struct(F.coalesce(_unless_empty(title(html)), _unless_empty(fallback_title), made).alias("title"), body(html, most=most).alias("text"))
