"""Article URLs: canonical form, ids, and titles out of slugs. Host and path are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

HOST, PATH = "knowledge.example.com", "/external/article"


def canonical(url: Column, host: str = HOST, path: str = PATH, ids: tuple[str, ...] = ("articleId", "articleNumber"), scheme: str | None = None) -> Column:
    """An article's URL without query and fragment, null for other hosts, other paths and invalid URLs.

    Of ``path?articleId=7`` it makes ``path/7``. ``scheme`` fixes the scheme of that form. The host is lower-cased.
    """
    part = lambda *a: F.try_parse_url(url, *[F.lit(x) for x in a])
    own_host, own_path = F.lower(part("HOST")), part("PATH")
    protocol = F.lower(part("PROTOCOL"))
    number = F.coalesce(*[F.nullif(part("QUERY", x), F.lit("")) for x in ids])
    by_path = F.concat(protocol, F.lit("://"), own_host, own_path)
    by_id = F.concat(F.lit(scheme) if scheme else protocol, F.lit("://"), own_host, F.lit(f"{path}/"), number)
    return F.when(own_host == host, F.when(F.startswith(own_path, F.lit(f"{path}/")), by_path).when((own_path == path) & number.rlike(r"\A\d+\z"), by_id))


def article_id(url: Column, path: str = PATH) -> Column:
    """The digits behind the path, empty if there are none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), rf"(?i){path}/(\d+)", 1)


def percent_decoded(text: Column) -> Column:
    """Percent escapes decoded, a plus left as it is; null for broken escapes."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def title_from_slug(slug: Column) -> Column:
    """``how-to_fix.html`` as ``How to fix``; broken escapes stay."""
    name = F.regexp_replace(F.coalesce(percent_decoded(slug), slug), r"(?i)\.html?\z", "")
    words = collapse(F.regexp_replace(name, "[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def title_from_url(url: Column, path: str = PATH, prefix: str = "KB ") -> Column:
    """The slug behind the id as a title, else the prefix and the id; null if the path is no article's."""
    own = F.try_parse_url(url, F.lit("PATH"))
    pattern = rf"(?i)\A{path}/(\d+)(?:/([^/?#]+))?"
    slug = F.regexp_extract(own, pattern, 2)
    return F.when(own.rlike(pattern), F.when(slug != "", title_from_slug(slug)).otherwise(F.concat(F.lit(prefix), F.regexp_extract(own, pattern, 1))))


def record_from_url(url: Column, path: str = PATH) -> Column:
    """struct(article_id, title, url), null where the path is no article's."""
    made = title_from_url(url, path)
    return F.when(made.isNotNull(), F.struct(article_id(url, path).alias("article_id"), made.alias("title"), url.alias("url")))


def decoded_path(url: Column) -> Column:
    """The decoded path, null where the URL or its escapes are broken."""
    return percent_decoded(F.try_parse_url(url, F.lit("PATH")))


def wiki_url(page_id: Column, base: str = "https://wiki.example.com/") -> Column:
    return F.concat(F.lit(base), F.replace(page_id, F.lit("-"), F.lit("")))
