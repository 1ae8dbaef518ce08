"""Search queries: clean-up, Boolean groups, modes; and what is shown of a hit."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let, normalize_space, or_empty, tokens, trim, truncate


def cleaned(raw: Column) -> Column:
    return collapse(raw)


def has_operators(raw: Column) -> Column:
    return or_empty(raw).rlike("[&|]")


def groups(raw: Column) -> Column:
    """array<array<string>>: alternatives of terms that all have to match; empty terms and alternatives drop out."""
    some = lambda parts, sep: F.filter(F.transform(F.split(parts, sep), trim), lambda x: x != "")
    return F.filter(F.transform(F.split(trim(or_empty(raw)), r"\|"), lambda o: some(o, "&")), lambda g: F.size(g) > 0)


def mode(raw: Column) -> Column:
    both, either = F.contains(raw, F.lit("&")), F.contains(raw, F.lit("|"))
    return F.when(both & either, "AND·OR").when(both, "AND").when(either, "OR").otherwise("plain")


def around(text: Column, at: Column, needle: int | Column, before: int, after: int) -> Column:
    """The text from ``before`` the position to ``after`` behind the needle, with dots where it is cut."""

    def cut(span: Column) -> Column:
        dots = lambda when: F.when(when, "…").otherwise("")
        return F.concat(dots(span["a"] > 0), F.substring(text, span["a"] + 1, span["b"] - span["a"]), dots(span["b"] < F.length(text)))

    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(text), at + F.greatest(needle, F.lit(1)) + after)
    return let(F.struct(start.alias("a"), end.alias("b")), cut)


def snippet(source: Column, query: Column, words: bool, before: int, after: int, fallback) -> Column:
    """The text around the query, else with ``words`` around its first word that occurs, else ``fallback(text)``.

    ``source`` is evaluated once, and so are its lower case and the position of the hit.
    """
    q = F.lower(normalize_space(query))

    def shown(text: Column) -> Column:
        def placed(low: Column) -> Column:
            at = F.when(q != "", F.instr(low, q)).otherwise(0)
            if words:
                first = F.get(F.filter(F.transform(tokens(q), lambda t: F.instr(low, t)), lambda i: i > 0), F.lit(0))
                at = F.when(at > 0, at).otherwise(F.coalesce(first, F.lit(0)))
            return at

        return let(let(F.lower(text), placed), lambda at: F.when(at > 0, around(text, at - 1, F.length(q), before, after)).otherwise(fallback(text)))

    return let(source, shown)


def wiki_snippet(text: Column, query: Column) -> Column:
    """Around the query, else around its first word that occurs, else the first 220 characters."""
    return snippet(normalize_space(text), query, True, 80, 180, lambda t: truncate(t, 220))


def body_snippet(text: Column, query: Column) -> Column:
    return snippet(collapse(text), query, False, 100, 180, lambda t: F.substring(t, 1, 260))


def title_snippet(text: Column, query: Column) -> Column:
    return snippet(collapse(text), query, False, 110, 110, lambda t: F.substring(t, 1, 220))


def first_term_snippet(text: Column, terms: list[Column]) -> Column:
    """Around the first term that gives a snippet."""
    return F.coalesce(*[F.nullif(wiki_snippet(text, t), F.lit("")) for t in terms], F.lit(""))


def highlight(text: Column, query: str, mark: tuple[str, str] = ("**", "**"), split_operators: bool = False) -> Column:
    """The query and its words marked, longest first and whatever their case. ``query`` is known on the driver."""
    whole = re.sub(r"\s+", " ", query).strip()
    parts = re.split(r"[&|]", whole) if split_operators and re.search("[&|]", whole) else [whole, *whole.lower().split(" ")]
    wanted = sorted({p.strip() for p in parts if len(p.strip()) >= 2}, key=lambda p: (-len(p), p))
    if not wanted:
        return text
    either = "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p) for p in wanted)
    return F.regexp_replace(text, f"(?i)({either})", mark[0].replace("$", r"\$") + "$1" + mark[1].replace("$", r"\$"))
