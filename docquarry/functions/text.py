"""Text clean-up and normal forms. All are Column -> Column; nfkc() is the only one that leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the white space that trimming and collapsing know, beyond Java's own class.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Every run of white space that isn't one space: single spaces, which are most, need no replacement.
_RUNS = rf"{SPACE}{{2,}}|[{SPACE[1:-1]}&&[^ ]]"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def one_space(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, _RUNS, " ")


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return trim(one_space(or_empty(text)))


def normalize_space(text: Column) -> Column:
    """No-break spaces and tabs to single spaces, three or more line feeds to two, trimmed; single line feeds stay."""
    one = F.replace(F.replace(or_empty(text), F.lit("\u00a0"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return trim(F.regexp_replace(F.regexp_replace(one, " {2,}", " "), r"\n{3,}", "\n\n"))


#: Blocks of which the letters that NFKC leaves alone, whatever stands beside them, are known to the JVM: Latin, Greek, Cyrillic, punctuation, Kana, CJK, Hangul.
_BLOCKS = ((0x80, 0x24F), (0x370, 0x4FF), (0x2010, 0x2027), (0x20A0, 0x20BF), (0x3000, 0x303F), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _changed() -> str:
    """A pattern for the characters that NFKC may change: those outside the blocks, those it replaces, and marks, which may compose with what stands before them."""
    kept = [c for a, b in _BLOCKS for c in range(a, b + 1) if unicodedata.normalize("NFKC", chr(c)) == chr(c) and unicodedata.category(chr(c))[0] not in "MC"]
    starts = [c for i, c in enumerate(kept) if not i or kept[i - 1] != c - 1]
    ends = [c for i, c in enumerate(kept) if i + 1 == len(kept) or kept[i + 1] != c + 1]
    spans = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))
    return rf"[\x{{80}}-\x{{10ffff}}&&[^{spans}]]"


#: ASCII fails the first half, so it costs one comparison.
CHANGED = _changed()


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfkc(text: Column, made_of: Column | None = None) -> Column:
    """Unicode's compatibility composition, over Arrow batches. Texts without a character that it may change stay within the JVM; ``made_of`` is what ``text`` is computed from, if cheaper to look at."""
    source = text if made_of is None else made_of
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when((F.octet_length(source) != F.length(source)) & source.rlike(CHANGED), text)), text)


def normalize_for_search(text: Column, with_nfkc: bool = True) -> Column:
    """normalize_space, then NFKC, then lower case. Without NFKC it stays within the JVM."""
    spaced = normalize_space(text)
    return F.lower(nfkc(spaced, or_empty(text)) if with_nfkc else spaced)


def tokens(normal: Column, min_length: int = 2) -> Column:
    """Distinct words of a normalized text with at least ``min_length`` characters, in order."""
    return F.array_distinct(F.filter(F.split(normal, f"{SPACE}+"), lambda x: F.length(x) >= min_length))


def index_tokens(normal: Column, most: int | None = None) -> Column:
    """Distinct tokens of a-z, 0-9 and ._+- with 2 to 64 characters of a normalized text; ``most``: among so many first ones."""
    found = F.filter(F.split(normal, "[^a-z0-9._+-]+"), lambda x: F.length(x).between(2, 64))
    return F.array_distinct(F.slice(found, 1, most) if most else found)


#: Fixed: the six entities, in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))


def decode_entities(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.regexp_replace(text, f"(?i){entity}", character)
    return text


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def clean(text: Column, with_nfkc: bool = False) -> Column:
    """Tags to spaces, white space to single spaces, entities decoded, trimmed."""
    out = decode_entities(one_space(strip_tags(or_empty(text))))
    return trim(nfkc(out, or_empty(text)) if with_nfkc else out)


def clean_lines(text: Column) -> Column:
    """Line breaks, paragraphs and list items end lines; other tags become spaces; entities decoded."""
    broken = F.regexp_replace(or_empty(text), r"(?i)<br\s*/?>|</p>|</li>", "\n")
    spaced = F.regexp_replace(F.regexp_replace(strip_tags(broken), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trim(decode_entities(spaced))


def language_text(text: Column, with_nfkc: bool = False) -> Column:
    """Entities decoded, white space collapsed: what the language gate reads."""
    out = decode_entities(or_empty(text))
    return collapse(nfkc(out, or_empty(text)) if with_nfkc else out)


def start(text: Column, most: int | None) -> Column:
    """The first ``most`` characters; None: all."""
    return text if most is None else F.substring(text, 1, most)


def prefix(text: Column, most: int) -> Column:
    """Collapsed and cut to ``most`` characters: the stored excerpt of a body."""
    return F.substring(collapse(text), 1, most)


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters; a cut text ends in a note."""
    t = or_empty(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 12), F.lit(" …(생략)")))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(or_empty(text), r"([\\`*_\[\]()])", r"\\$1")


def escape_html(text: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(low)), F.lit(high))


def date_value(text: Column) -> Column:
    """Milliseconds since 1970, 0 for what is no time."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0))


def local_time(ts: Column, zone: str = "Asia/Seoul") -> Column:
    """Date and time of day by the twelve-hour clock; empty for null."""
    at = F.from_utc_timestamp(ts, zone)
    half = F.when(F.hour(at) < 12, "오전").otherwise("오후")
    return F.coalesce(F.concat(F.date_format(at, "yyyy. MM. dd. "), half, F.date_format(at, " hh:mm:ss")), F.lit(""))


def short_time(ts: Column, zone: str = "Asia/Seoul") -> Column:
    """Month, day and minute; a dash for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "MM.dd HH:mm"), F.lit("-"))


def web_time(ts: Column, zone: str = "Asia/Seoul") -> Column:
    """Date and minute by the twelve-hour clock; a dash for null."""
    at = F.from_utc_timestamp(ts, zone)
    half = F.when(F.hour(at) < 12, "오전").otherwise("오후")
    return F.coalesce(F.concat(F.date_format(at, "yyyy. MM. dd. "), half, F.date_format(at, " hh:mm")), F.lit("-"))
