"""A gate that keeps pages in Latin script. It counts scripts and knows no languages."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, language_text, let, or_empty, start
from .urls import decoded_path

#: Fixed: Kana, CJK, Hangul and Cyrillic.
LOCALIZED = r"[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af\u0400-\u04ff]"


@dataclass(frozen=True)
class Preset:
    """How the counts decide. Localized letters reject at (number, share of all letters)."""

    sample: int | None = None  #: how many characters are read of a text; all of them by default
    drop_urls: bool = True
    drop_hex: bool = False
    reject: tuple[tuple[int, float], ...] = ((12, 0.08), (5, 0.20))
    least_latin: tuple[int, float] | None = (80, 0.85)
    count_title: bool = True
    empty_title: bool = False  #: whether a page without a title passes
    valid_url: bool = False  #: whether an invalid URL rejects

    def first(self, sample: int | None) -> Preset:
        """The same over the first characters of a text."""
        return replace(self, sample=sample)


#: Fixed thresholds of the three uses.
TITLE = Preset()
BODY = Preset(drop_urls=False, reject=((12, 0.08),), count_title=False, empty_title=True)
LEGACY = Preset(drop_hex=True, valid_url=True)
#: Of a stored record, the text is cut first and then what is read with its title.
RECORD, RECORD_READ = Preset(sample=6000), LEGACY.first(8000)


def has_localized(text: Column) -> Column:
    return or_empty(text).rlike(LOCALIZED)


def _count(text: Column, letters: str) -> Column:
    """How many characters of a class there are, by what is left without their runs: regexp_count would make a string of each."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{letters}+", ""))


def latin_dominant(text: Column, by: Preset = TITLE) -> Column:
    """Whether a text without letters, or one with few enough localized letters, passes."""
    t = or_empty(text)
    if by.drop_urls:
        t = F.regexp_replace(t, r"https?://\S+", " ")
    if by.drop_hex:
        t = F.regexp_replace(t, r"\b[A-Fa-f0-9]{16,}\b", " ")
    t = start(t, by.sample)

    def decide(counts: Column) -> Column:
        latin, localized = counts["latin"], counts["localized"]
        letters, bad = latin + localized, F.lit(False)
        for number, share in by.reject:
            bad = bad | ((localized >= number) & (localized >= share * letters))
        if by.least_latin:
            number, share = by.least_latin
            bad = bad | ((letters >= number) & (latin < share * letters))
        return (letters == 0) | ~bad

    counted = lambda x: F.struct(_count(x, "[A-Za-z]").alias("latin"), _count(x, LOCALIZED).alias("localized"))
    return let(t, lambda x: let(counted(x), decide))


def is_latin_title(title: Column, empty_passes: bool = False) -> Column:
    """A title without percent escapes and localized letters."""
    return let(clean(title), lambda t: ((t != "") | F.lit(empty_passes)) & ~t.rlike("%[0-9A-Fa-f]{2}") & ~has_localized(t))


def is_latin_url(url: Column, invalid_passes: bool = False) -> Column:
    """A URL whose decoded path has no localized letter."""
    return F.coalesce(~has_localized(decoded_path(url)), F.lit(invalid_passes)) & (decoded_path(url).isNotNull() | F.lit(invalid_passes))


def is_latin_page(title: Column, text: Column, url: Column, by: Preset = TITLE) -> Column:
    """The gate over a page's title, body and URL."""
    body = start(or_empty(text), by.sample)
    read = F.concat_ws("\n", clean(title), body) if by.count_title else body
    return is_latin_title(title, by.empty_title) & is_latin_url(url, not by.valid_url) & latin_dominant(read, by)


def is_latin_record(title: Column, text: Column) -> Column:
    """The gate over a stored record: its title, and what it begins with."""
    read = F.concat_ws("\n", language_text(title), start(language_text(text), RECORD.sample))
    return is_latin_title(title) & latin_dominant(read, RECORD_READ)
