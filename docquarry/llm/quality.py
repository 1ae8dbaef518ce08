"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a boolean column that is true where it rejects. A document is kept when no
rule rejects it, so the order of the rules changes the cost and never the verdict. The
order is chosen on a bounded sample: each rule's time and rejection rate are measured there
and the rules run by rejections per second. They are nested in ``when``, and what a rule reads of the text is
computed within its own branch, so that a rejected document skips the features of the dearer rules.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, let, own_columns, words

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    min_words: int = 20
    window: int = 8
    max_repeat_pct: int = 30
    max_symbol_pct: int = 30  #: symbols per hundred words
    max_dup_line_pct: int = 50  #: repeated lines per hundred lines
    max_upper_pct: int = 50  #: A-Z per hundred code points of words
    min_word_len: float = 2.0
    max_word_len: float = 15.0
    min_distinct_pct: int = 5  #: distinct words per hundred of ...
    distinct_of: int = 1_000  #: ... the words, at most so many


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(ws: Column, window: int) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more in the array.

    Windows are compared by a 64-bit hash, made of their words' hashes. Texts without a repeated window stop after the
    distinct count; others sort (hash, start) pairs, keep the starts of equal neighbours and
    add up the stretches which these windows cover.
    """

    def joined(a: Column, b: Column, apart: int) -> Column:
        """Hashes of windows that begin in ``a`` and go on in ``b``, ``apart`` words later."""
        n = F.greatest(F.lit(0), F.size(b) - apart)
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(apart + 1), n), lambda x, y: F.xxhash64(x, y))

    def hashes(powers: Column, size: int, whole: Column | None, done: int, then) -> Column:
        """``then`` of the window hashes: windows of doubled size by turns, joined as the binary digits of ``window`` say."""
        if window & size:
            whole, done = (powers if whole is None else joined(whole, powers, done)), done + size
        if size * 2 > window:
            return let(whole, then)
        return let(joined(powers, powers, size), lambda p: let(whole, lambda x: hashes(p, size * 2, x, done, then)) if whole is not None else hashes(p, size * 2, None, done, then))

    def same(pairs: Column, p: Column, k: Column) -> Column:
        return F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))

    def repeated_starts(pairs: Column) -> Column:
        marked = F.transform(pairs, lambda p, k: F.when(same(pairs, p, k - 1) | same(pairs, p, k + 1), p["i"]))
        return F.sort_array(F.array_compact(marked))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        dear = let(pairs, lambda p: let(repeated_starts(p), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(dear)

    return let(F.transform(ws, lambda x: F.xxhash64(x)), lambda h: hashes(h, 1, None, 0, count))


def features(t: Column, ws: Column, limits: Limits = Limits()) -> dict[str, Column]:
    """What the rules read, as expressions of a text without null and its words; all long."""
    lines = F.split(t, "\n", -1)
    wordy = F.filter(lines, lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    found = {
        "n_words": F.size(ws),
        "word_chars": _length_without(t, _SPACES),
        "n_symbols": F.length(t) - _length_without(t, SYMBOLS),
        "n_dup_lines": let(wordy, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(ws, limits.window),
        "n_lines": F.size(lines),
        "n_upper": F.length(t) - _length_without(t, _UPPER),
        "n_distinct": F.size(F.array_distinct(ws)),
    }
    return {k: x.cast("long") for k, x in found.items()}


#: Features that judge() returns; the others are computed only where a rule asks for them.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_rule(limits: Limits = Limits()) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words"))


def rules(f: dict[str, Column], limits: Limits = Limits()) -> dict[str, Column]:
    """Name -> true where the rule rejects, over features()."""
    n = f["n_words"]
    return {
        "few_words": n < limits.min_words,
        "repetition": 100 * f["n_repeat_words"] > limits.max_repeat_pct * n,
        "symbols": 100 * f["n_symbols"] > limits.max_symbol_pct * n,
        "repeated_lines": 100 * f["n_dup_lines"] > limits.max_dup_line_pct * f["n_lines"],
        "shouting": 100 * f["n_upper"] > limits.max_upper_pct * f["word_chars"],
        "word_length": (f["word_chars"] < limits.min_word_len * n) | (f["word_chars"] > limits.max_word_len * n),
        "few_distinct": 100 * f["n_distinct"] < limits.min_distinct_pct * F.least(n, F.lit(limits.distinct_of)),
    }


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def order_rules(docs: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = 500) -> list[str]:
    """Rule names by rejections per second, most first, measured on at most ``sample_rows`` documents, chosen by a hash of their text.

    Each rule runs alone over the sample with what it reads of the text, twice; the time of reading the sample is taken off. An empty sample
    keeps the listed order.
    """
    one_in = max(1, docs.count() // (2 * sample_rows))
    sample = docs.select(_text(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(one_in)) == 0).limit(sample_rows)
    sample = cut(sample)

    def timed(rejects: Column) -> tuple[int, int, float]:
        told, took = sample.agg(F.count("*"), F.count_if(rejects)), []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            n, rejected = told.first()
            took.append(time.perf_counter() - began)
        return n, rejected, min(took)

    def alone(name: str) -> Column:
        return let(words(F.col("t")), lambda w: rules(features(F.col("t"), w, limits), limits)[name])

    names = list(rules(features(F.col("t"), words(F.col("t"))), limits))
    n, _, reading = timed(F.length("t") < 0)
    if not n:
        return names
    worth = {}
    for name in names:
        _, rejected, took = timed(alone(name))
        worth[name] = rejected / n / max(took - reading, 1e-3)
    return sorted(worth, key=lambda k: -worth[k])


def cascade(order: list[str], f: dict[str, Column], limits: Limits = Limits()) -> Column:
    """True where no rule rejects; a rule and what it reads are evaluated only where those before it did not reject."""
    verdict, all_rules = F.lit(True), rules(f, limits)
    for name in reversed(order):
        verdict = F.when(F.coalesce(all_rules[name], F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = 500) -> DataFrame:
    """``docs`` with the features of SHOWN, ``base_failed`` and ``kept``; one row out for each row in.

    Null and empty texts have no words and fail. Repeated rows are judged alike. Extra columns pass through; those named like
    a result are replaced. An empty table gives no rows.
    """
    order = order_rules(docs, text, limits, sample_rows)
    mine = docs.select(own_columns(docs).alias("own"), _text(text).alias("t")).withColumn("ws", words(F.col("t")))
    found = features(F.col("t"), F.col("ws"), limits)
    shown = mine.withColumns({k: found[k] for k in SHOWN})
    kept = cascade(order, found | {k: F.col(k) for k in SHOWN}, limits)
    results = [*SHOWN, base_rule(limits).alias("base_failed"), kept.alias("kept")]
    columns = [F.col(f"own.`{c}`").alias(c) for c in docs.columns if c not in (*SHOWN, "base_failed", "kept")]
    return shown.select(*columns, *results)


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = 500) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns, whatever their names.

    The filter is one expression: the words of a text are bound once, and each rule's other features stand in its own branch.
    """
    order = order_rules(docs, text, limits, sample_rows)
    t = _text(text)
    return docs.where(let(words(t), lambda w: cascade(order, features(t, w, limits), limits)))
