"""URL filters: rules by host and path, and for the other URLs a naive Bayes over the words of host and path.

Host names are put together from words. A unigram model of the pages' own words splits each distinct run of letters of a host by Viterbi; the
model is looked up by a join of the run's substrings, so that no vocabulary is broadcast. The classifier learns from the URLs that a rule decides.
Logarithms are rounded to millionths before they are added, so that no order of additions changes a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, lower_ascii
from .components import small
from .lexicon import LETTER_RUN, counted_terms

#: (verdict, host and start of path): what a rule says of its host and all subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Millionths.
UNIT = 1_000_000
#: Letters of the longest word that the unigram model knows; longer runs are put together from shorter words.
LONGEST = 20


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty for null and without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A stated list of rules, tried from the longest down; of equal rules the first counts."""
    fits = []
    for rule, verdict in sorted({r: v for v, r in reversed(rules)}.items(), key=lambda x: -len(x[0])):
        name, slash, rest = rule.partition("/")
        here = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(here, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _scaled_log(x: Column) -> Column:
    return F.floor(UNIT * F.log(x)).cast("long")


def segment(run: str, costs: dict[str, int], first: int, more: int, longest: int = LONGEST) -> list[str]:
    """The cheapest split of ``run`` into words: ``costs`` are those of known words, an unknown word costs ``first`` and ``more`` for each letter beyond one.

    Of equally cheap splits, that with fewer words, then that whose last word is known, then that whose last word is the shortest.
    """
    n = len(run)
    best: list[tuple[int, int]] = [(0, 0)] + [(0, 0)] * n  # (cost, words) of the first i letters
    unknown: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # the same if an unknown word ends there, and its letters
    back = [0] * (n + 1)
    for i in range(1, n + 1):
        fresh = (best[i - 1][0] + first, best[i - 1][1] + 1, 1)
        longer = (unknown[i - 1][0] + more, unknown[i - 1][1], unknown[i - 1][2] + 1) if i > 1 else fresh
        unknown[i] = min(fresh, longer)
        options = [(best[i - k][0] + costs[w], best[i - k][1] + 1, 0, k) for k in range(1, min(i, longest) + 1) if (w := run[i - k : i]) in costs]
        cost, words, _, k = min([*options, (unknown[i][0], unknown[i][1], 1, unknown[i][2])])
        best[i], back[i] = (cost, words), i - k
    out, i = [], n
    while i:
        out.append(run[back[i] : i])
        i = back[i]
    return out[::-1]


def host_words(hosts: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(host, words): the runs of letters of each host (distinct, in a column host), split by the unigram model of ``words`` (term, n).

    A word costs ln(N / n), N the occurrences of all words; an unknown one of k letters ln(N) + (k - 1) ln(10). Words of over ``longest`` letters are unknown.
    Hosts without a letter have no words.
    """
    words = cut(words)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    costs = words.where(F.length("term") <= longest).select(F.col("term").alias("sub"), _scaled_log(total / F.col("n")).alias("cost"))
    placed = cut(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(f"({LETTER_RUN})"))).alias("pos", "run")))
    runs = cut(placed.select("run").distinct().withColumn("id", F.monotonically_increasing_id()))

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        subs: list[str] = []
        for batch in batches:
            for i, run in zip(batch.column("id").to_pylist(), batch.column("run").to_pylist(), strict=True):
                own = {run[a:b] for a in range(len(run)) for b in range(a + 1, min(a + longest, len(run)) + 1)}
                ids += [i] * len(own)
                subs += own
                if len(subs) > 100_000:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(subs, pa.string())], ["id", "sub"])
                    ids, subs = [], []
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(subs, pa.string())], ["id", "sub"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("run", "found", "first", "more"))
            out = [segment(run, {x["sub"]: x["cost"] for x in found or []}, first, more, longest) for run, found, first, more in zip(*columns, strict=True)]
            yield pa.record_batch([batch.column("run"), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    found = runs.mapInArrow(substrings, "id long, sub string").join(small(costs), "sub").groupBy("id").agg(F.collect_list(F.struct("sub", "cost")).alias("found"))
    known = runs.join(found, "id", "left").select("run", "found", _scaled_log(F.lit(float(total))).alias("first"), _scaled_log(F.lit(10.0)).alias("more"))
    split_runs = known.mapInArrow(split, "run string, words array<string>")
    by_host = placed.join(split_runs, "run").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.join(by_host, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def token_weights(ruled: DataFrame) -> tuple[DataFrame, int, int]:
    """(token, weight) of multinomial naive Bayes with one added to each count, the weight of tokens never seen, and that of the classes.

    ``ruled``: tokens, verdict (allow or block). Weights are in UNITs; above 0 they speak for block.
    """
    block = F.col("verdict") == "block"
    counts = cut(ruled.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if(block).alias("b"), F.count_if(~block).alias("a")))
    b, a, v = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    weight = lambda x, y: _scaled_log((x + 1.0) / F.lit(float(max(1, b + v)))) - _scaled_log((y + 1.0) / F.lit(float(max(1, a + v))))
    one = ruled.agg(F.count_if(block).alias("b"), F.count_if(~block).alias("a")).select(weight(F.lit(0), F.lit(0)), _scaled_log(F.col("b") + 1.0) - _scaled_log(F.col("a") + 1.0)).first()
    return counts.select("token", weight(F.col("b"), F.col("a")).alias("weight")), *one


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", html: str = "html", longest: int = LONGEST) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score), one row for each row of ``pages``.

    The longest rule that fits a URL decides; where none does, rule is null and the URL is blocked if its ``score`` is above 0. ``score`` (millionths of
    a natural logarithm; null where a rule decides) compares block with allow by the ``words`` of the host and the runs of letters of the path, learnt from all
    URLs that a rule decides; without any, all scores are 0. The words' model counts the text of ``html`` between tags, over all rows. Null URLs and those without :// have neither host nor path
    and are judged by the share of the classes alone. Repeated rows are judged alike; extra columns are left out.
    """
    u = F.col(url)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    rows = cut(rows.select("row", "page_id", "host", "path", "by.rule", "by.verdict"))
    text = pages.select(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^<>]*>", " ").alias("text"))
    hosts = host_words(rows.select("host").distinct(), counted_terms(text, "text"), longest)
    paths = F.regexp_extract_all(lower_ascii(F.col("path")), F.lit(f"({LETTER_RUN})"))
    told = cut(rows.join(small(cut(hosts)), "host").withColumn("tokens", F.concat("words", paths)))

    weights, unseen, prior = token_weights(told.where("verdict is not null").select("tokens", "verdict"))
    asked = told.where("verdict is null").select("row", F.explode("tokens").alias("token"))
    sums = asked.join(small(cut(weights)), "token", "left").groupBy("row").agg(F.sum(F.coalesce("weight", F.lit(unseen))).alias("sum"))
    scored = told.join(sums, "row", "left").withColumn("score", F.when(F.col("verdict").isNull(), F.coalesce("sum", F.lit(0)) + prior))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.array_join("words", " ").alias("words"), "score")
