"""Phrase and Boolean search of a table of queries over a table of documents, with additive scores.

Documents are normalized once (index time) and stay where they are: the queries, a stated set, are broadcast in blocks
of a checked size and each document is held against each query in one map-only pass. Long texts are read once for all
queries of a block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import query as Q
from docquarry.functions.text import normalize_for_search, normalize_space, or_empty, tokens

#: Queries that one pass takes.
BLOCK = 1_000
QUERY_SCHEMA = "query_id int, raw string"


@dataclass(frozen=True)
class Ranker:
    """Points of a ranker; see the presets."""

    phrase_title: int
    phrase_body: int
    term_title: int
    term_body: int
    per_term: int
    title_only_phrase: bool = True  #: whether a phrase in the title alone is a hit
    with_id: bool = False  #: whether Boolean terms may match the article id
    token_title: int = 0  #: without a phrase, words of the query count for title, else body
    token_body: int = 0
    flags: str = "by hit"  #: or "body": bodyMatch always, titleMatch never


#: Fixed points of the three live rankers.
WIKI = Ranker(2400, 1600, 1200, 700, 250)
KB_TITLE = Ranker(2200, 1200, 900, 450, 300, with_id=True, token_title=400, token_body=150)
KB_BODY = Ranker(0, 1600, 500, 900, 300, title_only_phrase=False, flags="body")


def whole_norm() -> Column:
    """Title and body in normal form as one text."""
    return F.concat_ws("\n", "title_norm", "body_norm")


def documents(df: DataFrame, doc_id: Column, title: Column, text: Column, article_id: Column | None = None, with_nfkc: bool = True) -> DataFrame:
    """(id, title, text, article_id, title_norm, body_norm, whole_norm): the searchable form, made at index time."""
    base = df.select(doc_id.alias("id"), or_empty(title).alias("title"), or_empty(text).alias("text"), (article_id if article_id is not None else F.lit("")).alias("article_id"))
    base = base.withColumns({"title_norm": normalize_for_search(F.col("title"), with_nfkc), "body_norm": normalize_for_search(F.col("text"), with_nfkc)})
    return base.withColumn("whole_norm", whole_norm())


def parsed(queries: DataFrame, with_nfkc: bool = True, lines: bool = False) -> DataFrame:
    """(query_id, raw, q, has_ops, groups, norms, words) of (query_id, raw); queries that are empty after clean-up drop out.

    Operators are those written in the query; its terms get the normal form of the documents, NFKC included.
    ``lines``: line feeds within a query stay and are looked for, where clean-up makes them spaces otherwise.
    """
    clean = queries.select("query_id", (normalize_space if lines else Q.cleaned)(F.col("raw")).alias("raw")).where("raw <> ''")
    clean = clean.withColumns({"q": normalize_for_search(F.col("raw"), with_nfkc), "has_ops": Q.has_operators(F.col("raw")), "groups": Q.groups(F.col("raw"))})
    # a Python function can't stand within a lambda: terms are rows for it
    terms = clean.select("query_id", F.posexplode("groups").alias("g", "terms")).select("query_id", "g", F.posexplode("terms").alias("t", "term"))
    terms = terms.select("query_id", "g", "t", normalize_for_search(F.col("term"), with_nfkc).alias("term"))
    in_order = lambda name: F.transform(F.sort_array(F.collect_list(F.struct(*name))), lambda x: x[name[-1]])
    terms = terms.groupBy("query_id", "g").agg(in_order(("t", "term")).alias("norm")).groupBy(F.col("query_id").alias("_id")).agg(in_order(("g", "norm")).alias("norms"))
    out = clean.join(terms, F.col("query_id") == F.col("_id"), "left").drop("_id")
    return out.select("query_id", "raw", "q", "has_ops", "groups", F.coalesce("norms", F.array().cast("array<array<string>>")).alias("norms"), tokens(F.col("q")).alias("words"))


def query_table(spark: SparkSession, raw: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(raw, 1)), QUERY_SCHEMA)


def _holds(text: str, term: Column) -> Column:
    return F.contains(F.col(text), term)


def _points(terms: Column, text: str, each: int) -> Column:
    return F.size(F.filter(terms, lambda t: _holds(text, t))) * each


def _whole(by: Ranker) -> str:
    return "whole_id" if by.with_id else "whole_norm"


def matches(by: Ranker) -> Column:
    """Whether a document answers a query: the join's condition."""
    boolean = F.exists("norms", lambda g: F.forall(g, lambda t: _holds(_whole(by), t)))
    phrase = _holds("body_norm", F.col("q"))
    if by.title_only_phrase:
        phrase = phrase | _holds("title_norm", F.col("q"))
    if by.token_title:
        phrase = phrase | F.exists("words", lambda t: _holds("title_norm", t) | _holds("body_norm", t))
    return F.when(F.col("has_ops"), boolean).otherwise(phrase)


def _scored(hits: DataFrame, by: Ranker) -> DataFrame:
    pairs = F.arrays_zip(F.col("groups").alias("raw"), F.col("norms").alias("norm"))
    won = F.get(F.filter(pairs, lambda g: F.forall(g["norm"], lambda t: _holds(_whole(by), t))), F.lit(0))
    hits = hits.withColumn("_won", F.when(F.col("has_ops"), won))
    terms = F.col("_won.norm")
    in_title, in_body = _holds("title_norm", F.col("q")), _holds("body_norm", F.col("q"))
    boolean = _points(terms, "title_norm", by.term_title) + _points(terms, "body_norm", by.term_body) + F.size(terms) * by.per_term
    phrase = F.when(in_title, by.phrase_title).otherwise(0) + F.when(in_body, by.phrase_body).otherwise(0)
    word_title = F.filter("words", lambda t: _holds("title_norm", t))
    word_body = F.filter("words", lambda t: ~_holds("title_norm", t) & _holds("body_norm", t))
    by_words = ~F.col("has_ops") & ~in_title & ~in_body if by.token_title else F.lit(False)
    score = F.when(F.col("has_ops"), boolean).when(by_words, F.size(word_title) * by.token_title + F.size(word_body) * by.token_body).otherwise(phrase)
    title_hit = F.when(F.col("has_ops"), F.exists(terms, lambda t: _holds("title_norm", t))).when(by_words, F.size(word_title) > 0).otherwise(in_title)
    body_hit = F.when(F.col("has_ops"), F.exists(terms, lambda t: _holds("body_norm", t))).when(by_words, F.size(word_body) > 0).otherwise(in_body)
    if by.flags == "body":
        title_hit, body_hit = F.lit(False), F.lit(True)
    return hits.withColumns(
        {
            "score": score.cast("int"),
            "title_match": title_hit,
            "body_match": body_hit,
            "matched_terms": F.when(F.col("has_ops"), F.col("_won.raw")).otherwise(F.array("raw")),
            "boolean_match": F.col("has_ops"),
        }
    )


HIT = ["query_id", "id", "title", "score", "title_match", "body_match", "matched_terms", "boolean_match", "article_id"]


def search(docs: DataFrame, queries: DataFrame, by: Ranker = WIKI) -> DataFrame:
    """All hits of all queries: one row for each (query, document) that match.

    ``docs`` as documents() makes them, ``queries`` as parsed(). More than BLOCK queries run in several passes.
    """
    docs = _with_id(docs, by)
    found = [_scored(docs.join(F.broadcast(b), matches(by)), by).select(*HIT) for b in in_blocks(queries)]
    return reduce(DataFrame.unionByName, found)


def _with_id(docs: DataFrame, by: Ranker) -> DataFrame:
    return docs.withColumn("whole_id", F.concat_ws("\n", "whole_norm", F.lower("article_id"))) if by.with_id else docs


def scored(pairs: DataFrame, by: Ranker = WIKI) -> DataFrame:
    """Hits among ``pairs``, rows of a document and a query beside each other."""
    return _scored(_with_id(pairs, by).where(matches(by)), by).select(*HIT)


def in_blocks(queries: DataFrame) -> list[DataFrame]:
    """``queries`` in parts of about BLOCK rows at most, each small enough for a broadcast."""
    n = queries.count()
    parts = -(-n // BLOCK) * 2
    return [queries] if n <= BLOCK else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def old_boolean(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The earlier Boolean ranker: title 700, body 350, 400 for each of several terms, 100 for each matching alternative."""
    condition = F.exists("norms", lambda g: F.forall(g, lambda t: _holds("whole_norm", t)))
    hits = reduce(DataFrame.unionByName, [docs.join(F.broadcast(b), condition) for b in in_blocks(queries.where("has_ops"))])
    ok = F.filter("norms", lambda g: F.forall(g, lambda t: _holds("whole_norm", t)))
    terms = F.get(ok, F.lit(0))
    score = _points(terms, "title_norm", 700) + _points(terms, "body_norm", 350) + F.when(F.size(terms) > 1, 400 * F.size(terms)).otherwise(0) + 100 * F.size(ok)
    return hits.select("query_id", "id", "title", score.cast("int").alias("score"))


def token_ranker(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The earlier ranker by words: phrase 1500 and 800, words 250 and 80, all words 500 and 350."""
    in_title, in_body = _holds("title_norm", F.col("q")), _holds("body_norm", F.col("q"))
    any_word = F.exists("words", lambda t: _holds("whole_norm", t))
    hits = reduce(DataFrame.unionByName, [docs.join(F.broadcast(b), in_title | in_body | any_word) for b in in_blocks(queries)])
    t, b, n = F.size(F.filter("words", lambda x: _holds("title_norm", x))), F.size(F.filter("words", lambda x: _holds("body_norm", x))), F.size("words")
    all_of = lambda k, points: F.when((n > 1) & (k == n), points).otherwise(0)
    score = F.when(in_title, 1500).otherwise(0) + F.when(in_body, 800).otherwise(0) + 250 * t + 80 * b + all_of(t, 500) + all_of(b, 350)
    return hits.select("query_id", "id", "title", score.cast("int").alias("score"))


def merge_title_and_body(title_hits: DataFrame, body_hits: DataFrame, bonus: int = 250) -> DataFrame:
    """Hits of both indexes by (query_id, url): where both have one, the higher score and ``bonus``; the title side's fields.

    Inputs: query_id, url, title, score, title_match, body_match, snippet.
    """
    t, b = title_hits.alias("t"), body_hits.alias("b")
    both = F.col("t.url").isNotNull() & F.col("b.url").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")).alias(c)
    return t.join(b, (F.col("t.query_id") == F.col("b.query_id")) & (F.col("t.url") == F.col("b.url")), "full_outer").select(
        pick("query_id"),
        pick("url"),
        pick("title"),
        F.when(both, F.greatest("t.score", "b.score") + bonus).otherwise(F.coalesce("t.score", "b.score")).alias("score"),
        pick("title_match"),
        F.when(both, F.col("t.body_match") | F.col("b.body_match")).otherwise(F.coalesce("t.body_match", "b.body_match")).alias("body_match"),
        F.when(both, F.coalesce(F.nullif("b.snippet", F.lit("")), F.col("t.snippet"))).otherwise(F.coalesce("t.snippet", "b.snippet")).alias("snippet"),
    )
