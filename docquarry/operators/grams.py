"""Exact pruning of substring search: an inverted index of 3-grams by block of documents.

Documents are dealt to blocks, and stored in a folder for each block. A posting says that a block has a gram in some document. A term of three characters or more, which has no line feed, can
only stand in blocks that have all its grams, so a query becomes an intersection of postings for each alternative and a union of these; what is left is verified
against the texts with the same condition as search(). Nothing is lost: an alternative without such a term keeps all blocks.
A gram is its three code points in one number, so there are no collisions. Postings are dealt to slots by gram; a few queries read the slots of their grams alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.sources.tables import written

from . import results, search

#: Folders of postings.
SLOTS = 64
#: (query, block) pairs up to this number are broadcast to the documents, which reads only their blocks; more are joined by block.
BROADCAST_PAIRS = 200_000


#: A number that no code point has, between texts.
BETWEEN = 0x1FFFFF


def grams_of(*texts: str) -> np.ndarray:
    """The distinct 3-grams of some texts; none spans two of them."""
    between = BETWEEN.to_bytes(4, "little")
    points = np.frombuffer(between.join(x.encode("utf-32-le", "surrogatepass") for x in texts), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    if len(texts) > 1:
        apart = points != BETWEEN
        grams = grams[apart[:-2] & apart[1:-1] & apart[2:]]
    return np.unique(grams)


#: Where a gram stands in some document of a block, as bits of a posting.
TITLE, BODY, ID = 1, 2, 4


#: Characters of texts whose grams are made at once; they take some tens of bytes each.
AT_ONCE = 1_000_000


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, parts), once for each run of rows of one block: documents are stored by block, so that is nearly once for each file."""
    now, waiting, n = None, {TITLE: [], BODY: [], ID: []}, 0
    found = {bit: np.zeros(0, np.int64) for bit in waiting}

    def add():
        nonlocal n
        for bit, texts in waiting.items():
            found[bit] = np.union1d(found[bit], grams_of(*texts))
            texts.clear()
        n = 0

    def told():
        add()
        grams = np.unique(np.concatenate(list(found.values())))
        parts = np.zeros(len(grams), np.int32)
        for bit, some in found.items():
            parts[np.searchsorted(grams, some)] |= bit
            found[bit] = some[:0]
        return pa.record_batch([pa.array(grams), pa.array(np.full(len(grams), now if now is not None else 0), pa.int32()), pa.array(parts)], ["gram", "block", "parts"])

    for batch in batches:
        for block, *texts in zip(*(batch.column(c).to_pylist() for c in ("block", "title_norm", "body_norm", "article_id")), strict=True):
            if block != now:
                yield told()
                now = block
            for bit, text in zip(waiting, texts, strict=True):
                for at in range(0, len(text or ""), AT_ONCE):  # long texts in pieces that share two characters
                    waiting[bit].append(text[at : at + AT_ONCE + 2])
                    n += len(waiting[bit][-1])
                    if n >= AT_ONCE:
                        add()
    yield told()


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def store(docs: DataFrame, path: str, blocks: int) -> None:
    """Write documents() to ``path``/docs in ``blocks`` folders by hash of id, and their postings to ``path``/grams by slot.

    A block of some thousand documents is one file of some ten MB; fewer documents to a block prune more and cost more postings.
    whole_norm is left to load(), so that a text is moved and kept in two forms rather than three.
    """
    placed = docs.drop("whole_norm").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    placed.repartition("block").write.mode("overwrite").partitionBy("block").option("compression", "zstd").parquet(f"{path}/docs")
    kept = docs.sparkSession.read.parquet(f"{path}/docs").select("title_norm", "body_norm", F.lower("article_id").alias("article_id"), "block")
    pairs = kept.mapInArrow(_block_grams, "gram long, block int, parts int").groupBy("gram", "block").agg(F.bit_or("parts").alias("parts")).withColumn("slot", _slot(F.col("gram")))
    pairs.repartition("slot").sortWithinPartitions("slot", "gram", "block").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/grams")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with block, postings)."""
    return spark.read.parquet(f"{path}/docs").withColumn("whole_norm", search.whole_norm()), spark.read.parquet(f"{path}/grams")


def _grams(terms: pd.Series) -> pd.Series:
    return terms.map(grams_of)


def asked_terms(queries: DataFrame, by: search.Ranker = search.WIKI) -> DataFrame:
    """(query_id, has_ops, alt, place, grams, in_title, in_body): the terms of each alternative of a query, their grams, and the points for one in a title and in a body.

    A document answers a query only if it has all terms of an alternative: those of a Boolean group, or the phrase, or one of its words where the ranker takes words.
    """
    group = lambda terms, title, body: F.struct(terms.alias("terms"), F.lit(title).alias("in_title"), F.lit(body).alias("in_body"))
    phrase = F.array(group(F.array("q"), by.phrase_title, by.phrase_body))
    if by.token_title:
        phrase = F.concat(phrase, F.transform("words", lambda w: group(F.array(w), by.token_title, by.token_body)))
    groups = F.when(F.col("has_ops"), F.transform("norms", lambda g: group(g, by.term_title + by.per_term, by.term_body + by.per_term))).otherwise(phrase)
    listed = queries.select("query_id", "has_ops", F.posexplode(groups).alias("alt", "g"))
    terms = listed.select("query_id", "has_ops", "alt", F.posexplode("g.terms").alias("place", "term"), "g.in_title", "g.in_body")
    return terms.withColumn("grams", F.pandas_udf(_grams, "array<long>")("term")).drop("term")


def candidates(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, block, bound): the blocks that have all grams of an alternative, and what a document in it may score at most. ``asked``: asked_terms(), small.

    Alternatives without a gram are left out; see open_queries().
    """
    wanted = asked.select("query_id", "has_ops", "alt", "place", "in_title", "in_body", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    wanted = written(wanted.withColumn("slot", _slot(F.col("gram"))))
    # what short terms may add, and how many others there are
    alts = asked.groupBy("query_id", "alt").agg(F.sum(F.when(F.size("grams") == 0, F.col("in_title") + F.col("in_body")).otherwise(0)).alias("free"), F.count_if(F.size("grams") > 0).alias("terms"))
    found = postings.join(F.broadcast(wanted.where("slot >= 0")), ["slot", "gram"])
    within = lambda part: F.count_if(F.col("parts").bitwiseAND(part) > 0) == F.col("n")
    terms = found.groupBy("query_id", "has_ops", "alt", "place", "in_title", "in_body", "n", "block").agg(F.count("*").alias("k"), within(TITLE).alias("t"), within(BODY).alias("b")).where("k = n")
    points = F.when(F.col("t"), F.col("in_title")).otherwise(0) + F.when(F.col("b"), F.col("in_body")).otherwise(0)
    # a term that only the id has still counts as a term
    groups = terms.groupBy("query_id", "has_ops", "alt", "block").agg(F.count("*").alias("k"), F.sum(F.when(F.col("t") | F.col("b"), points).otherwise(F.col("in_body"))).alias("points"))
    groups = groups.join(F.broadcast(alts), ["query_id", "alt"]).where(F.col("k") == F.col("terms"))
    # one Boolean alternative counts; a phrase, or else its words together
    total = F.col("points") + F.col("free")
    return groups.groupBy("query_id", "block").agg(F.when(F.any_value("has_ops"), F.max(total)).otherwise(F.sum(total)).alias("bound"))


def open_queries(asked: DataFrame) -> DataFrame:
    """(query_id): queries with an alternative that could stand anywhere, since it has no term of three characters."""
    return asked.groupBy("query_id", "alt").agg(F.max(F.size("grams")).alias("most")).where("most = 0").select("query_id").distinct()


def _read(docs: DataFrame, pairs: DataFrame, queries: DataFrame, by: search.Ranker) -> DataFrame:
    """Hits within (query_id, block) pairs."""
    pairs = written(pairs.select("query_id", "block").join(F.broadcast(queries), "query_id"))
    few = pairs.count() <= BROADCAST_PAIRS
    # folders are pruned by the other side of a join only if that side has a filter and is the same plan for both, so a written table
    pairs = pairs.where("block >= 0")
    return search.scored(docs.join(F.broadcast(pairs) if few else pairs, "block"), by)


def pruned_search(index: tuple[DataFrame, DataFrame], queries: DataFrame, by: search.Ranker = search.WIKI) -> DataFrame:
    """The rows of search() over the stored documents, read from the blocks that may have them."""
    docs, postings = index
    found = []
    for some in search.in_blocks(queries):
        some = written(some)
        asked = written(asked_terms(some, by))
        free = written(open_queries(asked))
        closed = asked.join(F.broadcast(free), "query_id", "left_anti")
        found.append(_read(docs, candidates(postings, closed), some, by))
        if not free.isEmpty():
            found.append(search.search(docs, some.join(F.broadcast(free), "query_id", "left_semi"), by))
    return reduce(DataFrame.unionByName, found)


def top(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, by: search.Ranker = search.WIKI, first: int = 8, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the k best hits of each query with rank, (query_id, candidates, scored)): the same as of all hits, from fewer blocks.

    The ``first`` blocks of each query with the highest bounds are scored; of the others only those whose bound reaches the k-th score found there. Queries
    that have no grams are searched whole and aren't counted. ``order`` begins with the score.
    """
    docs, postings = index
    best, counted = [], []
    for some in search.in_blocks(queries):
        some = written(some)
        asked = written(asked_terms(some, by))
        free = written(open_queries(asked))
        closed = asked.join(F.broadcast(free), "query_id", "left_anti")
        pairs = written(candidates(postings, closed).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))))
        early = written(results.top(_read(docs, pairs.where(F.col("place") <= first), some, by), k, order).drop("rank"))
        reached = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        late = written(pairs.where(F.col("place") > first).join(F.broadcast(reached), "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0))))
        found = early.unionByName(_read(docs, late, some, by))
        if not free.isEmpty():
            found = found.unionByName(search.search(docs, some.join(F.broadcast(free), "query_id", "left_semi"), by))
        best.append(results.top(found, k, order))
        more = late.groupBy("query_id").agg(F.count("*").alias("more"))
        counted.append(pairs.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("place") <= first).alias("n")).join(more, "query_id", "left").select("query_id", "candidates", (F.col("n") + F.coalesce("more", F.lit(0))).alias("scored")))
    return reduce(DataFrame.unionByName, best), reduce(DataFrame.unionByName, counted)
