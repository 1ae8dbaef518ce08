"""Ranked lexical search of a stated set of queries by sort-based accumulation.

The documents become an index of the queries' terms. It is dealt by range of doc_id, and each range scores all queries for itself: the arrays
of (query, document, impact) of all matched terms are put one behind the other, their packed keys sorted by radix, and impacts of equal keys summed.
A heap for each query keeps the best of the range, so that only those meet the other ranges' best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, shuffle_partitions
from .lexicon import LETTERS_DIGITS, as_strings, slices, terms

#: Distinct (query, term) pairs that one pass over the documents takes; more queries take more passes.
PASS = 1_000_000
#: Impacts that are sorted at once.
STEP = 2_000_000
#: A null doc_id comes behind all others of the same score.
LAST = 2**63 - 1


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times) with the terms of each query; rows of one key are one query, those without a term drop out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = terms(batch.column("text"), LETTERS_DIGITS)
                codes, distinct = words.codes()
                row = np.repeat(np.arange(len(batch)), np.diff(words.docs))
                pair, times = np.unique(row * max(1, len(distinct)) + codes, return_counts=True)
                at, code = np.divmod(pair, max(1, len(distinct)))
                yield pa.record_batch([batch.column("item").take(pa.array(at)), as_strings(distinct).take(pa.array(code)), pa.array(times.astype(np.int64))], ["item", "term", "times"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, f"item {kind}, term string, times long")
    return rows.groupBy("item", "term").agg(F.sum("times").alias("times"))


def term_index(docs: DataFrame, wanted: list[str], text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row with a term: its number of terms, and which of ``wanted`` (by place) it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for whole in batches:
            for batch in slices(whole, "text"):
                words = terms(batch.column("text"), LETTERS_DIGITS)
                codes, distinct = words.codes()
                place = pc.index_in(as_strings(distinct), known).fill_null(-1).to_numpy()[codes]
                sizes = np.diff(words.docs)
                doc = np.repeat(np.arange(len(batch)), sizes)[place >= 0]
                pair, times = np.unique(doc * max(1, len(known)) + place[place >= 0], return_counts=True)
                at, term = np.divmod(pair, max(1, len(known)))
                ends = pa.array(np.searchsorted(at, np.arange(len(batch) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term.astype(np.int32), times.astype(np.int64))]
                yield pa.record_batch([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(sizes > 0))

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return held.mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<long>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of whole numbers from 0, by their digits of 16 bits from the lowest up; equal keys keep theirs."""
    order, top, shift = np.arange(len(keys)), int(keys.max()) if len(keys) else 0, 0
    while top >> shift:
        digit = ((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # for 16 bits this is numpy's radix sort
        shift += 16
    return order


def accumulate(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's impacts. Not for empty arrays."""
    order = radix_order(keys)
    keys, impacts = keys[order], impacts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(impacts, first)


class Best:
    """The ``k`` best (score, smaller doc_id first) of each query so far, each in a heap with the worst on top."""

    def __init__(self, k: int) -> None:
        self.k, self.heaps = k, {}

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps.setdefault(item, [])
        if len(heap) == self.k:  # most can't enter
            fits = scores >= heap[0][0]
            scores, ids = scores[fits], ids[fits]
        if len(scores) > self.k:  # nor can those below the k-th of their own
            fits = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[fits], ids[fits]
        for one in zip(scores.tolist(), (-ids).tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            elif one > heap[0]:
                heapq.heapreplace(heap, one)


def _searched(docs: DataFrame, asked: list[tuple], k: int, text: str) -> DataFrame:
    """(item place, doc_id, score): the k best of each range of documents for each query of (place, term, times)."""
    spark = docs.sparkSession
    wanted = sorted({t for _, t, _ in asked})
    number = {t: i for i, t in enumerate(wanted)}
    index = cut(term_index(docs, wanted, text))
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = frequency.select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")).where("w > 0")
    weight = np.zeros(len(wanted), np.int64)
    for r in weighed.collect():  # one row for each term of the queries at most
        weight[r.term] = r.w
    # by term: which queries have it, and its weight times its repeats in the query
    pairs = np.array([(number[t], i, times * weight[number[t]]) for i, t, times in asked if weight[number[t]] > 0], np.int64).reshape(-1, 3)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    shared = spark.sparkContext.broadcast((pairs[:, 1].copy(), pairs[:, 2].copy(), np.searchsorted(pairs[:, 0], np.arange(len(wanted) + 1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, points, at = shared.value
        best = Best(k)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            row = np.repeat(np.arange(len(batch)), batch.column("terms").value_lengths().to_numpy())
            term, tf = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            m = 25 + (75 * batch.column("n").to_numpy() * n_docs) // max(1, n_terms)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            matched = at[term + 1] - at[term]  # queries that each posting matches
            # documents in blocks, so that a block's matches have a bounded number; a document with more is a block of its own
            upto = np.cumsum(np.bincount(row, matched, len(batch)).astype(np.int64))
            edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(upto // STEP)) + 1, [len(batch)]]))
            bounds = np.searchsorted(row, edges)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                times = matched[a:b]
                if not times.sum():
                    continue
                one = np.repeat(np.arange(a, b), times)  # postings as often as queries match them
                place = np.repeat(at[term[a:b]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(one))
                key = (items[place].astype(np.uint64) << np.uint64(32)) | row[one].astype(np.uint64)
                key, total = accumulate(key, points[place] * impact[one])
                item, doc = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
                for x, y in zip(starts, [*starts[1:], len(item)], strict=True):
                    some = total[x:y] > 0
                    best.offer(int(item[x]), total[x:y][some], ids[doc[x:y]][some])
        rows = [(i, -d, s) for i, heap in best.heaps.items() for s, d in heap]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([None if r[1] == LAST else r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    # the hash tells rows of one doc_id apart, so that a repeated id has several ranges
    ranged = index.repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("n", "terms", "tfs"))
    return ranged.mapInArrow(score, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "item_id", per_pass: int = PASS) -> DataFrame:
    """(key, rank, doc_id, score): the ``k`` documents with the highest score above 0 for each query, equal scores by doc_id, null last.

    Terms are runs of letters and digits with A-Z lower-cased; the score is that of the contract: rare terms weigh more, repeats in a long text count
    less. ``items`` (key, text) are a stated set of queries, in passes of about ``per_pass`` distinct (query, term) pairs; every row of ``docs`` is held against all of them.
    Rows of one key are one query; null and empty queries, and a query's terms that no document has, find nothing. Each row of ``docs`` is a document, also where
    it repeats a doc_id; null and empty texts are never found. Extra columns are left out.
    """
    asked = cut(query_terms(items, key, text))
    sizes = asked.groupBy("item").agg(F.count("*").alias("n"))
    passes = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // per_pass))
    kind, found = items.schema[key].dataType.simpleString(), []
    for part in range(passes):
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == part)
        rows = mine.collect()
        names = list(dict.fromkeys(r["item"] for r in rows))
        place = {x: i for i, x in enumerate(names)}
        best = _searched(docs, [(place[r["item"]], r.term, r.times) for r in rows], k, text)
        named = docs.sparkSession.createDataFrame(list(enumerate(names)), f"item long, name {kind}")
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        found.append(best.join(F.broadcast(named), "item").select(F.col("name").alias(key), "rank", "doc_id", "score"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
