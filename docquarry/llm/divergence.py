"""How sources differ from each other and from their language, by the terms they use.

Terms with the same counts in the same sources have the same shares everywhere, and rare terms mostly share their counts. So terms of a
language are grouped by their sparse vector of (source, count); every pair of sources is evaluated once for each distinct vector,
and the result multiplied by the number of terms that have it. Ranks of terms come from the same vectors, each with its first terms only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut
from .components import small
from .lexicon import counted_terms

#: Shares are whole numbers out of this.
SCALE = 1_000_000_000
#: Shares that one block of vectors may hold.
BLOCK = 2_000_000


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly; decimals take over where 64 bits wouldn't hold the product."""
    below = total + 2 * kept
    exact = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.when(count < 9_000_000_000, F.call_function("div", (F.least(count, F.lit(9_000_000_000)) + 2) * SCALE, below)).otherwise(F.call_function("div", exact, below.cast("decimal(20,0)")))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, min_docs: int, text: str) -> DataFrame:
    """(lang, term, cells, total): the terms in at least ``min_docs`` rows of their language; cells: (source, n) of the sources that have it, by source."""
    counts = counted_terms(docs, text, ("lang", "source"))
    whole = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return whole.where(F.col("docs") >= min_docs).drop("docs")


def distinct_vectors(kept: DataFrame, ranks: int) -> DataFrame:
    """(lang, cells, total, n_terms, first): each distinct vector with the number of its terms and the first ``ranks`` of them."""
    first = kept.withColumn("_k", F.row_number().over(W.partitionBy("lang", "cells").orderBy("term"))).where(F.col("_k") <= ranks)
    first = first.groupBy("lang", "cells").agg(F.sort_array(F.collect_list("term")).alias("first"))
    many = kept.groupBy("lang", "cells").agg(F.first("total").alias("total"), F.count("*").alias("n_terms"))
    return many.join(first, ["lang", "cells"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) for places a < b in the language's list of sources: the sum over a block of vectors."""
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(coded.dictionary):
            rows = batch.filter(pc.equal(coded.indices, code))
            width = len(rows.column("shares")[0])
            step = max(1, BLOCK // max(1, width))
            for block in (rows.slice(i, step) for i in range(0, len(rows), step)):
                p = block.column("shares").flatten().to_numpy().reshape(len(block), width).T.copy()
                times = block.column("n_terms").to_numpy()
                for a in range(width - 1):
                    d = p[a + 1 :] - p[a]
                    value = (d * d // (p[a + 1 :] + p[a])) @ times
                    yield pa.record_batch([pa.array([lang.as_py()] * len(value), pa.string()), pa.array(np.full(len(value), a, np.int32)), pa.array(np.arange(a + 1, width, dtype=np.int32)), pa.array(value)], ["lang", "a", "b", "value"])


def audit(docs: DataFrame, min_docs: int = 10, ranks: int = 10, text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of each language differs.

    Part pair: item is another source of the language and value the sum of (p - q)^2 div (p + q) over the language's kept terms; all ranks.
    Part term: item is a term that the source has, with p above the language's q, and value its difference; up to ``ranks``.
    Kept terms stand in at least ``min_docs`` rows of the language; shares p and q are smoothed (see share()). Nulls in text, lang and source count
    as ''; each row is a document, repeated or not. A language without kept terms gives pairs of value 0, a single source no pair, an empty table
    no row. Extra columns are left out. A row of the work holds one number for each source of a language, and the result a row for each pair of them.
    """
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text)
    kept = cut(kept_terms(named, min_docs, text))
    used = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("used"))
    groups = named.select("lang", "source").distinct().join(used, ["lang", "source"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_used"))
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "used"))).alias("sources")).join(size, "lang", "left")
    listed = cut(listed.select("lang", "sources", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_used", F.lit(0)).alias("lang_used")))

    vectors = distinct_vectors(kept, ranks).join(small(listed), "lang")
    n = lambda s: F.coalesce(F.element_at(F.map_from_entries("cells"), s["source"]), F.lit(0))
    vectors = cut(
        vectors.select(
            "lang", "cells", "n_terms", "first", F.transform("sources", lambda s: share(n(s), s["used"], F.col("kept"))).alias("shares"),
            F.transform("sources", lambda s: s["source"]).alias("names"), share(F.col("total"), F.col("lang_used"), F.col("kept")).alias("q"),
        )
    )

    sums = vectors.select("lang", "n_terms", "shares").mapInArrow(_pair_sums, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    places = listed.select("lang", F.posexplode("sources").alias("a", "s")).select("lang", "a", F.col("s.source").alias("source"))
    pairs = places.join(places.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), "lang").where("a <> b")
    pairs = pairs.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(sums.withColumnsRenamed({"a": "low", "b": "high"}), ["lang", "low", "high"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    has = vectors.select("lang", "first", "q", F.explode(F.arrays_zip("names", "shares")).alias("x"), F.transform("cells", lambda c: c["source"]).alias("in"))
    above = has.where((F.col("x.shares") > F.col("q")) & F.array_contains("in", F.col("x.names")))
    above = above.select("lang", F.col("x.names").alias("source"), "first", difference(F.col("x.shares"), F.col("q")).alias("value"))
    group = W.partitionBy("lang", "source")
    # a vector behind `ranks` others has no term that counts: each of those has a first term before all of its own
    best = above.withColumn("_k", F.row_number().over(group.orderBy(F.desc("value"), F.col("first")[0]))).where(F.col("_k") <= ranks)
    terms = best.select("lang", "source", F.lit("term").alias("part"), F.explode("first").alias("item"), "value")

    placed = lambda df: df.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    return placed(pairs).unionByName(placed(terms).where(F.col("rank") <= ranks))
