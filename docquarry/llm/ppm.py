"""Prediction by partial matching over bytes, trained on the corpus, beside a word-frequency base.

Training counts every (order + 1)-gram of bytes in the training documents; Spark sums them, and all shorter grams
from them. A context with total T over D symbols predicts a symbol by c / (T + D) and escapes by D / (T + D) to the context
shorter by one byte, where symbols of the longer context are excluded; below the empty context all symbols not yet
excluded are alike. A context of at most ``order`` bytes forgets what lies before it, so a byte's probability hangs on the
(order + 1)-gram that ends with it alone. ``gram_scores`` gives that of every gram of the corpus as a table, from the
grams of each length joined to those shorter by one byte; no count is dropped and nothing is broadcast. Chunks of documents look their
distinct grams up by exchange.

A gram's shorter grams are at least as frequent, so each context's symbols are among those of the
context shorter by one byte, and what exclusion leaves is a difference of sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut
from .exchange import exchange, from_planes, pack_sorted, pack_words, packed, planes, unpack_sorted, unpack_words, unpacked
from .wordarrays import _LOWER, Words, text_bytes, word_buckets

#: Symbols: bytes, and the end of a text, which also stands before its beginning.
END, SYMBOLS = 256, 257


def is_training(doc_id: Column, folds: int = 10) -> Column:
    """Whether crc32 of the id as text isn't 0 modulo ``folds``; a null id counts as empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != 0


def _symbols(texts: pa.Array | pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each after ``order`` ends and before one; and where each text's own symbols begin, with the end."""
    data, at = text_bytes(texts)
    data = _LOWER[data]
    n = len(at) - 1
    own = at + np.arange(n + 1) * (order + 1)  # where each padded text begins
    out = np.full(own[-1], END, np.int64)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * (order + 1) + order, np.diff(at))] = data
    return out, own


def _grams(texts: pa.Array | pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of order + 1 symbols that ends with each symbol of the texts and with each end; and how many each text has."""
    symbols, own = _symbols(texts, order)
    gram = np.zeros(max(0, len(symbols) - order), np.int64)
    for k in range(order + 1):
        gram = gram * SYMBOLS + symbols[k : k + len(gram)]
    inside = np.ones(len(symbols) + 1, bool)  # grams that would begin in one text and end in the next
    for k in range(1, order + 1):
        inside[np.maximum(own[1:] - k, 0)] = False
    return gram[inside[: len(gram)]], np.diff(own) - order


def _gram_rows(docs: DataFrame, order: int, text: str) -> DataFrame:
    """(gram long, n long): every gram of order + 1 symbols, in base 257, that ends within a text or at its end, with counts in parts, several rows for a gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_n = [], []

        def merged():
            g, place = np.unique(np.concatenate([*held_g, np.zeros(0, np.int64)]), return_inverse=True)
            return g, np.bincount(place, np.concatenate([*held_n, np.zeros(0)]), minlength=len(g)).astype(np.int64)

        for batch in batches:
            size = max(1, int(len(batch) * 4e6 // max(1, batch.nbytes)))
            for i in range(0, len(batch), size):  # pieces of about 4 MB
                found = pa.array(_grams(batch.column(0).slice(i, size), order)[0]).dictionary_encode()
                held_g.append(found.dictionary.to_numpy())
                held_n.append(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).astype(np.float64))
                if sum(map(len, held_g)) > 4_000_000:  # bounded memory: what is summed so far goes out
                    g, n = merged()
                    held_g, held_n = [g], [n.astype(np.float64)]
                    if len(g) > 2_000_000:
                        yield pa.record_batch([pa.array(g), pa.array(n)], ["gram", "n"])
                        held_g, held_n = [], []
        g, n = merged()
        yield pa.record_batch([pa.array(g), pa.array(n)], ["gram", "n"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "gram long, n long")


def gram_scores(docs: DataFrame, learns: Column, order: int = 5, text: str = "text") -> DataFrame:
    """(gram, worth): log10 probability of the last symbol of each gram of ``docs`` after the others, trained where ``learns``.

    One level for each length: a gram of k + 1 symbols meets its last k symbols by join, and the grams of its context by window (257 rows
    at most). ``after``: log10 probability of the symbol after an escape from the gram's context, for symbols that the context doesn't know.
    """
    rows = _gram_rows(docs.where(learns), order, text).unionByName(_gram_rows(docs.where(~learns), order, text).withColumn("n", F.lit(0).cast("long")))
    counts = [cut(rows.groupBy(F.col("gram").alias("g")).agg(F.sum("n").alias("n")))]
    for k in range(order, 0, -1):
        counts.append(cut(counts[-1].groupBy((F.col("g") % SYMBOLS**k).alias("g")).agg(F.sum("n").alias("n"))))
    g, n, m, total, kinds = (F.col(x) for x in ("g", "n", "m", "total", "kinds"))
    known = counts[-1].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(n > 0).alias("kinds")).first()
    share = lambda part, whole: F.log10(part) - F.log10(whole)  # noqa: E731  null, and not used, where a context was never seen
    below = F.lit(-float(np.log10(SYMBOLS - known.kinds)))
    level = counts.pop().select("g", "n", F.lit(known.total).alias("total"), F.lit(known.kinds).alias("kinds"), below.alias("after"))
    escape = share(kinds, total + kinds) + F.col("after")
    level = level.withColumn("worth", F.when(n > 0, share(n, total + kinds)).when(kinds > 0, escape).otherwise(below))
    for k in range(1, order + 1):
        shorter = level.select(g.alias("suffix"), n.alias("m"), total.alias("up_total"), kinds.alias("up_kinds"), F.col("after").alias("up_after"), F.col("worth").alias("up_worth"))
        met = counts.pop().withColumn("suffix", g % SYMBOLS**k).join(shorter, "suffix")
        context = W.partitionBy(F.floor(g / SYMBOLS).cast("long"))
        met = met.withColumns({"total": F.sum("n").over(context), "kinds": F.count_if(n > 0).over(context), "shared": F.sum(F.when(n > 0, m).otherwise(0)).over(context)})
        # what exclusion leaves in the shorter context: symbols, and their counts with the escape's
        fresh = F.col("up_kinds") - kinds
        left = F.col("up_total") - F.col("shared") + fresh
        met = met.withColumn("after", F.when(m > 0, share(m, left)).otherwise(F.when(fresh > 0, share(fresh, left)).otherwise(0.0) + F.col("up_after")))
        level = met.select("g", "n", "total", "kinds", "after", F.when(n > 0, share(n, total + kinds)).when(kinds > 0, escape).otherwise(F.col("up_worth")).alias("worth"))
        level = cut(level) if k < order else level
    return level.select(g.alias("gram"), "worth")


def _bucket(gram, buckets: int):
    """A gram's bucket; the same over numpy arrays and over columns."""
    return gram % 2_147_483_647 % buckets


def score(docs: DataFrame, order: int = 5, folds: int = 10, text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    A-Z are lower-cased; null texts are empty. Tokens are words without ASCII white space and one end. Both models learn
    from the documents that are not held out. base_score: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1)));
    score: log10 probability of the text and its end by all grams counted. Every symbol has a probability above zero,
    so scores are finite. Repeated rows count again. An empty table gives no rows.
    """
    worths = gram_scores(docs, is_training(F.col("doc_id"), folds), order, text)

    def training(table: pa.Table) -> np.ndarray:
        return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds != 0 for x in table.column("doc_id").to_pylist()], bool)

    def words(table: pa.Table, buckets: int):
        found = Words.of(table.column("text"), lower=True)
        codes, distinct = found.codes()
        # the end is a word that no text can hold
        distinct = pa.concat_arrays([distinct.cast(pa.large_binary()), pa.array([b"\n"], pa.large_binary())])
        bucket = word_buckets(distinct, buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        return found, codes, distinct, by_bucket, np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))

    def grams(table: pa.Table, buckets: int):
        """Each gram's number, how many each text has, and the distinct ones with their order by bucket and value."""
        gram, sizes = _grams(table.column("text"), order)
        coded = pa.array(gram).dictionary_encode()
        distinct = coded.dictionary.to_numpy()
        bucket = _bucket(distinct, buckets)
        by_bucket = np.lexsort((distinct, bucket))
        return coded.indices.to_numpy(), sizes, distinct, by_bucket, np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))

    def ask(table: pa.Table, buckets: int) -> list[bytes]:
        found, codes, distinct, by_bucket, at = words(table, buckets)
        learns = training(table)
        n = np.bincount(codes[np.repeat(learns, np.diff(found.docs))], minlength=len(distinct)).astype(np.uint32)
        n[-1] = learns.sum()
        _, _, gram, grams_by_bucket, grams_at = grams(table, buckets)
        gram = gram[grams_by_bucket].astype(np.uint64)

        def payload(k: int) -> bytes:
            some = by_bucket[at[k] : at[k + 1]]
            return packed(*pack_words(distinct.take(pa.array(some))), planes(n[some]), pack_sorted(gram[grams_at[k] : grams_at[k + 1]]))

        return [payload(k) for k in range(buckets)]  # every bucket is asked, if only for its totals

    def answer(payloads: list[bytes], scored: pa.Table) -> list[bytes]:
        asked = [unpacked(x) for x in payloads]
        whole = pa.concat_arrays([unpack_words(sizes, data) for sizes, data, _, _ in asked])
        codes = whole.dictionary_encode().indices.to_numpy()
        total = np.bincount(codes, np.concatenate([from_planes(n, "<u4") for _, _, n, _ in asked])).astype(np.int64) if len(whole) else np.zeros(0, np.int64)
        sums = [int(total.sum()), int((total > 0).sum())]
        parts = np.split(total[codes], np.cumsum([len(n) // 4 for _, _, n, _ in asked])[:-1])
        gram, worth = scored.column("gram").to_numpy(), scored.column("worth").to_numpy()
        by_gram = np.argsort(gram)
        gram, worth = gram[by_gram], worth[by_gram].astype(np.float32)
        out = []
        for (_, _, _, steps), counts in zip(asked, parts, strict=True):
            wanted = unpack_sorted(steps).astype(np.int64)
            at = np.searchsorted(gram, wanted)
            if not np.array_equal(gram[at], wanted):
                raise ValueError("a gram of the documents was not scored")
            out.append(packed(planes(np.concatenate([sums, counts]).astype(np.int64)), planes(worth[at])))
        return out

    def finish(table: pa.Table, answers: list[bytes]) -> pa.Table:
        found, codes, distinct, by_bucket, _ = words(table, len(answers))
        answered = [(from_planes(c, "<i8"), from_planes(w, "<f4")) for c, w in map(unpacked, answers)]
        tokens, kinds = sum(int(x[0]) for x, _ in answered), sum(int(x[1]) for x, _ in answered)
        c = np.zeros(len(distinct), np.int64)
        c[by_bucket] = np.concatenate([x[2:] for x, _ in answered])
        worth = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
        doc = np.repeat(np.arange(len(table)), np.diff(found.docs))
        base = np.bincount(doc, worth[codes], minlength=len(table)) + worth[-1]
        known = np.bincount(doc, c[codes] > 0, minlength=len(table)).astype(np.int64) + int(c[-1] > 0)
        gram_codes, sizes, kinds_of, grams_by_bucket, _ = grams(table, len(answers))
        of_gram = np.zeros(len(kinds_of), np.float32)
        of_gram[grams_by_bucket] = np.concatenate([x for _, x in answered])
        scores = np.bincount(np.repeat(np.arange(len(table)), sizes), of_gram[gram_codes], minlength=len(table))
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": pa.array(~training(table)),
                "n_tokens": pa.array(np.diff(found.docs) + 1, pa.int64()),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(table), tokens), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(scores),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    beside = lambda buckets: worths.withColumn("bucket", _bucket(F.col("gram"), buckets).cast("int"))
    return exchange(docs, ask, answer, finish, schema, text, chunk_bytes=2_500_000, beside=beside)
