"""Terms of texts: maximal runs of letters, or of letters and digits; what lies outside ASCII counts as a letter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordarrays import Words, text_bytes

#: Classes of bytes. Every byte of a character outside ASCII is above 127.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True
#: The first of them as a pattern of Java's regular expressions.
LETTER_RUN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(texts: pa.ChunkedArray | pa.Array, inside: np.ndarray) -> Words:
    """The maximal runs of the class ``inside`` in each text, with A-Z lower-cased. No nulls."""
    data, at = text_bytes(texts)
    member = inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = member[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False  # runs end with their text
    starts = np.flatnonzero(member & ~before)
    begins = (np.cumsum(member) - 1)[starts] if len(starts) else np.zeros(0, np.int64)
    kept = _LOWER[data[member]]
    return Words(kept, np.append(begins, len(kept)).astype(np.int64), np.searchsorted(starts, at).astype(np.int64))


def as_strings(words: pa.Array) -> pa.Array:
    """Byte strings that are UTF-8 as strings."""
    return words.view(pa.large_string()).cast(pa.string())


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes of a column; a longer text is a piece with its neighbours."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def counted_terms(docs: DataFrame, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., term, n, docs): occurrences of each run of letters, and rows that hold it, over all rows of ``docs``.

    ``by``: columns of strings to count by. Nulls count as ''. Counts are summed within a batch, then within a task, before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = terms(batch.column("text"), LETTERS)
                codes, distinct = words.codes()
                if not len(codes):
                    continue
                group, names = np.zeros(len(batch), np.int64), []
                for c in by:
                    coded = batch.column(c).dictionary_encode()
                    group = group * len(coded.dictionary) + coded.indices.to_numpy()
                    names.append(batch.column(c))
                _, first, group = np.unique(group, return_index=True, return_inverse=True)
                doc, n = np.repeat(np.arange(len(batch)), np.diff(words.docs)), len(distinct)
                key, times = np.unique(doc * n + codes, return_counts=True)  # each document's terms
                key, place, rows = np.unique(group[key // n] * n + key % n, return_inverse=True, return_counts=True)
                total = np.bincount(place, times, len(key)).astype(np.int64)
                row = pa.array(first[key // n])
                yield pa.record_batch([*[x.take(row) for x in names], as_strings(distinct).take(pa.array(key % n)), pa.array(total), pa.array(rows.astype(np.int64))], [*by, "term", "n", "docs"])

    held = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by])
    found = held.mapInArrow(count, "".join(f"`{c}` string, " for c in by) + "term string, n long, docs long")
    return found.groupBy(*by, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
