"""Repeated passages: Rabin-Karp hashes of every window of words, counted across all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import bucket_bounds, exchange, pack_sorted, packed, unpack_sorted, unpacked
from .wordarrays import Words, inside_documents, window_hashes


def _windows(docs: pa.Table, width: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, and the starts and hashes of the windows."""
    words = Words.of(docs.column("text"))
    hashes = window_hashes(words.hashes(), width)
    starts = np.flatnonzero(inside_documents(words.docs, width, len(hashes)))
    return words, starts, hashes[starts]


def seen_earlier(payloads: list[bytes]) -> list[bytes]:
    """For each chunk's hashes in a bucket, bits that say whether an earlier chunk has the hash too."""
    lists = [unpack_sorted(unpacked(x)[0]) for x in payloads]
    everything = np.concatenate(lists)
    order = np.argsort(everything, kind="stable")  # equal hashes stay in the order of chunks
    ordered = everything[order]
    seen = np.zeros(len(everything), bool)
    seen[order[1:]] = ordered[1:] == ordered[:-1]
    return [packed(np.packbits(x)) for x in np.split(seen, np.cumsum([len(x) for x in lists])[:-1])]


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    sizes = np.diff(words.at)
    data = words.data[np.repeat(keep, sizes)]
    sizes = sizes[keep]
    out = np.full(len(data) + len(sizes), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    kept_before = np.concatenate([[0], np.cumsum(keep)])[words.docs]
    raw = out.tobytes()
    return pa.array([raw[a : max(a, b - 1)].decode() for a, b in zip(ends[kept_before[:-1]], ends[kept_before[1:]], strict=True)], pa.string())


def remove_repeats(docs: DataFrame, width: int = 20, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept), one row for each row of ``docs``.

    A window is ``width`` consecutive words of one document. Words covered by a window whose words also
    start a window earlier (smaller doc_id, or earlier in the same document) go: intervals lists the maximal
    stretches as (start, length) in words, and kept holds the other words joined by one space. Null or empty
    texts and texts of under ``width`` words lose nothing. Null ids come first; rows with one id count as
    earlier and later by their text. Extra columns are left out.

    Windows are equal when their 64-bit hashes are. Among n windows, a false match is expected n^2 / 2^65 times.
    """

    def ask(table: pa.Table, buckets: int) -> list[bytes]:
        distinct = np.unique(_windows(table, width)[2])
        at = bucket_bounds(distinct, buckets)
        return [packed(pack_sorted(distinct[a:b])) if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]

    def finish(table: pa.Table, answers: list[bytes]) -> pa.Table:
        words, starts, hashes = _windows(table, width)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = bucket_bounds(distinct, len(answers))
        bits = [np.unpackbits(unpacked(x)[0], count=b - a) for a, b, x in zip(at[:-1], at[1:], answers, strict=True) if b > a]
        earlier = np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)
        repeated = starts[earlier[place] | (first[place] != np.arange(len(place)))]
        cover = np.zeros(len(words) + 1, np.int32)
        cover[repeated] += 1
        np.subtract.at(cover, repeated + width, 1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(words), bool)
        edge[words.docs[:-1][words.docs[:-1] < len(words)]] = True
        begin = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]]))) if len(words) else np.zeros(0, np.int64)
        after = np.flatnonzero(gone & np.concatenate([edge[1:] | ~gone[1:], [True]])) if len(words) else np.zeros(0, np.int64)
        doc_of = np.searchsorted(words.docs, begin, side="right") - 1
        pairs = pa.StructArray.from_arrays([pa.array(begin - words.docs[doc_of], pa.int32()), pa.array(after - begin + 1, pa.int32())], ["start", "length"])
        intervals = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.docs), pa.int32()), pairs)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.docs])
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(words.docs), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "intervals": intervals, "kept": joined(words, ~gone)})

    return exchange(docs, ask, seen_earlier, finish, "doc_id long, n_words long, n_removed long, intervals array<struct<start:int,length:int>>, kept string", text)
