"""Counting hashes or words across documents in two shuffles of packed rows.

Documents are dealt into *chunks* of neighbouring doc_ids. A chunk sends what it wants counted (its
distinct hashes, or its distinct words) to *buckets* by hash range, packed into one binary row for each
bucket; a bucket sees everything with its hashes, and answers each chunk in the order in which the chunk
sent; the answers meet the chunk's documents again. Spark deals, shuffles and groups the packed rows.
A key that is everywhere costs one entry in each chunk, however often it occurs, so no task grows with a
hot key. Chunks hold about as many bytes of text each, however long the input is; buckets hold equal shares of the hash range, and
there are as many as shuffle partitions, which are to be set to what fits a task, as for any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, shuffle_partitions

#: (text array, doc_id array) of a chunk -> one payload for each bucket.
Ask = Callable[[pa.Table, int], list[bytes]]
#: payloads of a bucket in the order of chunks (and the bucket's rows of the table beside, if there is one) -> the answer to each.
Answer = Callable[..., list[bytes]]
#: (documents of a chunk, answers by bucket) -> result rows.
Finish = Callable[[pa.Table, list[bytes]], pa.Table]


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one binary: a line of types, sizes and compressed sizes, then each array compressed by itself."""
    frames = [_compressor(level).compress(np.ascontiguousarray(x).data) for x in arrays]
    head = " ".join(f"{x.dtype.str},{len(x)},{len(f)}" for x, f in zip(arrays, frames, strict=True))
    return b"".join([head.encode(), b"\n", *frames])


def unpacked(blob: bytes) -> list[np.ndarray]:
    at = blob.index(b"\n") + 1
    out, decompressor = [], zstandard.ZstdDecompressor()
    for kind, n, size in (x.split(",") for x in blob[: at - 1].decode().split()):
        out.append(np.frombuffer(decompressor.decompress(blob[at : at + int(size)]), kind, int(n)))
        at += int(size)
    return out


def packed_table(table: pa.Table, level: int = 6) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return _compressor(level).compress(sink.getvalue())


def unpacked_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def planes(values: np.ndarray) -> np.ndarray:
    """Numbers as bytes, all lowest bytes first, so that equal high bytes compress."""
    little = values.astype(values.dtype.newbyteorder("<"))
    return np.ascontiguousarray(little.view(np.uint8).reshape(-1, little.itemsize).T).reshape(-1)


def from_planes(data: np.ndarray, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def pack_words(words: pa.Array) -> list[np.ndarray]:
    """Byte strings (large_binary) as arrays: lengths and bytes apart, which compress better than offsets."""
    w = pa.concat_arrays([words])
    at = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1]
    data = np.frombuffer(w.buffers()[2], np.uint8)[at[0] : at[-1]] if w.buffers()[2] else np.zeros(0, np.uint8)
    return [planes(np.diff(at).astype(np.uint32)), data]


def unpack_words(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(from_planes(sizes, "<u4"), dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def pack_sorted(hashes: np.ndarray) -> np.ndarray:
    """Ascending 64-bit numbers as the bytes of their steps."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(from_planes(steps, "<u8"), dtype=np.uint64)


def bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where in ascending ``hashes`` each of equally wide ranges of the 64-bit space begins; buckets + 1 positions."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]]).astype(np.int64)


def _in_order(table: pa.Table) -> pa.Table:
    """Documents by id, null first; repeated ids by text, so that every evaluation sees the same order."""
    ids = table.column("doc_id").combine_chunks()
    key = pa.table({"n": ids.is_valid(), "i": ids.fill_null(0), "t": table.column("text")})
    return table.take(pa.compute.sort_indices(key, [("n", "ascending"), ("i", "ascending"), ("t", "ascending")])) if len(table) else table


#: Ids (and sizes) that the driver looks at to part chunks.
SAMPLED = 2_000_000


def chunk_edges(docs: DataFrame, text: Column, chunk_bytes: int) -> np.ndarray:
    """Ids that part chunks of about ``chunk_bytes`` of text, from a sample of SAMPLED ids at most; it decides the balance and no result."""
    told = docs.select("doc_id", F.octet_length(text).cast("long").alias("size"))
    rows, size = told.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(1, -(-size // chunk_bytes))
    if n == 1:
        return np.zeros(0, np.int64)
    sample = told.sample(min(1.0, min(max(100_000, 20 * n), SAMPLED) / rows), seed=1) if rows > 100_000 else told
    found = sample.where("doc_id is not null").toPandas().sort_values("doc_id")
    upto = found["size"].cumsum().to_numpy()
    at = np.searchsorted(upto, upto[-1:] * np.arange(1, n) / n) if len(found) else np.zeros(0, np.int64)
    return np.unique(found["doc_id"].to_numpy(np.int64)[at])


def exchange(docs: DataFrame, ask: Ask, answer: Answer, finish: Finish, schema: str, text: str = "text", chunk_bytes: int = 5_000_000, by_hash: bool = False, beside: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """Run the three steps over (doc_id, text); null texts count as empty. Rows of ``schema`` come from ``finish``.

    ``chunk_bytes``: text in a chunk, which a task holds several times over. Buckets are as many as shuffle partitions. ``by_hash``: doc_id is a 64-bit
    hash of the text, evenly spread; each of them then counts once, and a task sends a text that it sees again not again.
    ``beside``: number of buckets -> a table with a column bucket (int), of which each bucket sees its rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    buckets = shuffle_partitions(docs.sparkSession)
    if by_hash:
        n = max(1, -(-(docs.agg(F.sum(F.octet_length(whole).cast("long"))).first()[0] or 0) // chunk_bytes))
        edges = np.array([(i << 64) // n - (1 << 63) for i in range(1, n)], np.int64)
    else:
        edges = chunk_edges(docs, whole, chunk_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if by_hash:
                ids = batch.column("doc_id").to_pylist()
                new = [x not in seen and not seen.add(x) for x in ids]
                batch = batch.filter(pa.array(new, pa.bool_()))
            chunk = np.searchsorted(edges, batch.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
            order = np.argsort(chunk, kind="stable")
            batch, chunk = batch.take(pa.array(order)), chunk[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]]) if len(chunk) else [0]
            parts = [(int(chunk[a]), packed_table(pa.Table.from_batches([batch.slice(a, b - a)]).combine_chunks())) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["chunk", "docs"])

    def documents_of(table: pa.Table) -> pa.Table:
        found = _in_order(pa.concat_tables([unpacked_table(x.as_py()) for x in table.column("docs")]).combine_chunks())
        if by_hash and len(found):
            ids = found.column("doc_id").to_numpy()
            found = found.filter(pa.array(np.concatenate([[True], ids[1:] != ids[:-1]])))
        return found

    def asking(key, table):
        pa.default_memory_pool().release_unused()  # what the group before left
        asked = ask(documents_of(table), buckets)
        some = [b for b, x in enumerate(asked) if x]
        return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()), "asked": pa.array([asked[b] for b in some], pa.binary())})

    def answering(key, table):
        return answers_of(key, table)

    def answering_beside(key, table, rows):
        return answers_of(key, table, rows)

    def answers_of(key, table, *rows):
        table = table.sort_by("chunk")
        answers = answer([x.as_py() for x in table.column("asked")], *rows) if len(table) else []
        return pa.table({"chunk": table.column("chunk"), "bucket": pa.array([key[0].as_py()] * len(table), pa.int32()), "answer": pa.array(answers, pa.binary())})

    def finishing(key, left, right):
        pa.default_memory_pool().release_unused()
        got = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist(), strict=True))
        return finish(documents_of(left), [got.get(b, b"") for b in range(buckets)])

    dealt = docs.select("doc_id", whole.alias("text")).mapInArrow(deal, "chunk int, docs binary")
    asked = dealt.groupBy("chunk").applyInArrow(asking, "bucket int, chunk int, asked binary")
    answered = asked.groupBy("bucket")
    if beside is not None:
        answered = answered.cogroup(beside(buckets).groupBy("bucket")).applyInArrow(answering_beside, "chunk int, bucket int, answer binary")
    else:
        answered = answered.applyInArrow(answering, "chunk int, bucket int, answer binary")
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(finishing, schema)
