"""Lines that many documents share, by hash ranges in document order.

Line hashes are dealt by range of (hash, document), so that even a line of every document is spread
evenly, and sorted within each range by hash, document and position. A first pass keeps what each range
knows of its first and last hash, two rows for each range: only those can continue in a neighbouring
range. A second pass streams through the ranges, decides for each hash and emits the positions to drop,
which come back as one compressed bitmap for each document that loses lines. Texts are not moved for this.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, lower_ascii, own_columns, shuffle_partitions

_SPACES = " \t\n\x0b\x0c\r"
_ROW = ["h1", "h2", "doc_id", "tag", "pos"]


def _tag(text):
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def line_hashes(docs: DataFrame, min_chars: int, text: str) -> DataFrame:
    """(h1, h2, doc_id, tag, pos) for each line whose key has at least ``min_chars`` code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    keys = F.transform(F.split(t, "\n", -1), lambda x: lower_ascii(F.trim(x, F.lit(_SPACES))))
    rows = docs.select("doc_id", _tag(t).alias("tag"), F.posexplode(keys).alias("pos", "key")).where(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "tag", "pos")


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where a new hash begins."""
    return np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, np.int64)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in _ROW]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range knows of its first and its last hash: number of documents, smallest and largest."""
    held: list[list] = []  # [h1, h2, documents, smallest, largest] of the first and the latest hash
    for batch in batches:
        h1, h2, doc, _, _ = _arrays(batch)
        starts = _runs(h1, h2)
        for k in {0, len(starts) - 1} if len(starts) else ():
            a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else len(h1)
            n = int((np.diff(doc[a:b]) != 0).sum()) + 1
            if held and held[-1][:2] == [h1[a], h2[a]]:
                held[-1][2] += n - (held[-1][4] == doc[a])
                held[-1][4] = doc[b - 1]
            else:
                held[1:] = []
                held.append([h1[a], h2[a], n, doc[a], doc[b - 1]])
    yield pa.record_batch([pa.array([int(x[i]) for x in held], pa.int64()) for i in range(5)], ["h1", "h2", "n", "low", "high"])


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, tag, n_dropped, keep): a compressed bitmap for each document that loses lines.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all their lines but those of the largest
    doc_id. Bit i of ``keep`` (zlib) says whether line i stays; lines beyond the bitmap stay. Rows without a doc_id
    are never compared. Rows that repeat a doc_id are one document.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = line_hashes(docs.where(F.col("doc_id").isNotNull()), min_chars, text)
    ranged = cut(rows.repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "tag", "pos"))
    edges = ranged.mapInArrow(_edges, "h1 long, h2 long, n long, low long, high long").withColumn("part", F.spark_partition_id())
    known: dict[tuple[int, int], tuple[int, int]] = {}  # two hashes for each range at most
    for x in sorted(edges.collect(), key=lambda x: (x.h1, x.h2, x.low, x.part)):
        count, high = known.get((x.h1, x.h2), (0, None))
        known[x.h1, x.h2] = (count + x.n - (high == x.low), x.high)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of one hash that may go on in the next batch

        def dropped(part: list[np.ndarray]) -> pa.RecordBatch:
            h1, h2, doc, tag, pos = part
            starts = _runs(h1, h2)
            sizes = np.diff(np.append(starts, len(h1)))
            new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
            new[starts] = True
            count = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else sizes
            high = doc[starts + sizes - 1]
            for k in {0, len(starts) - 1} if len(starts) else ():
                count[k], high[k] = known.get((int(h1[starts[k]]), int(h2[starts[k]])), (count[k], high[k]))
            gone = np.repeat(count >= min_docs, sizes) & (doc != np.repeat(high, sizes))
            return pa.record_batch([pa.array(doc[gone]), pa.array(tag[gone]), pa.array(pos[gone].astype(np.int32))], ["doc_id", "tag", "pos"])

        def released(*more: list[np.ndarray]) -> pa.RecordBatch:
            pieces = [*held, *more]
            held.clear()
            return dropped([np.concatenate(x) for x in zip(*pieces, strict=True)])

        for batch in batches:
            rows = _arrays(batch)
            if not len(rows[0]):
                continue
            last = int(_runs(rows[0], rows[1])[-1])
            goes_on = held and last == 0 and (held[0][0][0], held[0][1][0]) == (rows[0][0], rows[1][0])
            if not goes_on:
                yield released([x[:last] for x in rows])
            held.append([x[last:] for x in rows])
            if (int(rows[0][-1]), int(rows[1][-1])) in known:  # its verdict needs no further rows
                yield released()
        if held:
            yield released()

    gone = ranged.mapInArrow(stream, "doc_id long, tag long, pos int")
    by_doc = gone.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("gone"))
    return by_doc.select("doc_id", "tag", F.size("gone").cast("long").alias("n_dropped"), F.pandas_udf(_bitmap, "binary")("gone").alias("keep"))


def _bitmap(gone: pd.Series) -> pd.Series:
    def one(positions) -> bytes:
        keep = np.ones((max(positions) | 7) + 1, bool)  # whole bytes
        keep[np.asarray(positions)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return gone.map(one)


def _kept_lines(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t, bits):
        if bits is None:
            return None
        lines = t.split("\n")
        flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(lines)]
        return "\n".join([x for x, f in zip(lines, flags, strict=False) if f] + lines[len(flags) :])

    return pd.Series([one(t, b) for t, b in zip(text, keep, strict=True)], dtype=object)


def drop_repeated(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with its columns, ``text`` without the repeated lines, and with ``counts`` n_lines and n_dropped (long).

    Null and empty texts have one empty line and stay as they are; rows without a doc_id lose nothing. Extra columns pass through, whatever
    their names; only with ``counts``, columns named n_lines and n_dropped are replaced. An empty table gives no rows.
    """
    maps = repeated_lines(docs, min_chars, min_docs, text).select(F.col("doc_id").alias("id_b"), F.col("tag").alias("tag_b"), F.col("n_dropped").alias("gone"), "keep")
    t = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.select("doc_id", F.col(text).alias("text"), own_columns(docs, ("doc_id", text)).alias("own")).withColumn("tag", _tag(t))
    joined = mine.join(maps, (F.col("doc_id") == F.col("id_b")) & (F.col("tag") == F.col("tag_b")), "left")
    changed = F.pandas_udf(_kept_lines, "string")(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep"))
    joined = joined.withColumn("new", changed)
    told = {"n_lines": F.size(F.split(t, "\n", -1)).cast("long"), "n_dropped": F.coalesce("gone", F.lit(0).cast("long"))} if counts else {}
    own = {"doc_id": F.col("doc_id"), text: F.coalesce("new", "text")}
    columns = [(own[c] if c in own else F.col(f"own.`{c}`")).alias(c) for c in docs.columns if c not in told]
    return joined.select(*columns, *[x.alias(c) for c, x in told.items()])
