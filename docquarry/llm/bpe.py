"""Byte-level BPE through a table of distinct words.

Texts are split at single spaces and line feeds between visible characters, where the tokenizer splits in
any case. A chunk of documents sends each distinct word once to the word's bucket; the bucket encodes each
distinct word once with the tokenizer's own model and answers with the ids; the chunk puts them at the words'
positions. Decoding joins ids with the table of pieces, which has one row for each id of the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import exchange, from_planes, pack_words, packed, planes, unpack_words, unpacked
from .wordarrays import binary_array, text_bytes, word_buckets

#: White space outside ASCII, and separators that engines class differently.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def split_units(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts of units with the end, first unit of each document with the end).

    A unit begins at each text, and at each space or line feed between two visible characters. Bytes above 127
    count as visible unless some text holds white space outside ASCII; then only ASCII does, which cuts
    into fewer, longer units. Units put together are the text.
    """
    data, at = text_bytes(texts)
    visible = _VISIBLE.copy()
    visible[128:] = _ODD_SPACE.search(data.tobytes().decode()) is None
    seen = visible[data]
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        gap = (data[1:-1] == 32) | (data[1:-1] == 10)
        cut[1:-1] = gap & seen[:-2] & seen[2:]
    edges = at[(at > 0) & (at < len(data))]
    for near in (edges, edges - 1):  # the neighbour would be in another text
        cut[near] = False
    cut[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(cut)
    return data, np.append(starts, len(data)), np.searchsorted(starts, at)


@cache
def _tokenizer(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row for each row of ``docs``.

    ``vocabulary``: path of a byte-level BPE file, read on the driver (a fixed few MB). The ids are those of the
    tokenizer with add_special_tokens=False; special tokens written out in a text are taken as such. Null and
    empty texts have no ids. Repeated rows are encoded alike. Extra columns are left out.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def dictionary(table: pa.Table, buckets: int) -> tuple[np.ndarray, pa.Array, list[np.ndarray], np.ndarray]:
        data, starts, firsts = split_units(table.column("text"))
        found = binary_array(data, starts).dictionary_encode()
        words = found.dictionary
        bucket = word_buckets(words, buckets)
        by_word = pa.compute.sort_indices(words).to_numpy()  # neighbours in order compress well
        order = by_word[np.argsort(bucket[by_word], kind="stable")].astype(np.int64)
        groups = np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))
        return found.indices.to_numpy(), words, groups, firsts

    def ask(table: pa.Table, buckets: int) -> list[bytes]:
        _, words, groups, _ = dictionary(table, buckets)
        return [packed(*pack_words(words.take(pa.array(g))), level=3) if len(g) else b"" for g in groups]

    def answer(payloads: list[bytes]) -> list[bytes]:
        lists = [unpack_words(*unpacked(x)) for x in payloads]
        everything = pa.concat_arrays(lists).dictionary_encode()
        distinct = [w.decode() for w in everything.dictionary.to_pylist()]
        tokenizer, step = _tokenizer(shared.value), 20_000
        ids = [x.ids for i in range(0, len(distinct), step) for x in tokenizer.encode_batch_fast(distinct[i : i + step], add_special_tokens=False)]
        table = pa.array(ids, pa.list_(pa.int32()))
        at = np.cumsum([0] + [len(x) for x in lists])
        answers = (table.take(everything.indices.slice(a, b - a)) for a, b in zip(at[:-1], at[1:], strict=True))
        return [packed(planes(x.value_lengths().to_numpy().astype(np.uint32)), planes(x.flatten().to_numpy().astype(np.uint32)), level=3) for x in answers]

    def finish(table: pa.Table, answers: list[bytes]) -> pa.Table:
        codes, words, groups, firsts = dictionary(table, len(answers))
        got = [[from_planes(y, "<u4") for y in unpacked(x)] for g, x in zip(groups, answers, strict=True) if len(g)]
        place = np.zeros(len(words), np.int64)
        place[np.concatenate([*groups, np.zeros(0, np.int64)]).astype(np.int64)] = np.arange(len(words))
        sizes, values = (np.concatenate([*x, np.zeros(0, np.uint32)]) for x in (zip(*got, strict=True) if got else ((), ())))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32))).take(pa.array(place[codes]))
        at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(), dtype=np.int64)])[firsts]
        return pa.table({"doc_id": table.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.flatten())})

    return exchange(docs, ask, answer, finish, "doc_id long, ids array<int>", text, chunk_bytes=2_500_000)


def pieces(vocabulary: str) -> list[bytes]:
    """The bytes of each id. The file writes bytes as printable characters: those that are printable stand for
    themselves, the others for the characters from U+0100 in order."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())]


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Append ``decoded`` to rows with ``ids``: each id joined with its piece in the broadcast table of pieces (one
    row for each id of the vocabulary, a fixed bound), the pieces put together in order. Other columns pass through.

    Null ids give a null text. Bytes that are no UTF-8 become U+FFFD. A column named decoded is replaced.
    """
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(vocabulary))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_binary())
        for whole in batches:
            per = max(1, len(whole) * 500_000 // max(1, len(whole.column("ids").flatten())))
            for batch in (whole.slice(i, per) for i in range(0, len(whole), per)):  # about half a million ids at a time
                ids = batch.column("ids")
                found = table.take(ids.flatten())
                raw, at = found.buffers()[2].to_pybytes() if len(found) else b"", np.frombuffer(found.buffers()[1], np.int64) if len(found) else np.zeros(1, np.int64)
                ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = [raw[at[a] : at[b]].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield batch.append_column("decoded", pa.array(texts, pa.string(), mask=~ids.is_valid().to_numpy(zero_copy_only=False)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(join, f"{fields}, decoded string")

