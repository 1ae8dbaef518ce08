"""The registered queries against SQL, and the pipeline against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import queries
from tests.test_catalog import FOLDER, TABLES, duck, same  # noqa: F401

from . import brute


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_patterns_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op2_disclosure(spark, FOLDER).collect():
        found = brute.pii(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.spans.startswith(",".join(found)) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in found) for k in ("email", "ip", "card", "phone")]


def test_pipeline(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    # hot sources, copies and shared lines of the smallest table, as they are
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if brute.quality(r[1])[-1]]
    texts = {i: x[2] for i, x in brute.drop_lines({i: t for i, t, _ in rows}).items()}
    keep = {i for i, (_, c) in brute.ngram_groups(texts).items() if c == i}
    source = {i: s for i, _, s in rows}
    copies = brute.mix([(i, source[i], len(brute.words(texts[i]))) for i in sorted(keep)])
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i, tokenizer.encode(texts[i], add_special_tokens=False).ids, digest(texts[i])) for i in keep for _ in range(copies[i]))
    got = sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_stages_on_odd_tables(spark):
    """Clashing columns, nulls, an empty table and a very long text go through all stages."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, " ".join(f"w{i % 5000}" for i in range(60_000)), None, None, 1)]
    mixed = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("_id", "_tag", "_gone", "_keep", "_own", "n_lines", "n_dropped", "kept", "own", "gone", "keep", "new", "tag"):
        mixed = mixed.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mixed, FOLDER)
        assert out.columns == mixed.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in ("_id", "_tag", "_gone", "n_lines", "kept", "own") if r.doc_id is not None)
        assert stage(spark, mixed.where("false"), FOLDER).collect() == []
    assert len(corpus_pipeline.STAGES[-1][1](spark, mixed, FOLDER).collect()) == 63


def test_visible_words_of_all_pages(spark):
    """The multiset of words, but for list marks, is that of a plain parser."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.op1_html_text(spark, FOLDER).collect():
        lines = [re.sub(r"^\s*(- |\d+\. )+", "", x) for x in r.text.split("\n")]
        assert Counter(" ".join(lines).split()) == brute.visible_words(pages[r.page_id]), r.page_id


def test_scores_of_the_registered_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    some = [i for i in docs if held[i]] + sorted(i for i in docs if not held[i])[:20]
    want = dict(zip(some, brute.ppm([t for i, t in docs.items() if not held[i]], [docs[i] for i in some], 5), strict=True))
    got = {r.doc_id: r.score for r in queries.op4_ppm(spark, FOLDER).collect()}
    assert len(got) == len(docs) and all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in some)


def test_encoding_of_the_registered_query(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, FOLDER).collect():
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert r.decoded_sha256 == digest(tokenizer.decode(ids, skip_special_tokens=False))


def test_disclosure_of_the_registered_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = brute.disclosing(docs)
    for r in queries.op2_disclosure(spark, FOLDER).collect():
        extra = [x for x in r.spans.split(",") if x.startswith(("general", "removed"))]
        assert sorted(extra) == sorted(f"{k}:{a}:{b}" for k, a, b in want.get(r.doc_id, [])), r.doc_id
