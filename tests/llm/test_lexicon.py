"""The audit of sources, the URL filter and the lexical search against plain versions, over odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import divergence, lexical_search, lexicon, queries, url_filter
from tests.test_catalog import FOLDER

from . import brute

rng = random.Random(11)
VOCAB = ["Alpha", "beta2", "gämma", "ζeta", "don't", "x", "中文", "e-mail"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]


def prose(n):
    return " ".join(rng.choice(VOCAB[: 1 + rng.randrange(len(VOCAB))]) for _ in range(n))


TEXTS = [None, "", " 12 \x01 ", "alpha ALPHA Älpha", "x" * 40_000, prose(4000)] + [prose(rng.randrange(1, 60)) for _ in range(120)]
ROWS = [(i * 5, t, [None, "en", "en", "de"][i % 4], [None, "s1", "s2", "s3", "s1"][i % 5]) for i, t in enumerate(TEXTS)]
ROWS += ROWS[10:20] + [(None, "alpha beta2", "fr", "s1"), (None, None, "fr", "s9"), (7, "alpha beta2", "fr", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "clash", 1, 2) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n long, cells long").repartition(3)


def test_terms():
    import pyarrow as pa

    texts = ["", "ab1Cd", "é-É", "", "a"]
    for inside, digits in ((lexicon.LETTERS, False), (lexicon.LETTERS_DIGITS, True)):
        words = lexicon.terms(pa.array(texts), inside)
        codes, distinct = words.codes()
        found = [distinct[c].as_py().decode() for c in codes]
        assert [found[a:b] for a, b in zip(words.docs[:-1], words.docs[1:], strict=True)] == [brute.terms(t, digits) for t in texts]


def test_audit(docs, spark):
    for min_docs, ranks in ((10, 10), (2, 3), (1, 1), (1000, 10)):
        got = sorted(tuple(r) for r in divergence.audit(docs, min_docs, ranks).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == brute.audit([(lang, s, t) for _, t, lang, s in ROWS], min_docs, ranks)
    assert divergence.audit(docs.where("false")).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    for c, n, v in ((0, 0, 1), (5, 10, 3), (8_999_999_999, 10**13, 10**6), (9_000_000_000, 10**13, 10**6), (10**14, 3 * 10**15, 10**8)):
        row = spark.sql(f"SELECT {c}L c, {n}L n, {v}L v").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()
        assert row[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_lexical_search(docs, spark):
    items = [(1, "alpha gämma"), (2, "wab wab waa x"), (3, None), (4, "nowhere"), (5, prose(30)), (5, "beta2"), (6, "don't x 中文"), (None, "ζeta")]
    asked = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    want = brute.lexical([(i, t) for i, t, _, _ in ROWS], items, 7)
    for per_pass in (10**6, 5):
        got = [tuple(r) for r in lexical_search.search(docs, asked, 7, per_pass=per_pass).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert lexical_search.search(docs.where("false"), asked).collect() == [] and lexical_search.search(docs, asked.where("false")).collect() == []


def test_one_id_in_many_rows(spark):
    rows = [(3, "alpha beta")] * 50 + [(9, "alpha")] * 3
    found = lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(1, "beta")], "item_id long, text string"), 10)
    assert [r.doc_id for r in found.collect()] == [3] * 10
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 11))


def test_radix_order():
    for top in (0, 1, 2**16, 2**40, 2**63):
        keys = np.random.default_rng(1).integers(0, max(1, top), 5000, np.uint64, endpoint=True)
        assert (lexical_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical_search.radix_order(np.zeros(0, np.uint64))) == 0


def test_segment():
    cost = {w: c for w, c in [("cheap", 5), ("pills", 6), ("che", 4), ("ap", 4), ("a", 2), ("p", 3)]}
    assert url_filter.segment("cheappills", cost, 10, 3) == ["cheap", "pills"]
    assert url_filter.segment("", cost, 10, 3) == [] and url_filter.segment("zzz", cost, 10, 3) == ["zzz"]
    letters = "abc"
    for _ in range(300):
        some = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 30) for _ in range(rng.randrange(9))}
        run, first, more = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))), rng.randrange(5, 25), rng.randrange(1, 9)
        got = url_filter.segment(run, some, first, more, 3)
        assert "".join(got) == run and got == brute.split_run(run, some, first, more, 3)[1]


URLS = [
    None, "", "no scheme/en/", "https://example.com/en/x", "https://www.example.com/en/x?q", "http://WWW.Example.COM/EN/x", "https://badexample.com/en/", "https://example.net/es/", "https://a.b.net/fr/#x", "https://net", "https://com/",
    "https://x.com", "ftp://x.com?a/b", "://com/", "https://a://b.com/", "https://cheap-pills.example.org/en/1", "https://10.0.0.1:80/a/b/", "https://münchen.example.org/straße/", "https://" + "ab" * 60 + ".org/" + "z/" * 3000,
]


def test_urls(spark):
    html = ["<p>cheap pills the example</p>", None, "a b <<< c", "organ org net com <b>en</b>"]
    pages = [(None if i % 9 == 8 else i, u, html[i % 4]) for i, u in enumerate(URLS * 3)]
    frame = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, words string").repartition(3)
    for rules in (url_filter.RULES, (), (("block", "org/"), ("allow", "org/"), ("allow", "example.org/en/"))):
        got = [tuple(r) for r in url_filter.judge(frame, rules).select("page_id", "host", "path", "rule", "verdict", "score").collect()]
        kept = tuple({r: (v, r) for v, r in reversed(rules)}.values())
        assert sorted(got, key=str) == sorted(brute.judge_urls(pages, kept), key=str)
    assert url_filter.judge(frame.where("false")).collect() == []


def test_a_very_long_host(spark):
    row = [(1, "https://" + "cheap" * 20_000 + ".org/" + "x/" * 100_000, "<p>cheap</p> org")]
    got = url_filter.judge(spark.createDataFrame(row, "page_id long, url string, html string")).first()
    assert got.words == "cheap " * 20_000 + "org" and got.verdict == "allow"


def test_urls_of_the_registered_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in queries.op12_urls(spark, FOLDER).select("page_id", "host", "path", "rule", "verdict", "score").collect()]
    assert sorted(got) == sorted(brute.judge_urls(pages, url_filter.RULES))
