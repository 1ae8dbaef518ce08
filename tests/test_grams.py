"""Substring search pruned by 3-grams: the same hits, and few texts read."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.operators import grams, results, search

rng = random.Random(5)
LETTERS = "abc é中𝄞"
ROWS = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(12))), None if i % 9 == 8 else "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))) for i in range(150)]
ASKED = ["a", "ab", "abc", "é中", "中𝄞 a", "abca | bcab", "a & cab", "é & 中 | ccc & bbb", "17 & a", "zzz", "b c", " "] + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 7))) for _ in range(30)]


def scanned(plan):
    """Rows that the scans of a finished plan gave, by the columns that they read."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scanned(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scanned(plan.plan())
    if name == "FileSourceScanExec":
        return [(plan.output().mkString(","), plan.metrics().apply("numOutputRows").value())]
    return [x for i in range(plan.children().size()) for x in scanned(plan.children().apply(i))]


def test_grams_in_pieces(monkeypatch):
    batch = pa.record_batch([pa.array([i // 40 for i, _, _ in ROWS], pa.int32())] + [pa.array([str(r[k]) if r[k] is not None else None for r in ROWS]) for k in (1, 2, 0)], ["block", "title_norm", "body_norm", "article_id"])
    want = {}
    for i, title, body in ROWS:
        for bit, text in ((grams.TITLE, title), (grams.BODY, body or ""), (grams.ID, str(i))):
            for k in range(len(text) - 2):
                key = i // 40, sum(ord(c) << s for c, s in zip(text[k : k + 3], (42, 21, 0), strict=True))
                want[key] = want.get(key, 0) | bit
    for at_once in (1, 7, 10**6):
        monkeypatch.setattr(grams, "AT_ONCE", at_once)
        got = [r for b in grams._block_grams(iter([batch.slice(0, 60), batch.slice(60)])) for r in b.to_pylist()]
        assert len(got) == len(want) and {(r["block"], r["gram"]): r["parts"] for r in got} == want


def test_same_hits(spark, tmp_path):
    docs = search.documents(spark.createDataFrame(ROWS, "id long, title string, text string"), F.col("id"), F.col("title"), F.col("text"), F.col("id").cast("string"))
    grams.store(docs, str(tmp_path / "i"), 12)
    index, asked = grams.load(spark, str(tmp_path / "i")), search.parsed(search.query_table(spark, ASKED))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    for by in (search.WIKI, search.KB_TITLE, search.KB_BODY):
        want = rows(search.search(docs, asked, by))
        assert want and rows(grams.pruned_search(index, asked, by)) == want
    assert rows(grams.pruned_search(index, asked.where("false"))) == []


def test_pairs_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    docs = search.documents(spark.createDataFrame(ROWS, "id long, title string, text string"), F.col("id"), F.col("title"), F.col("text"))
    grams.store(docs, str(tmp_path / "i"), 5)
    asked = search.parsed(search.query_table(spark, ASKED))
    want = sorted((r.query_id, r.id) for r in search.search(docs, asked).collect())
    monkeypatch.setattr(grams, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(search, "BLOCK", 7)
    assert sorted((r.query_id, r.id) for r in grams.pruned_search(grams.load(spark, str(tmp_path / "i")), asked).collect()) == want


def test_a_rare_phrase_reads_few_texts(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = search.documents(t, F.col("doc_id"), F.lit(""), F.concat("text", F.when(F.col("doc_id") == 321, " a phrase so rare").otherwise("")))
    grams.store(docs, str(tmp_path / "i"), 50)
    found = grams.pruned_search(grams.load(spark, str(tmp_path / "i")), search.parsed(search.query_table(spark, ["Phrase so rare"])))
    assert [r.id for r in found.collect()] == [321]
    texts = sum(n for columns, n in scanned(found._jdf.queryExecution().executedPlan()) if "body_norm" in columns)
    assert 0 < texts < t.count() / 10


def test_the_best_hits_need_few_blocks(spark, tmp_path):
    rows = [(i, "a rare title" if i in (5, 77) else "other", "some common words of the text and more " + ("rare title" if i % 50 == 0 else "")) for i in range(400)]
    docs = search.documents(spark.createDataFrame(rows, "id long, title string, text string"), F.col("id"), F.col("title"), F.col("text"), F.col("id").cast("string"))
    grams.store(docs, str(tmp_path / "i"), 40)
    index, asked = grams.load(spark, str(tmp_path / "i")), search.parsed(search.query_table(spark, ["rare title", "common & rare", "the text | nothing", "of", "no such"]))
    for by in (search.WIKI, search.KB_TITLE, search.KB_BODY):
        for k in (1, 2, 5, 1000):
            best, blocks = grams.top(index, asked, k, by, first=2)
            want = results.top(search.search(docs, asked, by), k)
            rows_of = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
            assert rows_of(best) == rows_of(want)
            counted = {r.query_id: (r.candidates, r.scored) for r in blocks.collect()}
            if by == search.WIKI and k == 2:
                assert counted[1][1] == 2 < counted[1][0] and 4 not in counted
