"""All queries in one pass give what a join of each with each text gives."""

import random

from pyspark.sql import functions as F

from docquarry.operators import many, search

from .test_grams import ASKED, LETTERS, ROWS

rng = random.Random(3)
MORE = ASKED + ["".join(rng.choice(LETTERS + "&|") for _ in range(rng.randrange(1, 9))) for _ in range(1500)]


def test_same_hits(spark):
    docs = search.documents(spark.createDataFrame(ROWS, "id long, title string, text string"), F.col("id"), F.col("title"), F.col("text"), F.col("id").cast("string")).repartition(3)
    asked = search.parsed(search.query_table(spark, MORE))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*search.HIT).collect())
    for by in (search.WIKI, search.KB_TITLE, search.KB_BODY):
        want = rows(search.search(docs, asked, by))
        assert len(want) > 5000 and rows(many.search_many(docs, asked, by)) == want
    assert rows(many.search_many(docs, asked, characters=2000)) == rows(search.search(docs, asked))
    assert rows(many.search_many(docs, asked.where("false"))) == [] and rows(many.search_many(docs.where("false"), asked)) == []
