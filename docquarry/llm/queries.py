"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, disclosure, divergence, html_text, lexical_search, line_dedup, mixing, multi_index, ngram_join, ppm, quality, substring_dedup, url_filter
from .base import documents


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.sanitise(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    base, extra = disclosure.written(F.col("base")), disclosure.written(F.col("extra"))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in disclosure.KINDS],
        F.size("base").cast("long").alias("n_found"),
        F.sha2(base, 256).alias("base_sha256"),
        F.when(F.size("extra") == 0, base).otherwise(F.concat_ws(",", base, extra)).alias("spans"),
        count_extra("general").alias("n_general"),
        count_extra("removed").alias("n_removed"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


def count_extra(kind: str):
    return F.size(F.filter("extra", lambda s: s["kind"] == kind)).cast("long")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT l.a, reach.seen FROM reach JOIN l ON l.b = reach.node),
m AS (SELECT node AS vec_id, min(seen) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m
"""


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir), vocabulary()), vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (
  SELECT *, greatest(0.0::DOUBLE, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT *, (SELECT arg_min(level, (cap / weight, rk)) FROM l WHERE cap > level * weight) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight OR final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS need,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(CASE WHEN upto >= need THEN h END) AS edge, max(h) AS last FROM c GROUP BY source),
g AS (
  SELECT c.*, coalesce(e.edge, e.last) AS edge, sum(CASE WHEN h = coalesce(e.edge, e.last) THEN size ELSE 0 END) OVER (PARTITION BY c.source) AS edge_size,
         max(CASE WHEN h = coalesce(e.edge, e.last) THEN upto END) OVER (PARTITION BY c.source) AS edge_upto
  FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN need > 0 AND passes < 2 AND (h < edge OR (h = edge AND (need - edge_upto + edge_size) * 2 >= edge_size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g
"""


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(documents(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT u.a, reach.seen FROM reach JOIN u ON u.b = reach.node),
m AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
winh AS (SELECT win.r, i, array_to_string(w[i:i + 7], ' ') AS s FROM win JOIN d USING (r)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM winh) WHERE n > 1),
rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
f AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper, len(ls)::BIGINT AS n_lines,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_distinct(w))::BIGINT AS n_distinct
  FROM d LEFT JOIN rep ON d.r = rep.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * n_upper > 50 * word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_distinct < 5 * least(n_words, 1000)) AS kept
FROM f
"""


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
s AS (SELECT win.doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM win JOIN d ON d.doc_id = win.doc_id),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (
  SELECT words.doc_id, words.i, word,
         count(rep.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN rep ON rep.doc_id = words.doc_id AND rep.i = words.i),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept ON o.lang = kept.lang AND o.term = kept.term GROUP BY ALL),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.n, 0) + 2 * ln.v) AS p,
         1 + (1000000000::HUGEINT * (kept.n + 2)) // (ln.n + 2 * ln.v) AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN ln ON ln.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "words", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
it AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
t AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
o AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM o WHERE term IN (SELECT term FROM it) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM t) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
m AS (SELECT tf.*, w, 25 + (75 * tf.n * t.n) // t.l AS m FROM tf JOIN df ON tf.term = df.term CROSS JOIN t),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM it JOIN m ON it.term = m.term GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""


def queries() -> dict:
    found = [
        op1_html_text, op2_disclosure, op3_embeddings, op4_ppm, op5_bpe, op6_mixing, op7_lines, op8_ngram_join, op9_quality, op10_substrings, op11_divergence, op12_urls, op13_search,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embeddings": OP3_SQL, "op6_mixing": OP6_SQL, "op7_lines": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_quality": OP9_SQL, "op10_substrings": OP10_SQL, "op11_divergence": OP11_SQL,
        "op13_search": OP13_SQL,
    }
