"""Each operator against its plain version, over odd rows: nulls, empty and long texts, ties, repeated rows, clashing names."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import bpe, components, disclosure, html_text, line_dedup, mixing, multi_index, ngram_join, ppm, quality, substring_dedup

from . import brute

rng = random.Random(7)
VOCAB = ["Alpha", "beta", "gamma,", "delta", "épsilon", "ζeta", "eta", "theta", "iota-", "kappa"] + [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE, PASSAGE, LINE = prose(120), prose(45), "This Line is Shared by many documents"


def changed(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


TEXTS = [None, "", " \n\t ", "one", "two words", "same five words in here", "same five words in here", BASE, BASE, BASE.upper()]
TEXTS += [changed(BASE, k) for k in (1, 2, 3, 5, 12, 30)] + [prose(30) + " " + PASSAGE + " " + prose(30) for _ in range(3)] + [PASSAGE, PASSAGE + "\n" + PASSAGE]
TEXTS += [f"{prose(25)}\n{LINE}\n{prose(10)}", f"  {LINE.upper()}\t\n{prose(25)}", f"{LINE}\n{LINE}\n{prose(22)}", "\n\n" + LINE + "\n", "short\nshort\nshort"]
TEXTS += [prose(8) + " " + " ".join(["again and again we say it twice here"] * 6), "### *** $$$ " * 20, "SHOUT LOUD " * 15, prose(3000), "x" * 50_000, "a b " * 3000, "   b c"]
DOCS = dict(enumerate(TEXTS))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", None if i % 7 == 3 else f"s{min(i, 4)}", 0, "x", "y", 1) for i, t in DOCS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


BY_ID = {i * 3: t for i, t in DOCS.items()}


def test_html():
    v = html_text.visible_text
    assert v("") == "" and v("plain &amp; text") == "plain & text"
    assert v("<p>one<p>two<br>three<div>four</div>five") == "one\n\ntwo\nthree\n\nfour\nfive"
    assert v("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z") == "- a\n- b\n  3. x\n  4. y\n\nz"
    assert v("<table><tr><th>Name<th>Q<tr><td>longer name<td>2<tr><td colspan=2>all</table>") == "Name         Q\nlonger name  2\nall"
    assert v("<table><tr><td>a<table><tr><td>in<td>side</table></table>") == "a in  side"
    assert v("a<script>var t='</p>'</script><style>b</style><p hidden>c</p><p style='display: none'>d</p>e") == "ae"
    assert v("<head><title>t</title></head><body>x") == "x"
    assert v("<pre>a  b\n c</pre>") == "a  b\n c"
    assert v("a <b>b</b>c <i>d</i>") == "a bc d" and v("<!-- x -->a<!doctype html>b<unknown>c</unknown>") == "abc"
    assert v("<div>" * 5000 + "deep") == "deep" and v("<a href=\"unclosed") == ""
    assert v("<li>lone") == "- lone" and v("</p></ul>x</table>") == "x"


def test_html_hidden_by_name_alone():
    v = html_text.visible_text
    for shown in ('class="hidden md:block"', 'title="the hidden cost"', 'aria-label="Show hidden files"', "data-style='display:none'", 'title="style=display:none"', 'style="--x-display: none"', "hidden-x", 'class="a/hidden"'):
        assert v(f"<body {shown}>a<p>b") == "a\n\nb", shown
    for unseen in ("hidden", "HIDDEN=''", "class=a hidden", 'class="a"hidden', "style=display:none", 'style="color:red; Display : NONE !important"', "style='visibility:hidden'", 'style="display/* x */:none"', 'style="display&#58;none"'):
        assert v(f"a<i {unseen}>b</i>c") == "ac", unseen
    assert v("<table><tr><td data-colspan=2>a<td>b<tr><td>c<td>d</table><ol data-start=5><li>x</ol>") == "a  b\nc  d\n\n1. x"


def test_html_shown_by_browsers():
    v = html_text.visible_text
    assert v("<p>x <math><semantics><mi>a</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>a=2</annotation></semantics></math> y") == "x a=2 y"
    assert v("a<svg><title>t</title>n<defs><text>d</text></defs><style/><text>One<tspan> two</tspan></text><text>three</text><path d='M0'/></svg>b") == "a One two three b"
    assert v("<svg><foreignObject><p>in</p></foreignObject></svg>") == "in"
    assert v("<p>Pick <select><optgroup label=G><option>a<option label=B value=2>b</select> now</p>") == "Pick\nG\na\nB\nnow"
    assert v("<p>x <object data=f><param name=a><em>fall</em>back</object> y") == "x fallback y"
    assert v("<p>x<object><p>in</p></object>y</p>z") == "x\n\nin\n\ny\n\nz"
    assert v("a<xmp><b>&amp;  c</b>\n d</xmp>e") == "a\n\n<b>&amp;  c</b>\n d\n\ne"
    assert v("a<plaintext><b> c</plaintext>") == "a\n\n<b> c</plaintext>"
    assert v("<map><p>m</p><area></map>") == "m"
    assert v("a<datalist><option>d</datalist><canvas>c</canvas><noscript>n</noscript>b") == "ab"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "k"), (2, None, None, "k"), (2, None, "", "k")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(pages).collect()) == [(1, "a"), (2, ""), (2, "")]
    assert html_text.extract(pages.where("false")).collect() == []


def test_pii(spark):
    texts = [None, "", "a@b.c_d@e.f and é x.y+z@mail.example.com, 1.2.3.4.5.6.7.8 999.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +49 (30) 1234-567. +1 2", "😀 +4915112345678 10.0.0.255x"]
    texts += ["1." * 3000 + "1", "a." * 3000 + "@x.y", "1 2" * 2000, "+1" + "-" * 3000, "000255.0.0.1 00001.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in disclosure.sanitise(df).select("doc_id", disclosure.written(F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(brute.pii(t)), texts[i]
    assert disclosure.sanitise(df.where("false")).collect() == []


def test_disclosing_terms(spark):
    told = [f"{prose(15)} Zanzibar owner joe@x.example writes {prose(15)}" for _ in range(6)]
    filler = [f"{prose(30)} writes {prose(10)} owner" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(told + filler)), "doc_id long, text string")
    rows = {r.doc_id: r for r in disclosure.sanitise(df).collect()}
    for i in range(6):
        assert [x.value for x in rows[i].extra if x.kind == "removed"] == ["zanzibar"]
        assert "[email]" in rows[i].sanitised and "Zanzibar" not in rows[i].sanitised
        assert all(told[i][x.start : x.end].strip(",-").lower().startswith(x.value) for x in rows[i].extra)
    assert not any(rows[i].extra or rows[i].sanitised for i in range(6, 46))


def test_disclosing_terms_of_rare_entities(spark):
    long = " ".join(c * 60 for c in "abcde")
    told = [f"{prose(20)} Quuxville {long} lone@x.example {long} Xyzzy\n{prose(20)}", "a@b.example,a@b.example x", f"é😀 Plugh +4915112345678 {prose(9)}"]
    filler = [f"{prose(50)} {long}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(told + filler)), "doc_id long, text string")
    rows = {r.doc_id: r for r in disclosure.sanitise(df).collect()}
    for i, terms in ((0, ["quuxville", "xyzzy"]), (2, ["plugh"])):
        found = [x for x in rows[i].extra if x.value in terms]
        assert [told[i][x.start : x.end].lower() for x in found] == terms
        assert not any(t in rows[i].sanitised.lower() for t in terms)
    assert not any(x.value == "a" * 60 for x in rows[0].extra)  # it stands everywhere
    alone = spark.createDataFrame([(1, "a@b.example,a@b.example x")], "doc_id long, text string")
    assert disclosure.sanitise(alone).first().extra == []


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 16))
    x[10:60] = x[0] + g.normal(scale=0.08, size=(50, 16))
    x[60:70] = x[1] * np.arange(1, 11)[:, None]
    x[70:100] = x[2]
    return x


@pytest.mark.parametrize("block", [2048, 7])
def test_embeddings(spark, vectors, block):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [1.0, None] + [0.0] * 14), (903, [float("nan")] * 16), (904, [float("inf")] + [0.0] * 15), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r.vec_id: r for r in multi_index.near_duplicates(df, index=multi_index.Index(centroids=6, block=block)).collect()}
    assert len(got) == len(rows)
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    root = brute.roots(range(300), zip(*np.nonzero(linked), strict=True))
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), root[i], root[i] == i)
    for i in range(900, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert multi_index.near_duplicates(df.where("false")).collect() == []


def test_multi_sequence_order():
    g = np.random.default_rng(1)
    a, b = g.random(9), g.random(7)
    cells = list(multi_index.visits(a, b, 0.9))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells) == (a[:, None] + b[None] <= 0.9).sum()


@pytest.mark.parametrize("order", [0, 2, 5])
def test_ppm_orders(spark, order):
    texts = ["abracadabra", "Banana", "", None, "the cat sat on the mat", "é à"] * 2 + ["abracad", "zebra", "", "the band" * 200, "é?", None, "\x00\x7f"]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert any(held) and not all(held)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in ppm.score(df, order).collect()}
    want = brute.ppm([t for t, h in zip(texts, held, strict=True) if not h], texts, order)
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-6)
    grams = ppm.gram_scores(df, ppm.is_training(F.col("doc_id")), order)
    assert grams.where("worth > 0 or worth is null or isnan(worth)").count() == 0


def test_ppm_scores(docs, empty):
    got = {r.doc_id: r for r in ppm.score(docs, order=3).collect()}
    tokens = lambda t: brute.words(t, True) + ["\n"]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in BY_ID}
    count = Counter(w for i, t in BY_ID.items() if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = dict(zip(BY_ID, brute.ppm([t for i, t in BY_ID.items() if not held[i]], BY_ID.values(), 3), strict=True))
    for i, t in BY_ID.items():
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, want[i], rel_tol=1e-5)
    assert ppm.score(empty).collect() == []


def test_bpe(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["a  b", " a b ", "a\n\nb \n c", "x<|endoftext|>y", "a <|endoftext|> b  <|endoftext|>", "don't we'll 123 4!!\t\ta", "a\r\nb", "\x1c a b\x85 c", "😀 ok 😀", "a\x00b c", "日本 語"]
    odd += [f"a{chr(c)}b {chr(c)} c" for c in (0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0xFEFF)]
    for df, texts in ((docs, BY_ID), (spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), dict(enumerate(odd)))):
        got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path), path).collect()}
        assert len(got) == len(texts)
        for i, x in texts.items():
            ids = t.encode(x or "", add_special_tokens=False).ids
            assert list(got[i].ids) == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False) == (x or "")
    assert bpe.decode(bpe.encode(empty, path), path).collect() == []


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = {i: len(brute.words(t)) for i, t in BY_ID.items()}
    assert {r.doc_id: r["size"] for r in rows} == size
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    names = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(r["size"] for r in rs) for s, rs in sources.items()}
    capped, target = set(), {}
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * total[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    for s, rs in sources.items():
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) and r.source_size == total[s] and r.taken == r["size"] * r.copies and 0 <= r.copies <= 2 for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= max(r["size"] for r in rs) / 2 + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken = Counter(r.doc_id for r in mixing.apply_mix(docs).collect())
    assert taken == Counter({r.doc_id: r.copies for r in rows if r.copies}) and mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(empty).collect() == []


def test_targets_of_many_sources(spark):
    size = {f"s{i:04d}": i * 7919 % 1000 + 1 for i in range(3000)}
    names = sorted(size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, share, level = 1.5 * sum(size.values()), sum(weight.values()), 0.0
    for s in sorted(names, key=lambda s: 2 * size[s] / weight[s]):
        level = left / share
        if 2 * size[s] > level * weight[s]:
            break
        left, share = left - 2 * size[s], share - weight[s]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long"), (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    assert len(got) == 3000 and all(got[s].weight == weight[s] and math.isclose(got[s].target, min(2 * size[s], level * weight[s]), rel_tol=1e-12) for s in names)


def test_mixing_ties(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(None, "a", None), (2, None, None)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 6 and len({r.copies for r in rows if r.doc_id == 1}) == 1


def test_lines_in_many_batches(spark):
    long, rare = "a line that very many documents have", "a line that some of the documents have"
    texts = {i: "\n".join([long] * (1 + i % 2) + [rare] * (i % 3 == 0) + [f"a line of document {i} alone {i}"]) for i in range(700)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute.drop_lines(texts)


def test_lines(spark, docs, empty):
    want = brute.drop_lines(BY_ID)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.drop_repeated(docs).collect()}
    assert got == want and any(x[1] for x in want.values())
    assert line_dedup.drop_repeated(empty).collect() == []
    hot = {i: f"{LINE}\nown line of document number {i} here\n{LINE if i % 2 else ''}" for i in range(300)}
    df = spark.createDataFrame(list(hot.items()), "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated(df).collect()} == brute.drop_lines(hot)
    twice = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE), (None, LINE)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.drop_repeated(twice).collect())  # two documents, not three


def test_ngram_join(spark, docs, empty):
    want = brute.ngram_groups(BY_ID)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()} == want
    assert len({c for _, c in want.values()}) < len(want)
    assert ngram_join.groups(empty).collect() == []
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_ngram_join_chains(spark):
    """Groups without a centre, at the threshold, of differing lengths, and repeated rows."""
    base = prose(60).split(" ")
    texts = {k: " ".join(base[k : k + 40]) for k in range(0, 20)}
    texts |= {100 + k: " ".join(base[:30] + [f"u{k}x{j}" for j in range(k)]) for k in range(12)}
    texts |= {200 + k: changed(BASE, k % 9) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()) + [(0, texts[0])], "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df).collect()} == brute.ngram_groups(texts)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (7, None)]
    df = spark.createDataFrame(links, "a long, b long")
    want = brute.roots(range(140), [(a, b) for a, b in links if b is not None])
    assert {r.node: r.component for r in components.components(df).collect()} == {n: want[n] for n in [*range(31), *range(100, 140)]}
    assert components.components(df.where("false")).collect() == []


def test_quality(docs, empty):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs).collect()}
    assert got == {i: brute.quality(t) for i, t in BY_ID.items()}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in BY_ID.items() if brute.quality(t)[-1]}
    assert quality.judge(empty).collect() == [] and quality.order_rules(empty)[0] == "few_words" and len(set(quality.order_rules(docs))) == 7


def test_substrings(spark, docs, empty):
    want = brute.remove_repeats(BY_ID)
    rows = substring_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == want and any(x[1] for x in want.values())
    for r in rows:
        assert sum(x.length for x in r.intervals) == r.n_removed
        assert all(a.start + a.length < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False))
    assert substring_dedup.remove_repeats(empty).collect() == []
    twice = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.remove_repeats(twice).collect()) == [0, 45, 45]




def test_ppm_keeps_all_grams(spark):
    """More contexts times symbols than any fixed table holds; rare grams count as seen."""
    r = random.Random(3)
    symbols = [chr(c) for c in range(1, 128) if not chr(c).isupper()]
    texts = ["".join(r.choices(symbols, k=8_000)) for _ in range(6)]
    rows = dict(enumerate([*texts, texts[0][:300], "the rest"], 1))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    train = [t for i, t in rows.items() if not held[i]]
    contexts = {t[max(0, i - k) : i] for t in train for i in range(len(t)) for k in range(6)}
    assert len(contexts) * len(symbols) > 12_000_000
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {x.doc_id: x.score for x in ppm.score(df).collect()}
    assert np.allclose([got[i] for i in rows], brute.ppm(train, rows.values(), 5), rtol=1e-5)


def test_html_tables_and_lists():
    v = html_text.visible_text
    assert v("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert v("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "a  b  c\nd     e\nf     g"
    assert v("<table><tr><td colspan=1000>a<td>b</table>") == "a  b"
    assert v("<ol><li>x<li value=5>y<li>z</ol>") == "1. x\n5. y\n6. z"
    wide = v("<table><tr><td>k<td>v<tr><td>" + "w" * 500 + "<td>q</table>")
    assert wide == "k  v\n" + "w" * 500 + "  q"


def test_html_output_is_bounded():
    for page in ("<table>" + "<tr><td>k<td>v" * 2000 + "<tr><td>" + "w " * 50_000 + "<td>q</table>", "<table><tr>" + "<td colspan=999>a" * 5000 + "</table>", "<ul><li>a" * 3000, "<blockquote>a" * 3000):
        text = html_text.visible_text(page)
        assert len(text) <= 16 * len(page)
        marks = brute.visible_words(page)
        assert sum((Counter(text.split()) - marks).values()) == Counter(text.split())["-"]


def test_mentions_of_a_long_text(spark):
    """A text with 20,000 mentions beside ordinary ones; overlapping spans are replaced as one."""
    long = " ".join(f"word{i % 97} m{i}@x.example said" for i in range(20_000))
    both = "call +4111 1111 1111 1111 now"
    df = spark.createDataFrame([(1, long), (2, both), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in disclosure.sanitise(df).collect()}
    assert len(got[1].base) == 20_000 and got[1].sanitised.count("[email]") == 20_000 and "@" not in got[1].sanitised
    assert disclosure_spans(got[2]) == brute.pii(both) and not any(c.isdigit() for c in got[2].sanitised)
    assert got[3].base == [] and got[3].sanitised is None


def disclosure_spans(row):
    return [f"{x.kind}:{x.start}:{x.end}" for x in row.base]


def test_disclosing_terms_against_the_plain_version(spark):
    r = random.Random(5)
    words_of = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    people = [f"{n}@x.example" for n in ("ann", "bob", "eve")] + ["+4915112345678", "10.0.0.1"]
    texts = [f"{words_of(12)} ({r.choice(people)}), Name{k % 5} {words_of(9)}\n{r.choice(people)} _x_ {words_of(4)}" for k in range(60)] + [words_of(80) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute.disclosing(dict(enumerate(texts)))
    got = {x.doc_id: [(e.kind, e.start, e.end) for e in sorted(x.extra, key=lambda e: e.start)] for x in disclosure.sanitise(df).collect()}
    assert want and got == {i: want.get(i, []) for i in range(len(texts))}


def test_extreme_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [5e-324, 0.0]), (6, [0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6)}


def test_rejected_documents_skip_dearer_rules(spark):
    t, raised = F.col("t"), F.raise_error(F.lit("read")).cast("long")
    f = quality.features(t, quality.words(t)) | {"n_distinct": raised}
    order = ["few_words", "few_distinct", *(k for k in quality.rules(f) if k not in ("few_words", "few_distinct"))]
    short, whole = spark.createDataFrame([("one two",), ("",)], "t string"), spark.createDataFrame([(prose(50),)], "t string")
    assert [r.k for r in short.select(quality.cascade(order, f).alias("k")).collect()] == [False, False]
    with pytest.raises(Exception, match="read"):
        whole.select(quality.cascade(order, f)).collect()


CLASHING = "_id _tag _tag2 _gone _keep _new _own _hash _copy _row _text _matches own tag keep new gone id_b text_b h n m band home component key set_key n_lines n_dropped kept base_failed n_words decoded ids size copies start end kind value t ws".split()


def test_clashing_names(spark, docs):
    """Columns named like an operator's own come back as they were."""
    wide = docs.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])

    def same(out, columns):
        assert out.columns == columns
        for r in out.collect():
            assert all(r[c] == f"{c}:{r.doc_id}" for c in CLASHING if c in columns), r

    same(line_dedup.drop_repeated(wide, counts=False), wide.columns)
    counted = line_dedup.drop_repeated(wide)
    assert counted.columns == [c for c in wide.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    want = brute.drop_lines(BY_ID)
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in counted.collect()} == {i: x[:2] for i, x in want.items()}
    same(ngram_join.keep_first(wide), wide.columns)
    same(quality.keep_good(wide), wide.columns)
    same(mixing.apply_mix(wide), wide.columns)
    judged = quality.judge(wide).collect()
    assert {r.doc_id: r.kept for r in judged} == {i: brute.quality(t)[-1] for i, t in BY_ID.items()}
    assert all(r._own == f"_own:{r.doc_id}" for r in judged)
    assert len(disclosure.sanitise(wide).collect()) == len(ppm.score(wide, order=1).collect()) == len(substring_dedup.remove_repeats(wide).collect()) == len(BY_ID)


def test_null_ids_and_repeated_rows(spark):
    """Rows without an id, and rows that stand twice, in every operator on documents."""
    P = pytest.importorskip("public_tokenizers")
    rows = [(None, BASE), (None, BASE), (1, BASE), (1, BASE), (2, None), (None, None), (3, f"{prose(30)} a@b.example")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    path = P.path("byte_bpe_50k.json")
    runs = [ppm.score(df, order=2), substring_dedup.remove_repeats(df), ngram_join.groups(df), bpe.decode(bpe.encode(df, path), path), disclosure.sanitise(df), quality.judge(df), mixing.mix(df), line_dedup.drop_repeated(df)]
    for out in runs:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((i is None, i or 0) for i, _ in rows)
    assert {r.component_id for r in ngram_join.groups(df).where("n_shingles > 100").collect()} == {1}
    for none in (ngram_join.keep_first, line_dedup.drop_repeated, mixing.apply_mix, quality.keep_good):
        assert none(df.where("false")).collect() == []

