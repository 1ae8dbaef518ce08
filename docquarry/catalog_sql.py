"""The catalogue's queries in DuckDB's SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations


def normal(x: str) -> str:
    """normalize_space and lower case. No text of the tables changes under NFKC."""
    one = f"regexp_replace(replace(coalesce({x}, ''), chr(160), ' '), '[ \\t]+', ' ', 'g')"
    return f"lower(regexp_replace(regexp_replace({one}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))"


def entities(x: str) -> str:
    for a, b in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'")):
        x = f"regexp_replace({x}, '{a}', {b}, 'gi')"
    return x


def cleaned(x: str) -> str:
    return f"trim({entities(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")})"


def element(x: str, name: str) -> str:
    return f"regexp_extract({x}, '<{name}[^>]*>([\\s\\S]*?)</{name}>', 1, 'i')"


def body_source(x: str) -> str:
    for name in ("script", "style", "noscript", "svg", "header", "footer", "nav"):
        x = f"regexp_replace({x}, '<{name}[\\s\\S]*?</{name}>', ' ', 'gi')"
    return x


#: Pages with title and body. Every page of the tables has a usable h1, so other headings aren't tried here.
PAGE = f"""
page0 AS (SELECT *, {body_source("html")} AS src FROM pages),
page1 AS (SELECT page_id, url, {cleaned(element("html", "h1"))} AS title, {cleaned(element("src", "article"))} AS art, {cleaned("src")} AS everything FROM page0),
page AS (SELECT page_id, url, title, CASE WHEN length(art) >= 200 THEN art ELSE everything END AS body FROM page1)"""
DOCS = f"""
d0 AS (SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS text FROM documents),
d AS (SELECT id, title, {normal("title")} AS tn, {normal("text")} AS bn FROM d0)"""
KB = f"""{PAGE},
k AS (SELECT url AS id, page_id::VARCHAR AS number, title, {normal("title")} AS tn, {normal("body")} AS bn FROM page)"""


def has(x: str, term: str) -> str:
    return f"contains({x}, '{term}')"


def n(condition: str, points: int) -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE 0 END"


def phrase(q: str, title: int, body: int) -> str:
    return f"{n(has('tn', q), title)} + {n(has('bn', q), body)}"


def group(terms: list[str], title: int, body: int, each: int) -> str:
    return " + ".join([f"{n(has('tn', t), title)} + {n(has('bn', t), body)}" for t in terms] + [str(each * len(terms))])


def all_of(terms: list[str], whole: str = "(tn || chr(10) || bn)") -> str:
    return "(" + " AND ".join(has(whole, t) for t in terms) + ")"


def any_in(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(has(x, t) for t in terms) + ")"


def boolean(groups: list[list[str]], title: int, body: int, each: int, whole: str = "(tn || chr(10) || bn)") -> str:
    """Score, flags and terms of the first group that matches, as CASE expressions."""
    case = lambda f: "CASE " + " ".join(f"WHEN {all_of(g, whole)} THEN {f(g)}" for g in groups) + " END"
    return f"({case(lambda g: group(g, title, body, each))})::INTEGER AS score, {case(lambda g: any_in('tn', g))} AS title_match, {case(lambda g: any_in('bn', g))} AS body_match, {case(lambda g: repr(','.join(g)))} AS terms"


SHOWN = "id, title, score::INTEGER AS score, title_match, body_match"
_TOKEN_HIT = " + ".join(f"CASE WHEN {has('tn', t)} THEN 400 WHEN {has('bn', t)} THEN 150 ELSE 0 END" for t in ("the", "license"))
_TITLE_WORDS = " + ".join(n(has("tn", t), 1) for t in ("the", "license"))
_BODY_WORDS = " + ".join(n(has("bn", t), 1) for t in ("the", "license"))
_BATCH = ((1, [["of the"]]), (2, [["with", "and"]]), (3, [["license"]]), (4, [["the"], ["der"]]), (5, [["on the"]]))


#: The same and some more: an id, a word of two letters, a rare phrase, and an alternative that no text has.
_WIDE_BATCH = (*_BATCH, (6, [["42", "the"]]), (7, [["of"]]), (8, [["license of the"]]), (9, [["on"], ["no such words"]]))


def _hits(table: str, source: str, kind: str, batch: tuple = _BATCH) -> str:
    """All hits of the batch by one ranker: wiki, title or body."""
    p = {"wiki": (2400, 1600, 1200, 700, 250), "title": (2200, 1200, 900, 450, 300), "body": (0, 1600, 500, 900, 300)}[kind]
    parts = []
    for i, groups in batch:
        if i in (2, 4, 6, 9):  # Boolean
            whole = "(tn || chr(10) || bn || chr(10) || number)" if kind == "title" else "(tn || chr(10) || bn)"
            score = f"SELECT {i} AS query_id, id, title, {boolean(groups, *p[2:], whole)} FROM {table}"
        else:
            q, words = groups[0][0], groups[0][0].split(" ")
            t, b = has("tn", q), has("bn", q)
            if kind == "title":
                token = " + ".join(f"CASE WHEN {has('tn', w)} THEN 400 WHEN {has('bn', w)} THEN 150 ELSE 0 END" for w in words)
                title_word = any_in("tn", words)
                body_word = "(" + " OR ".join(f"(NOT {has('tn', w)} AND {has('bn', w)})" for w in words) + ")"
                phrase_hit = f"({t} OR {b})"
                score = f"SELECT {i} AS query_id, id, title, nullif(CASE WHEN {phrase_hit} THEN {phrase(q, p[0], p[1])} ELSE {token} END, 0)::INTEGER AS score, CASE WHEN {phrase_hit} THEN {t} ELSE {title_word} END AS title_match, CASE WHEN {phrase_hit} THEN {b} ELSE {body_word} END AS body_match, '' AS terms FROM {table}"
            else:
                score = f"SELECT {i} AS query_id, id, title, nullif({phrase(q, p[0], p[1])}, 0)::INTEGER AS score, {t} AS title_match, {b} AS body_match, '' AS terms FROM {table}"
        parts.append(score)
    flags = "false AS title_match, true AS body_match" if kind == "body" else "title_match, body_match"
    return f"SELECT query_id, id::VARCHAR AS id, title, score, {flags}, '{source}' AS source FROM ({' UNION ALL '.join(parts)}) WHERE score IS NOT NULL"


_LASTMOD = "CASE WHEN page_id % 11 <> 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END"
_SHIFTED = "CASE WHEN page_id % 11 <> 0 THEN CASE WHEN page_id % 5 = 0 THEN '2024-02-01' ELSE '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END END"
INDEX = f"idx AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN url || '/earlier' ELSE url END AS url, {_LASTMOD} AS source_lastmod, page_id::VARCHAR AS article_id, 'title ' || page_id AS title FROM pages)"
ITEMS = f"items AS (SELECT page_id, url, {_SHIFTED} AS lastmod FROM pages UNION ALL SELECT page_id, url || '/missing', {_SHIFTED} FROM pages WHERE page_id % 13 = 0)"
CHANGES = f"""{INDEX}, {ITEMS},
ch AS (
  SELECT coalesce(i.url, x.url) AS url, i.lastmod, CASE WHEN i.url IS NULL THEN x.article_id END AS article_id,
         CASE WHEN x.url IS NULL THEN 'new' WHEN i.url IS NULL THEN 'removed' WHEN i.lastmod <> x.source_lastmod THEN 'lastmod' END AS reason
  FROM items i FULL JOIN idx x ON i.url = x.url)"""
_LOCALIZED = r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]"
_URL_OK = f"NOT regexp_matches(url_decode(url), '{_LOCALIZED}')"
SCRIPTED = f"""{PAGE},
s AS (SELECT page_id, CASE WHEN page_id % 7 = 3 THEN 'https://knowledge.example.com/%EA%B0%80' ELSE url END AS url, title || CASE WHEN page_id % 7 = 2 THEN 'д' ELSE '' END AS title,
             body || CASE page_id % 7 WHEN 0 THEN repeat('가', length(body)) WHEN 1 THEN repeat('д', 6) ELSE '' END AS body FROM page)"""


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _gate(read: str, reject: tuple, latin: bool = True) -> str:
    a, b = _count(read, "[A-Za-z]"), _count(read, _LOCALIZED)
    bad = [f"({b} >= {k} AND {b} >= {share} * ({a} + {b}))" for k, share in reject]
    if latin:
        bad.append(f"({a} + {b} >= 80 AND {a} < 0.85 * ({a} + {b}))")
    return f"({a} + {b} = 0 OR NOT ({' OR '.join(bad)}))"


_TITLE_OK = f"(title <> '' AND NOT regexp_matches(title, '%[0-9A-Fa-f]{{2}}') AND NOT regexp_matches(title, '{_LOCALIZED}'))"
_TB = "substr(regexp_replace(title || chr(10) || substr(body, 1, 8000), 'https?://\\S+', ' ', 'g'), 1, 8000)"
_RECORD = "substr(regexp_replace(regexp_replace(title || chr(10) || substr(body, 1, 6000), 'https?://\\S+', ' ', 'g'), '\\b[A-Fa-f0-9]{16,}\\b', ' ', 'g'), 1, 8000)"
_BY_TITLE = f"({_TITLE_OK} AND {_gate(_TB, ((12, 0.08), (5, 0.2)))})"
_BY_BODY = f"({_TITLE_OK} AND {_gate('substr(body, 1, 8000)', ((12, 0.08),))})"

#: The same over whole texts.
_WHOLE = "regexp_replace(title || chr(10) || body, 'https?://\\S+', ' ', 'g')"
_WHOLE_BY_TITLE = f"({_TITLE_OK} AND {_gate(_WHOLE, ((12, 0.08), (5, 0.2)))})"
_WHOLE_BY_BODY = f"({_TITLE_OK} AND {_gate('body', ((12, 0.08),))})"
_LEGACY = f"({_TITLE_OK} AND {_gate(f"regexp_replace({_WHOLE}, '\\b[A-Fa-f0-9]{{16,}}\\b', ' ', 'g')", ((12, 0.08), (5, 0.2)))})"


def _built(by_title: str, by_body: str, text: str) -> str:
    """What a build makes of each planned url."""
    return f"""{ITEMS}, {PAGE},
built AS (
  SELECT i.url, CASE WHEN p.url IS NULL THEN 'failed' WHEN {by_title} THEN 'english' ELSE 'skipped' END AS outcome, p.title, i.lastmod AS source_lastmod,
         length({text})::INTEGER AS text_length, coalesce({by_title} AND {by_body}, false) AS in_bodies
  FROM items i LEFT JOIN page p ON i.url = p.url)"""


BUILT = _built(_BY_TITLE, _BY_BODY, "substr(p.body, 1, 4000)")


#: The last item and page of each url, where every third stands twice.
_AGAIN = f"again AS (SELECT page_id, url, title, body, CASE WHEN page_id % 3 = 0 THEN '2023-12-31' ELSE {_SHIFTED} END AS lastmod FROM page)"


#: Bits of the sketches: four groups of four hex digits of a token's MD5.
_BITS = """t AS (SELECT (number::INTEGER % 16) AS chunk_no, unnest(list_filter(regexp_split_to_array(tn || chr(10) || bn, '[^a-z0-9._+-]+'), lambda x: length(x) BETWEEN 2 AND 64)) AS token FROM k),
bits AS (SELECT DISTINCT chunk_no, ('0x' || substr(md5(token), 4 * i::INTEGER + 1, 4))::INTEGER AS bit FROM (SELECT DISTINCT chunk_no, token FROM t), range(4) r(i))"""


def _holding(words: list[str]) -> str:
    """good: the chunks that have all bits of the words."""
    asked = ", ".join(f"('{w}')" for w in words)
    return f"""w AS (SELECT DISTINCT ('0x' || substr(md5(w), 4 * i::INTEGER + 1, 4))::INTEGER AS bit FROM (VALUES {asked}) v(w), range(4) r(i)),
good AS (SELECT chunk_no FROM bits JOIN w ON bits.bit = w.bit GROUP BY chunk_no HAVING count(*) = (SELECT count(*) FROM w))"""


def snippet(text: str, found: str, q: str, before: int, after: int, fallback: str, token: str | None = None) -> str:
    at = f"CASE WHEN instr({found}, '{q}') > 0 THEN instr({found}, '{q}') - 1 {f'WHEN {token} > 0 THEN {token} - 1' if token else ''} END"
    a, b = f"greatest(0, ({at}) - {before})", f"least(length({text}), ({at}) + {max(1, len(q))} + {after})"
    return f"CASE WHEN ({at}) IS NULL THEN {fallback} ELSE CASE WHEN {a} > 0 THEN '…' ELSE '' END || substr({text}, ({a} + 1)::BIGINT, ({b} - {a})::BIGINT) || CASE WHEN {b} < length({text}) THEN '…' ELSE '' END END"


_TREE = """
RECURSIVE b AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn > 0 THEN turn - 1 END AS parent, text FROM conversations),
walk AS (
  SELECT conv_id, turn, 0 AS depth, [turn] AS path, text FROM b WHERE parent IS NULL
  UNION ALL SELECT b.conv_id, b.turn, depth + 1, list_append(path, b.turn), b.text FROM walk JOIN b ON b.conv_id = walk.conv_id AND b.parent = walk.turn WHERE depth < 5)"""
#: Sitemaps by name: their pages, and the sitemaps they name.
_MAPS = f"""
e AS (SELECT 'set' || (page_id // 100) AS m, url AS loc, {_LASTMOD} AS lastmod FROM pages UNION ALL SELECT 'bare' || (page_id // 10000), 'extra' || page_id, NULL FROM pages WHERE page_id % 50 = 0),
g AS (SELECT DISTINCT 'root' AS a, 'index' || (page_id // 10000) AS b FROM pages
      UNION SELECT 'index' || (page_id // 10000), 'set' || (page_id // 100) FROM pages
      UNION SELECT 'index' || (page_id // 10000), 'bare' || (page_id // 10000) FROM pages UNION SELECT 'index' || (page_id // 10000), 'root' FROM pages),
r AS (SELECT x AS root, x AS url, 0 AS level FROM (VALUES ('lonely'), ('root'), ('index0')) t(x) UNION SELECT r.root, g.b, r.level + 1 FROM r JOIN g ON g.a = r.url WHERE r.level < 4),
reach AS (SELECT root, url, min(level)::INTEGER AS level FROM r GROUP BY root, url),
found AS (SELECT root, loc AS url, max(lastmod) AS lastmod FROM e JOIN reach ON reach.url = e.m GROUP BY root, loc)"""
_RANKED = f"WITH {DOCS}, h AS ({_hits('d', 'wiki', 'wiki')})"
_BOTH = f"WITH {DOCS}, {KB}, h AS ({_hits('d', 'wiki', 'wiki')} UNION ALL {_hits('k', 'kb', 'title')})"
_ONE = f"WITH {DOCS}, h AS (SELECT id, title, {phrase('of the', 2400, 1600)} AS score FROM d WHERE {has('tn', 'of the')} OR {has('bn', 'of the')})"
#: Entries by index, then by the name of their map.
_NAMED = "e AS (SELECT page_id // 10000 AS i, 'set' || (page_id // 100) AS m, page_id, url AS loc FROM pages UNION ALL SELECT page_id // 10000, 'bare' || (page_id // 10000), page_id, 'extra' || page_id FROM pages WHERE page_id % 50 = 0)"
#: The plan of the sitemaps' root and what a build makes of it.
_FROM_MAPS = f"""{_MAPS}, {PAGE},
built AS (
  SELECT i.url, CASE WHEN p.url IS NULL THEN 'failed' WHEN {_BY_TITLE} THEN 'english' ELSE 'skipped' END AS outcome, p.title, i.lastmod AS source_lastmod,
         length(substr(p.body, 1, 4000))::INTEGER AS text_length, coalesce({_BY_TITLE} AND {_BY_BODY}, false) AS in_bodies
  FROM (SELECT * FROM found WHERE root = 'root') i LEFT JOIN page p ON i.url = p.url)"""
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def oracle_sql() -> dict[str, str]:
    phrase_hit = f"({has('tn', 'of the')} OR {has('bn', 'of the')})"
    words_phrase = f"({has('tn', 'the license')} OR {has('bn', 'the license')})"
    token_title, token_body = any_in("tn", ["the", "license"]), " OR ".join(f"(NOT {has('tn', t)} AND {has('bn', t)})" for t in ("the", "license"))
    groups3 = [["of", "the"], ["with", "and"], ["license"]]
    first = lambda f: "CASE " + " ".join(f"WHEN {all_of(g)} THEN {f(g)}" for g in groups3) + " END"
    source, low = _PLAIN, f"lower({_PLAIN})"
    flat = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
    token = f"CASE WHEN instr({low}, 'of') > 0 THEN instr({low}, 'of') WHEN instr({low}, 'the') > 0 THEN instr({low}, 'the') ELSE 0 END"
    cut220 = f"CASE WHEN length({source}) <= 220 THEN {source} ELSE substr({source}, 1, 208) || ' …(생략)' END"
    return {
        "phrase_search": f"WITH {DOCS} SELECT id, title, ({phrase('of the', 2400, 1600)})::INTEGER AS score, {has('tn', 'of the')} AS title_match, {has('bn', 'of the')} AS body_match FROM d WHERE {phrase_hit}",
        "boolean_search": f"WITH {DOCS} SELECT * FROM (SELECT id, title, {boolean([['with', 'license'], ['of', 'them']], 1200, 700, 250)} FROM d) WHERE score IS NOT NULL",
        "token_fallback_search": f"""WITH {DOCS} SELECT {SHOWN} FROM (SELECT id, title, CASE WHEN {words_phrase} THEN {phrase('the license', 2200, 1200)} ELSE {_TOKEN_HIT} END AS score,
            CASE WHEN {words_phrase} THEN {has('tn', 'the license')} ELSE {token_title} END AS title_match, CASE WHEN {words_phrase} THEN {has('bn', 'the license')} ELSE ({token_body}) END AS body_match FROM d) WHERE score > 0""",
        "id_boolean_search": f"WITH {DOCS} SELECT id, title, score, title_match, body_match FROM (SELECT id, title, {boolean([['42', 'the']], 900, 450, 300, '(tn || chr(10) || bn || chr(10) || id::VARCHAR)')} FROM d) WHERE score IS NOT NULL",
        "body_search": f"WITH {DOCS} SELECT id, title, 1600 AS score, false AS title_match, true AS body_match FROM d WHERE {has('bn', 'of the')}",
        "weighted_token_search": f"""WITH {DOCS}, w AS (SELECT *, {_TITLE_WORDS} AS t, {_BODY_WORDS} AS b FROM d)
            SELECT id, ({phrase('the license', 1500, 800)} + 250 * t + 80 * b + {n('t = 2', 500)} + {n('b = 2', 350)})::INTEGER AS score FROM w WHERE t + b > 0""",
        "multi_group_boolean_search": f"""WITH {DOCS} SELECT id, score::INTEGER AS score FROM (SELECT id, {first(lambda g: group(g, 700, 350, 400 if len(g) > 1 else 0))} + 100 * ({' + '.join(n(all_of(g), 1) for g in groups3)}) AS score FROM d) WHERE score IS NOT NULL""",
        "batch_search_topk": f"{_RANKED}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id::BIGINT) AS rank, id::BIGINT AS id, score FROM h) SELECT * FROM r WHERE rank <= 5",
        "bounded_topk": f"{_RANKED}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id::BIGINT) AS rank, id::BIGINT AS id, score FROM h) SELECT * FROM r WHERE rank <= 5",
        "many_queries": f"""WITH {DOCS}, q AS (SELECT item_id, lower(split_part(text, ' ', 3)) AS a, lower(split_part(text, ' ', 4)) AS b, lower(split_part(text, ' ', 5)) AS c, lower(split_part(text, ' ', 6)) AS e FROM benchmark),
            p AS (SELECT (item_id * 2)::INTEGER AS query_id, id, contains(tn, a || ' ' || b) AS t, contains(bn, a || ' ' || b) AS x FROM q, d),
            o AS (SELECT (item_id * 2 + 1)::INTEGER AS query_id, id, contains(tn, a) AS has_at, contains(bn, a) AS has_ab, contains(tn, c) AS has_ct, contains(bn, c) AS has_cb, contains(tn, e) AS has_et, contains(bn, e) AS has_eb FROM q, d)
            SELECT query_id, id, (2400 * t::INTEGER + 1600 * x::INTEGER)::INTEGER AS score, t AS title_match, x AS body_match FROM p WHERE t OR x
            UNION ALL SELECT query_id, id, CASE WHEN (has_at OR has_ab) AND (has_ct OR has_cb) THEN 500 + 1200 * (has_at::INTEGER + has_ct::INTEGER) + 700 * (has_ab::INTEGER + has_cb::INTEGER) ELSE 250 + 1200 * has_et::INTEGER + 700 * has_eb::INTEGER END::INTEGER,
                   CASE WHEN (has_at OR has_ab) AND (has_ct OR has_cb) THEN has_at OR has_ct ELSE has_et END, CASE WHEN (has_at OR has_ab) AND (has_ct OR has_cb) THEN has_ab OR has_cb ELSE has_eb END FROM o WHERE (has_at OR has_ab) AND (has_ct OR has_cb) OR has_et OR has_eb""",
        "search_page": f"{_ONE}, r AS (SELECT 1 AS query_id, row_number() OVER (ORDER BY score DESC, title, id) AS rank, id, score, count(*) OVER () AS total FROM h), p AS (SELECT *, greatest(1, ceil(total / 10.0))::INTEGER AS total_pages FROM r), s AS (SELECT *, least(2, total_pages) AS page FROM p) SELECT * FROM s WHERE rank > (page - 1) * 10 AND rank <= page * 10",
        "collated_page": f"{_ONE}, r AS (SELECT 1 AS query_id, row_number() OVER (ORDER BY score DESC, title COLLATE en, id) AS rank, id, score, count(*) OVER () AS total FROM h), s AS (SELECT *, least(2, greatest(1, ceil(total / 10.0)))::INTEGER AS page FROM r) SELECT * FROM s WHERE rank > (page - 1) * 10 AND rank <= page * 10",
        "korean_page": f"""{_ONE}, g AS (SELECT id, score, ['하늘 ', '', '가방 ', 'Zebra ', '나무 ', 'zebra ', '각도 '][id % 7 + 1] || title AS title FROM h),
            r AS (SELECT 1 AS query_id, row_number() OVER (ORDER BY score DESC, title COLLATE ko, id) AS rank, id, score, count(*) OVER () AS total FROM g), s AS (SELECT *, least(2, greatest(1, ceil(total / 20.0)))::INTEGER AS page FROM r) SELECT * FROM s WHERE rank > (page - 1) * 20 AND rank <= page * 20""",
        "wide_letters_search": f"""WITH w AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'abc guide ' ELSE '' END || coalesce(text, '') AS t FROM documents),
            d0 AS (SELECT id, split_part(t, chr(10), 1) AS title, t AS text FROM w), d AS (SELECT id, title, {normal("title")} AS tn, {normal("text")} AS bn FROM d0)
            SELECT 1 AS query_id, id, ({phrase('abc guide', 2400, 1600)})::INTEGER AS score, {has('tn', 'abc guide')} AS title_match, {has('bn', 'abc guide')} AS body_match FROM d WHERE {any_in('tn', ['abc guide'])} OR {any_in('bn', ['abc guide'])}
            UNION ALL SELECT 2, id, score, title_match, body_match FROM (SELECT id, {boolean([['abc', 'the']], 1200, 700, 250)} FROM d) WHERE score IS NOT NULL""",
        "source_counts": f"{_BOTH} SELECT query_id, source, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT query_id, 'all', count(*) FROM h GROUP BY query_id",
        "digest": f"""{_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, title, id) AS rank, count(*) OVER (PARTITION BY query_id, source) AS total FROM h)
            SELECT query_id, source, total, string_agg(rank || '. [' || source || '] [' || regexp_replace(title, '([\\\\`*_\\[\\]()])', '\\\\\\1', 'g') || '](' || id || ')', chr(10) ORDER BY rank) AS lines FROM r WHERE rank <= 5 GROUP BY ALL""",
        "merge_title_body_hits": f"""WITH {KB}, t AS ({_hits('k', 'kb', 'title')}), b AS ({_hits('k', 'kb', 'body')})
            SELECT coalesce(t.query_id, b.query_id) AS query_id, coalesce(t.id, b.id) AS url, coalesce(t.title, b.title) AS title,
                   CASE WHEN t.id IS NOT NULL AND b.id IS NOT NULL THEN greatest(t.score, b.score) + 250 ELSE coalesce(t.score, b.score) END AS score,
                   coalesce(t.title_match, b.title_match) AS title_match, CASE WHEN t.id IS NOT NULL AND b.id IS NOT NULL THEN t.body_match OR b.body_match ELSE coalesce(t.body_match, b.body_match) END AS body_match
            FROM t FULL JOIN b ON t.query_id = b.query_id AND t.id = b.id""",
        "snippets": f"SELECT doc_id, {snippet(source, low, 'of the', 80, 180, cut220, token)} AS wiki, {snippet(flat, f'lower({flat})', 'of the', 100, 180, f'substr({flat}, 1, 260)')} AS body, {snippet(flat, f'lower({flat})', 'of the', 110, 110, f'substr({flat}, 1, 220)')} AS title FROM documents",
        "highlight": "SELECT doc_id, md5(regexp_replace(text, '(of the|the|of)', '**\\1**', 'gi')) AS marked_md5 FROM documents",
        "extract_titles": f"WITH {PAGE} SELECT page_id, title FROM page",
        "odd_pages": f"""WITH {PAGE}, o AS (SELECT *, page_id % 6 AS h, page_id % 5 AS t FROM page)
            SELECT page_id, CASE h WHEN 0 THEN 'Second ' || page_id WHEN 1 THEN 'Third ' || page_id WHEN 2 THEN 'Og ' || page_id WHEN 3 THEN 'Plain ' || page_id WHEN 4 THEN 'Under ' || page_id ELSE title END AS title,
                   md5(CASE WHEN h = 5 THEN body WHEN t = 0 THEN trim(repeat('main ', 60)) WHEN t = 1 THEN trim(repeat('div ', 60)) WHEN t = 2 THEN trim(repeat('other ', 50)) WHEN t = 4 THEN trim(repeat('art ', 60))
                       ELSE trim(CASE h WHEN 0 THEN 'Support Portal Second ' || page_id WHEN 1 THEN 'Third ' || page_id WHEN 2 THEN '' WHEN 3 THEN 'Plain ' || page_id ELSE 'Under ' || page_id END || ' ' || repeat('loose ', 5)) END) AS body_md5 FROM o""",
        "extract_bodies": f"WITH {PAGE} SELECT page_id, body, substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 4000) AS stored FROM page",
        "text_functions": f"""SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 88) || ' …(생략)' END AS truncated, md5(regexp_replace(text, '([\\\\`*_\\[\\]()])', '\\\\\\1', 'g')) AS markdown_md5,
            md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_md5, md5({normal('text')}) AS normal_md5,
            len(list_distinct(list_filter(regexp_split_to_array({normal('text')}, '\\s+'), lambda x: length(x) >= 2)))::INTEGER AS n_tokens FROM documents""",
        "script_profile": f"WITH {SCRIPTED} SELECT page_id, {_count('body', '[A-Za-z]')}::INTEGER AS latin, {_count('body', _LOCALIZED)}::INTEGER AS localized, regexp_matches(title, '{_LOCALIZED}') AS title_localized FROM s",
        "latin_gate": f"WITH {SCRIPTED} SELECT page_id, {_WHOLE_BY_TITLE} AND {_URL_OK} AS by_title, {_WHOLE_BY_BODY} AND {_URL_OK} AS by_body, {_LEGACY} AND {_URL_OK} AS legacy FROM s",
        "canonical_urls": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://knowledge.example.com/external/article/' || page_id WHEN 1 THEN 'https://knowledge.example.com/external/article/' || page_id || '/how-to_fix.html' END AS canonical,
            CASE WHEN page_id % 3 < 2 THEN page_id::VARCHAR ELSE '' END AS article_id, CASE WHEN page_id % 3 = 1 THEN 'How to fix' END AS title FROM pages""",
        "change_set": f"WITH {CHANGES} SELECT * FROM ch WHERE reason IS NOT NULL",
        "change_set_from_buckets": f"WITH {CHANGES} SELECT * FROM ch WHERE reason IS NOT NULL",
        "unchanged_urls": f"WITH {CHANGES} SELECT url FROM ch WHERE reason IS NULL",
        "reuse_or_refetch": f"""WITH {INDEX}, {ITEMS} SELECT i.url, x.url IS NOT NULL AND x.page_id % 60 < 30 AND i.page_id % 4 <> 0 AS by_age,
            x.url IS NOT NULL AND CASE WHEN i.lastmod IS NOT NULL AND x.source_lastmod IS NOT NULL THEN i.lastmod = x.source_lastmod ELSE x.page_id % 60 < 7 END AS by_lastmod FROM items i LEFT JOIN idx x ON i.url = x.url""",
        "apply_changes": f"WITH {CHANGES} SELECT url, source_lastmod, article_id, title FROM idx WHERE url NOT IN (SELECT url FROM ch WHERE reason IS NOT NULL) UNION ALL SELECT url, lastmod, '', 'fetched' FROM ch WHERE reason IN ('new', 'lastmod')",
        "outcome_counters": f"""WITH {SCRIPTED}, o AS (SELECT CASE WHEN page_id % 13 = 0 THEN 'failed' WHEN {_BY_TITLE} AND {_URL_OK} THEN 'english' ELSE 'skipped' END AS o FROM s)
            SELECT count(*) FILTER (o = 'english') AS english, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed, count(*) AS total, round(count(*) FILTER (o <> 'failed') / count(*) * 100, 1) AS progress FROM o""",
        "failure_fallback": """SELECT 'https://knowledge.example.com/external/article/' || page_id || '/the-page' AS url, CASE WHEN page_id % 3 = 0 THEN 'fetched' WHEN page_id % 2 = 0 THEN 'earlier' ELSE 'The page' END AS title,
            CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 2 = 0 THEN 'old' ELSE '' END AS text, CASE WHEN page_id % 3 = 0 THEN 'fetched' WHEN page_id % 2 = 0 THEN 'previous' ELSE 'stub' END AS origin FROM pages""",
        "sitemap_reach": f"WITH RECURSIVE {_MAPS} SELECT root, url, level FROM reach",
        "sitemap_items": f"WITH RECURSIVE {_MAPS} SELECT root, url, lastmod FROM found",
        "sitemap_last_entries": f"WITH RECURSIVE {_MAPS} SELECT root, found.url, CASE WHEN p.url IS NOT NULL THEN '2001-01-01' ELSE lastmod END AS lastmod FROM found LEFT JOIN (SELECT url FROM pages WHERE page_id % 4 = 0) p ON p.url = found.url",
        "root_choice": f"WITH RECURSIVE {_MAPS} SELECT root, count(*) AS n FROM found WHERE root = 'root' GROUP BY root",
        "dedupe_first": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
        "dedupe_last": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_min(event_id, (ts, event_id)) AS first_event_id FROM events GROUP BY user_id",
        "index_stats": f"""WITH {BUILT} SELECT count(*) AS pages, count(*) FILTER (in_bodies) AS bodies, count(DISTINCT ('0x' || substr(md5(url), 1, 8))::BIGINT % 64) FILTER (in_bodies) AS chunks,
            max(TIMESTAMP '2024-06-01 00:00:00' + to_days((length(url) % 30)::INTEGER)) AS latest FROM built WHERE outcome = 'english'""",
        "kb_build": f"WITH {_built(_WHOLE_BY_TITLE, _WHOLE_BY_BODY, 'p.body')} SELECT * FROM built",
        "build_repeated_pages": f"""WITH {PAGE}, {_AGAIN} SELECT url, CASE WHEN page_id % 3 = 0 OR {_BY_TITLE} THEN 'english' ELSE 'skipped' END AS outcome, CASE WHEN page_id % 3 = 0 THEN 'Later ' || page_id ELSE title END AS title,
            lastmod AS source_lastmod, CASE WHEN page_id % 3 = 0 THEN 299 ELSE length(substr(body, 1, 4000)) END::INTEGER AS text_length, page_id % 3 = 0 OR ({_BY_TITLE} AND {_BY_BODY}) AS in_bodies FROM again""",
        "refresh_repeated_pages": f"""WITH {INDEX}, {PAGE}, {_AGAIN},
            c AS (SELECT a.*, x.url IS NULL AS fresh, coalesce(a.lastmod <> x.source_lastmod, false) AS changed, a.page_id % 3 = 0 OR {_BY_TITLE.replace('title', 'a.title').replace('body', 'a.body').replace('(url', '(a.url')} AS good, x.title AS was, x.source_lastmod AS was_lastmod FROM again a LEFT JOIN idx x ON x.url = a.url)
            SELECT url, CASE WHEN NOT fresh AND NOT changed THEN was WHEN page_id % 3 = 0 THEN 'Later ' || page_id ELSE title END AS title, CASE WHEN fresh OR changed THEN lastmod ELSE was_lastmod END AS source_lastmod FROM c WHERE good OR NOT (fresh OR changed)""",
        "publish_with_failures": f"""WITH {BUILT}, k AS (SELECT url, outcome, title, in_bodies FROM built WHERE outcome = 'english'
              UNION ALL SELECT url || '/missing', 'kept', 'Old ' || page_id, page_id % 2 = 0 FROM pages WHERE page_id % 13 = 0), f AS (SELECT count(*) AS n FROM built WHERE outcome = 'failed')
            SELECT 'titles' AS part, url, title FROM k UNION ALL SELECT 'bodies', url, title FROM k WHERE in_bodies
            UNION ALL SELECT 'titles header', (SELECT count(*) FROM k)::VARCHAR, n::VARCHAR FROM f UNION ALL SELECT 'bodies header', (SELECT count(*) FROM k WHERE in_bodies)::VARCHAR, n::VARCHAR FROM f""",
        "kb_from_sitemaps": f"WITH RECURSIVE {_FROM_MAPS} SELECT * FROM built",
        "kb_build_with_reuse": f"""WITH {INDEX}, {BUILT}, old AS (SELECT b.*, x.title AS was, x.source_lastmod AS was_lastmod FROM built b LEFT JOIN idx x ON x.url = b.url)
            SELECT url, CASE WHEN source_lastmod = was_lastmod THEN 'reused' ELSE outcome END AS outcome, CASE WHEN source_lastmod = was_lastmod OR outcome = 'failed' THEN was ELSE title END AS title, source_lastmod,
                   CASE WHEN source_lastmod = was_lastmod OR outcome = 'failed' AND was IS NOT NULL THEN 8 ELSE text_length END AS text_length, in_bodies OR coalesce(source_lastmod = was_lastmod, false) AS in_bodies FROM old""",
        "refresh_with_bodies": f"""WITH {CHANGES}, {PAGE}, c AS (SELECT ch.url, p.title, p.body, CASE WHEN p.url IS NULL THEN 'keep' WHEN {_BY_TITLE} THEN 'upsert' ELSE 'remove' END AS o FROM (SELECT * FROM ch WHERE reason IN ('new', 'lastmod')) ch LEFT JOIN page p ON p.url = ch.url)
            SELECT url, title, 8 AS text_length FROM idx WHERE url NOT IN (SELECT url FROM c WHERE o <> 'keep') AND url NOT IN (SELECT url FROM ch WHERE reason = 'removed')
            UNION ALL SELECT url, title, length(substr(body, 1, 4000))::INTEGER FROM c WHERE o = 'upsert' AND {_BY_BODY}""",
        "kb_refresh": f"""WITH {CHANGES}, {PAGE}, c AS (SELECT ch.url, ch.lastmod, p.title, CASE WHEN p.url IS NULL THEN 'keep' WHEN {_BY_TITLE} THEN 'upsert' ELSE 'remove' END AS o FROM (SELECT * FROM ch WHERE reason IN ('new', 'lastmod')) ch LEFT JOIN page p ON p.url = ch.url)
            SELECT url, title, source_lastmod FROM idx WHERE url NOT IN (SELECT url FROM c WHERE o <> 'keep') AND url NOT IN (SELECT url FROM ch WHERE reason = 'removed') UNION ALL SELECT url, title, lastmod FROM c WHERE o = 'upsert'""",
        "keyed_stream": f"""WITH {PAGE}, a AS (SELECT *, page_id % 2 = 0 AND page_id % 7 <> 0 AS third, page_id % 6 = 0 AND page_id % 7 = 0 AS again, {_BY_TITLE} AS good, {_BY_TITLE} AND {_BY_BODY} AS bodies FROM page)
            SELECT url, CASE WHEN third THEN 'Third ' || page_id WHEN again THEN 'Again ' || page_id ELSE title END AS title, CASE WHEN third OR again THEN 299 ELSE length(substr(body, 1, 4000)) END::INTEGER AS text_length,
                   third OR again OR bodies AS in_bodies, CASE WHEN third THEN 20 WHEN again THEN 21 ELSE 1 END AS day FROM a WHERE third OR again OR good""",
        "chunked_refresh": f"""WITH {CHANGES}, {PAGE}, c AS (SELECT ch.url, ch.lastmod, p.title, p.body, CASE WHEN p.url IS NULL THEN 'keep' WHEN {_BY_TITLE} THEN 'upsert' ELSE 'remove' END AS o FROM (SELECT * FROM ch WHERE reason IN ('new', 'lastmod')) ch LEFT JOIN page p ON p.url = ch.url)
            SELECT url, title, 8 AS text_length, true AS in_bodies, source_lastmod FROM idx WHERE url NOT IN (SELECT url FROM c WHERE o <> 'keep') AND url NOT IN (SELECT url FROM ch WHERE reason = 'removed')
            UNION ALL SELECT url, title, length(substr(body, 1, 4000))::INTEGER, {_BY_BODY}, lastmod FROM c WHERE o = 'upsert'""",
        "half_published": """SELECT s AS seen, CASE WHEN s = 'after' AND page_id < 100 THEN 'new' ELSE page_id::VARCHAR END AS article_id, url FROM pages, (VALUES ('while'), ('after'), ('before')) t(s)""",
        "flatten_blocks": f"""WITH {_TREE}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS k FROM walk), j AS (SELECT conv_id AS page_id, string_agg(text, chr(10) ORDER BY path) FILTER (text <> '') AS text FROM c WHERE k <= 500 GROUP BY conv_id)
            SELECT page_id, md5(coalesce({_PLAIN}, '')) AS text_md5, length(coalesce({_PLAIN}, ''))::INTEGER AS text_length FROM j""",
        "flatten_deep": f"""WITH j AS (SELECT conv_id AS page_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS text FROM conversations GROUP BY conv_id)
            SELECT page_id, md5(coalesce({_PLAIN}, '')) AS text_md5, length(coalesce({_PLAIN}, ''))::INTEGER AS text_length FROM j""",
        "block_text": f"SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN {_PLAIN} WHEN 1 THEN trim({_PLAIN} || ' ' || {_PLAIN}) WHEN 2 THEN 'https://e.example/x' ELSE {_PLAIN} END) AS text_md5 FROM conversations",
        "raw_blocks": f"""WITH c AS (SELECT *, (conv_id + turn) % 11 = 0 AS cut FROM conversations)
            SELECT CASE WHEN NOT cut THEN conv_id::VARCHAR END AS page_id, CASE WHEN NOT cut THEN turn::VARCHAR END AS block_id, CASE WHEN NOT cut THEN turn::INTEGER END AS pos,
                   CASE WHEN NOT cut THEN CASE turn % 5 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'image' WHEN 2 THEN 'bookmark' WHEN 3 THEN 'child_page' ELSE 'to_do' END END AS type,
                   md5(CASE WHEN cut OR turn % 5 = 4 THEN '' WHEN turn % 5 = 2 THEN 'https://e.example/x' ELSE {_PLAIN} END) AS text_md5 FROM c""",
        "page_title": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'doc ' || doc_id WHEN 1 THEN 'the name' ELSE '제목 없음' END AS title FROM documents",
        "chunk_assign": "SELECT page_id, url, (floor((row_number() OVER (ORDER BY url) - 1) / 50) + 1)::INTEGER AS chunk_no FROM pages",
        "chunk_counts": "SELECT chunk_no, count(*) AS n FROM (SELECT (floor((row_number() OVER (ORDER BY url) - 1) / 50) + 1)::INTEGER AS chunk_no FROM pages) GROUP BY chunk_no",
        "chunk_tokens": f"""WITH {KB}, t AS (SELECT (number::INTEGER % 16) AS chunk_no, unnest(list_filter(regexp_split_to_array(tn || chr(10) || bn, '[^a-z0-9._+-]+'), lambda x: length(x) BETWEEN 2 AND 64)) AS token FROM k)
            SELECT chunk_no, count(DISTINCT token) AS n_tokens FROM t GROUP BY chunk_no""",
        "sketch_bits": f"WITH {KB}, {_BITS} SELECT chunk_no, count(DISTINCT bit) AS n_bits FROM bits GROUP BY chunk_no",
        "chunk_prune": f"WITH {KB}, {_BITS}, {_holding(['the', 'and'])} SELECT id FROM k WHERE number::INTEGER % 16 IN (SELECT chunk_no FROM good) AND {has('bn', 'the and')}",
        "chunk_prune_first": f"WITH {KB}, {_BITS}, {_holding(['blend'])} SELECT id, number::INTEGER % 16 AS chunk_no FROM k WHERE number::INTEGER % 16 IN (SELECT chunk_no FROM good ORDER BY chunk_no LIMIT 3)",
        "record_gate": f"WITH {SCRIPTED} SELECT page_id, {_TITLE_OK} AS by_title, {_TITLE_OK} AND {_gate(_RECORD, ((12, 0.08), (5, 0.2)))} AS by_record FROM s",
        "result_projection": f"""{_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS rank FROM h WHERE source = 'kb')
            SELECT query_id, rank, id, title, id AS url, '' AS snippet, false AS title_match, score > 2000 AS body_match, score, source FROM r WHERE rank <= 5""",
        "dated_hits": f"""{_ONE}, e AS (SELECT id, score, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE '2024-01-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') END AS last_edited FROM h),
            r AS (SELECT row_number() OVER (ORDER BY score DESC, coalesce(epoch_ms(try_cast(last_edited AS TIMESTAMP)), 0) DESC, id) AS rank, * FROM e) SELECT * FROM r WHERE rank <= 20""",
        "indexed_search": f"WITH {DOCS} SELECT query_id, id::BIGINT AS id, score, 'wiki' AS ranker FROM ({_hits('d', 'w', 'wiki')}) UNION ALL SELECT query_id, id::BIGINT, score, 'body' FROM ({_hits('d', 'b', 'body')})",
        "indexed_boolean_search": f"WITH {DOCS} SELECT * FROM (SELECT id, title, {boolean([['with', 'license'], ['of', 'them']], 1200, 700, 250)} FROM d) WHERE score IS NOT NULL",
        "indexed_batch_search": f"WITH {DOCS}, n AS (SELECT *, id::VARCHAR AS number FROM d) SELECT query_id, id::BIGINT AS id, score, title_match, body_match FROM ({_hits('n', 'w', 'title', _WIDE_BATCH)})",
        "wiki_listing": """WITH w AS (SELECT doc_id AS i, CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'p-' || (doc_id // 2) || '-x' END AS id, '2024-01-' || lpad((doc_id * 7 % 28 + 1)::VARCHAR, 2, '0') AS last_edited FROM documents WHERE doc_id % 6 <> 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited DESC, i) AS k FROM w WHERE id <> '')
            SELECT id, 'doc ' || i AS title, CASE WHEN i % 3 = 0 THEN 'https://e.example/' || i ELSE 'https://wiki.example.com/' || replace(id, '-', '') END AS url, last_edited FROM r WHERE k = 1""",
        "legacy_texts": f"""WITH {PAGE}, b AS (SELECT page_id, regexp_replace(html, '<br\\s*/?>|</p>|</li>', chr(10), 'gi') AS x, html FROM pages),
            t AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM b)
            SELECT t.page_id, md5(regexp_replace({entities('x')}, '^\\s+|\\s+$', '', 'g')) AS lines_md5, md5(trim(regexp_replace({entities('html')}, '\\s+', ' ', 'g'))) AS plain_md5,
                   title, title AS article, md5(substr(body, 1, 4000)) AS text_md5 FROM t JOIN page ON page.page_id = t.page_id""",
        "term_snippets": f"SELECT doc_id, {snippet(source, low, 'license', 80, 180, cut220)} AS snippet FROM documents",
        "event_fields": """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y. %m. %d. ') || CASE WHEN hour(ts + INTERVAL 9 HOUR) < 12 THEN '오전' ELSE '오후' END || strftime(ts + INTERVAL 9 HOUR, ' %I:%M') AS web,
            CASE WHEN event_id % 4 = 0 THEN 0 ELSE epoch_ms(date_trunc('second', ts)) END AS millis, least(greatest(event_id // 7, 3), 50) AS clamped FROM events""",
        "plan_with_extras": f"WITH RECURSIVE {_MAPS} SELECT url, lastmod FROM found WHERE root = 'root' UNION ALL SELECT u, NULL FROM (VALUES ('more'), ('other')) t(u)",
        "capped_plan": f"WITH {_NAMED} SELECT loc AS url FROM e ORDER BY i::VARCHAR, m, page_id LIMIT 120",
        "artifact_round_trip": f"SELECT url, {_LASTMOD} AS lastmod FROM pages",
        "chunk_round_trip": f"WITH {PAGE} SELECT url, md5(substr(body, 1, 4000)) AS text_md5, (page_id // 100)::INTEGER AS chunk_no FROM page",
        "published_headers": f"""WITH {BUILT}, h AS (SELECT count(*) FILTER (outcome = 'english') AS titles, count(*) FILTER (in_bodies) AS bodies, (count(*) FILTER (outcome = 'failed'))::INTEGER AS failed FROM built)
            SELECT 'titles' AS name, 1 AS version, 'en' AS language, '2024-06-01' AS created_at, titles AS page_count, failed AS failed_count FROM h UNION ALL SELECT 'bodies', 1, 'en', '2024-06-01', bodies, failed FROM h""",
        "title_places": f"WITH {BUILT} SELECT url, row_number() OVER (ORDER BY title COLLATE en, url) - 1 AS ordinal FROM built WHERE outcome = 'english'",
        "first_titles": f"WITH {PAGE} SELECT title FROM page ORDER BY title COLLATE en, url LIMIT 10",
        "streamed_refresh": f"WITH {PAGE} SELECT url, CASE WHEN page_id % 5 = 0 AND page_id % 3 <> 0 THEN 'New ' || page_id ELSE title END AS title FROM page WHERE {_BY_TITLE} OR (page_id % 5 = 0 AND page_id % 3 <> 0)",
        "local_time": """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y. %m. %d. ') || CASE WHEN hour(ts + INTERVAL 9 HOUR) < 12 THEN '오전' ELSE '오후' END || strftime(ts + INTERVAL 9 HOUR, ' %I:%M:%S') AS long, strftime(ts + INTERVAL 9 HOUR, '%m.%d %H:%M') AS short FROM events""",
        "query_parse": """SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'AND·OR' WHEN 1 THEN 'AND' WHEN 2 THEN 'OR' ELSE 'plain' END AS mode,
            split_part(text, ' ', 1) || CASE WHEN item_id % 4 < 2 THEN '+' ELSE ' ' END || split_part(text, ' ', 2) || CASE WHEN item_id % 2 = 0 THEN '/' ELSE ' ' END || split_part(text, ' ', 3) AS groups FROM benchmark""",
    }
