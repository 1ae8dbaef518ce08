"""Search for very many queries at once: one automaton of all their terms, one pass over each text.

search() asks each text for each term of each query. Here an Aho-Corasick automaton finds all terms of all queries in one reading of a text, and only queries
of which a term was found are looked at. The queries, a stated set, are parsed by Spark and broadcast in parts of a checked size; documents stay where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search

#: Characters of terms that one automaton holds; more queries take more passes.
CHARACTERS = 20_000_000


@dataclass
class Plan:
    """Queries by the terms that can make them match."""

    terms: list[str] = field(default_factory=list)
    phrases: dict[int, list[tuple[int, str, list[int]]]] = field(default_factory=dict)  #: by phrase: (query, raw, its words)
    words: dict[int, list[tuple[int, str, int, list[int]]]] = field(default_factory=dict)  #: by word: (query, raw, phrase, all words)
    boolean: dict[int, list[int]] = field(default_factory=dict)  #: by a term of an alternative: queries
    groups: dict[int, list[tuple[list[int], list[str]]]] = field(default_factory=dict)  #: alternatives of a query: terms as normalized and as written


def plan_of(rows: list, by: search.Ranker) -> Plan:
    """The plan of parsed queries."""
    plan, number = Plan(), {}

    def term(x: str) -> int:
        if x not in number:
            number[x] = len(plan.terms)
            plan.terms.append(x)
        return number[x]

    for r in rows:
        if r.has_ops:
            plan.groups[r.query_id] = [([term(t) for t in norm], list(raw)) for norm, raw in zip(r.norms, r.groups, strict=True)]
            for terms, _ in plan.groups[r.query_id]:
                plan.boolean.setdefault(max(terms, key=lambda t: len(plan.terms[t])), []).append(r.query_id)
        else:
            words = [term(w) for w in r.words] if by.token_title else []
            plan.phrases.setdefault(term(r.q), []).append((r.query_id, r.raw, words))
            for w in words:
                plan.words.setdefault(w, []).append((r.query_id, r.raw, term(r.q), words))
    return plan


def hits_of(plan: Plan, by: search.Ranker, title: set[int], body: set[int], whole: set[int]) -> list[tuple]:
    """(query_id, score, title_match, body_match, matched_terms, boolean_match) of a document that has these terms in its title, body, and anywhere."""
    found, seen = [], set()
    for t in whole & plan.boolean.keys():
        for query in plan.boolean[t]:
            if query in seen:
                continue
            won = next((g for g in plan.groups[query] if whole.issuperset(g[0])), None)
            if won:
                seen.add(query)
                terms, raw = won
                score = sum(by.term_title * (x in title) + by.term_body * (x in body) + by.per_term for x in terms)
                found.append((query, score, not title.isdisjoint(terms), not body.isdisjoint(terms), raw, True))
    either = title | body
    for t in (either if by.title_only_phrase or by.token_title else body) & plan.phrases.keys():
        for query, raw, words in plan.phrases[t]:
            if by.title_only_phrase or t in body or not either.isdisjoint(words):
                found.append((query, by.phrase_title * (t in title) + by.phrase_body * (t in body), t in title, t in body, [raw], False))
    for t in either & plan.words.keys():
        for query, raw, phrase, words in plan.words[t]:
            if query not in seen and phrase not in either:
                seen.add(query)
                in_title, in_body = [w for w in words if w in title], [w for w in words if w not in title and w in body]
                found.append((query, len(in_title) * by.token_title + len(in_body) * by.token_body, bool(in_title), bool(in_body), [raw], False))
    return [(q, s, False, True, m, b) for q, s, _, _, m, b in found] if by.flags == "body" else found


_automata: dict[str, object] = {}


def _automaton(key: str, terms: list[str]):
    """The automaton of a plan, made once in each worker."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            if t:
                made.add_word(t, i)
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def _parts(queries: DataFrame, characters: int) -> list[DataFrame]:
    size = queries.agg(F.sum(F.length("raw") + F.length("q"))).first()[0] or 0
    n = -(-size // characters)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def search_many(docs: DataFrame, queries: DataFrame, by: search.Ranker = search.WIKI, characters: int = CHARACTERS) -> DataFrame:
    """The rows of search.search(). ``docs`` as documents() makes them, ``queries`` as parsed(), with distinct ids; of any number, in parts of so many characters."""
    kind = docs.schema["id"].dataType.simpleString()
    out = f"query_id int, id {kind}, title string, score int, title_match boolean, body_match boolean, matched_terms array<string>, boolean_match boolean, article_id string"

    def one(part: DataFrame) -> DataFrame:
        key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(plan_of(part.collect(), by))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan = shared.value
            terms = _automaton(key, plan.terms)
            always = {i for i, t in enumerate(plan.terms) if not t}
            inside = lambda text: {i for _, i in terms.iter(text)} | always if text and len(terms) else set(always)
            for batch in batches:
                at, rows = [], []
                for i, (title, body, number) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("title_norm", "body_norm", "number")), strict=True)):
                    t, b = inside(title), inside(body)
                    some = hits_of(plan, by, t, b, t | b | inside(number) if by.with_id else t | b)
                    at += [i] * len(some)
                    rows += some
                    if len(rows) > 50_000:
                        yield told(batch, at, rows)
                        at, rows = [], []
                yield told(batch, at, rows)

        def told(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            where = pa.array(at, pa.int32())
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.bool_())
            q, s, t, b, m, o = (pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))
            return pa.record_batch([q, batch.column("id").take(where), batch.column("title").take(where), s, t, b, m, o, batch.column("article_id").take(where)], search.HIT)

        return docs.select("id", "title", "article_id", "title_norm", "body_norm", F.lower("article_id").alias("number")).mapInArrow(run, out)

    return reduce(DataFrame.unionByName, [one(p) for p in _parts(queries, characters)])
