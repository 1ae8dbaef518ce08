"""Personal data by pattern, and neighbouring terms that give it away (DataFrame functions only).

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each found value is a
protected entity. The corpus then tells how strongly a term discloses an entity: with c(t) the
term's occurrences in all texts, c(e) the entity's mentions, c(t,e) the mentions with the term
within ``reach`` words, and N all words, the pointwise mutual information
log(c(t,e) N / (c(t) c(e))) over the entity's information log(N / c(e)) is the share of the
entity that the term reveals. One occurrence of the term away from the entity is added to c(t), so
that a term seen once or twice claims less than one that always stands there. Terms above the lower threshold are generalised to their shape,
those above the upper one are removed, wherever they stand beside that entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, let, lower_ascii, words
from .components import small

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the four kinds. Possessive repeats and the look-behinds change no match; they keep
#: long runs without a match linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What a text must hold for the pattern to be tried at all.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}

MATCH, SPAN = "struct<kind:string,gap:int,value:string>", "struct<kind:string,start:int,end:int,value:string>"


@dataclass(frozen=True)
class Disclosure:
    """Parameters of the corpus statistics."""

    reach: int = 6  #: words on either side of a mention
    apart: float = 1.0  #: occurrences away from the entity that are added to c(t)
    generalise_at: float = 0.75
    remove_at: float = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """Array of (kind, gap, value): a kind's matches in order, and how many code points lie between each and the one before."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), 1, F.size(found))
    rows = F.zip_with(gaps, found, lambda g, m: F.struct(F.lit(kind).alias("kind"), g.alias("gap"), m.alias("value")))
    return F.when(HINTS[kind](text), rows).otherwise(F.array().cast(f"array<{MATCH}>"))


def _located(rows: DataFrame, *key: str) -> DataFrame:
    """Rows (pos, gap, value) with their start and end in the text: running sums within ``key``."""
    end = F.sum(F.col("gap") + F.length("value")).over(W.partitionBy(*key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("gap")


def find(texts: DataFrame) -> DataFrame:
    """(_row, kind, start, end, value): the valid spans of (_row, _matches); code points, end exclusive."""
    rows = _located(texts.select("_row", F.posexplode("_matches").alias("pos", "m")).select("_row", "pos", "m.*"), "_row", "kind").drop("pos")
    valid = F.lit(False)
    for kind in KINDS:
        valid = F.when(F.col("kind") == kind, _valid(kind, F.col("value"))).otherwise(valid)
    return rows.where(valid)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _gathered(spans: DataFrame, name: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(_row, name): each row's spans as an array, by kind as listed, then start."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) if kinds else F.lit(0)
    ordered = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "value")))
    return spans.groupBy("_row").agg(F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias(name))


def _context(texts: DataFrame, spans: DataFrame, by: Disclosure) -> DataFrame:
    """A row for each whole word within reach of a mention: (_row, kind, value, term, start, end).

    Words that touch a found span are left out. Words and mentions of a text are put in order by one window, which tells each mention
    the number of the words it begins and ends in; its neighbours are then found by number.
    """
    word = r"[^\x20\x09-\x0D]+"
    found, gaps = F.regexp_extract_all("_text", F.lit(word), F.lit(0)), F.transform(F.split("_text", word, -1), lambda g: F.length(g))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, w: F.struct(g.alias("gap"), w.alias("value")))
    words_of = cut(_located(texts.select("_row", F.posexplode(pairs).alias("pos", "w")).select("_row", "pos", "w.*"), "_row"))
    no = F.lit(None)
    events = words_of.select("_row", F.col("start").alias("at"), F.lit(0).alias("what"), no.cast("string").alias("kind"), no.cast("int").alias("start"), no.cast("string").alias("value"))
    for what, at in ((1, F.col("start")), (2, F.col("end") - 1)):
        events = events.unionByName(spans.select("_row", at.alias("at"), F.lit(what).alias("what"), "kind", "start", "value"))
    in_order = W.partitionBy("_row").orderBy("at", "what").rowsBetween(W.unboundedPreceding, 0)
    placed = events.withColumn("word", F.count_if(F.col("what") == 0).over(in_order).cast("int") - 1).where("what > 0")
    mentions = placed.groupBy("_row", "kind", "start", "value").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    mentions = cut(mentions)
    touched = mentions.select("_row", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    around = F.concat(F.sequence(F.col("first") - by.reach, F.col("first") - 1), F.sequence(F.col("last") + 1, F.col("last") + by.reach))
    near = mentions.select("_row", "kind", F.col("value").alias("entity"), F.explode(around).alias("pos"))
    near = near.join(words_of, ["_row", "pos"]).join(touched, ["_row", "pos"], "left_anti")
    return near.select("_row", "kind", F.col("entity").alias("value"), _term(lower_ascii(F.col("value"))).alias("term"), "start", "end").where("term <> ''")


def _term(word: Column) -> Column:
    """A word without outer punctuation."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def sanitise(docs: DataFrame, text: str = "text", by: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, base spans by kind, all spans, sanitised text), one row for each row of ``docs``.

    Columns: doc_id; base, extra: arrays of (kind, start, end, value), extra of kinds "general" and
    "removed"; sanitised: the text with base spans replaced by their kind in brackets, general ones by the shape of
    the word, removed ones by nothing (null for documents without spans, whose text stays). Null texts count as
    empty, null ids are kept. Repeated rows are separate mentions. Extra columns are left out, whatever their names. An empty table gives
    no rows. Mentions of one value in a third of all texts are counted by partial sums; only mentions, never pairs of them, are
    exploded, and the work on a text grows with its length, however many mentions it has.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select("doc_id", t.alias("_text"), F.concat(*[_matches(k, t) for k in KINDS]).alias("_matches"))
    base = base.select(
        "doc_id",
        "_matches",
        F.size(words(F.col("_text"))).cast("long").alias("_n_words"),
        F.when(F.size("_matches") > 0, F.col("_text")).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = cut(base)  # patterns run once; _row is fixed from here on
    spans = cut(find(base))
    told = cut(_gathered(spans, "base", KINDS))
    texts = base.join(told.select("_row"), "_row", "left_semi").select("_row", "_text")
    near = cut(_context(texts, spans, by))
    entities = spans.groupBy("kind", "value").agg(F.count("*").alias("c_e"))
    together = near.groupBy("kind", "value", "term").agg(F.count("*").alias("c_te"))
    corpus = docs.select(F.explode(words(lower_ascii(F.col(text)))).alias("w"))
    corpus = corpus.groupBy("w").agg(F.count("*").alias("n"))
    # terms are words without outer punctuation, so distinct words are stripped and summed once more
    corpus = corpus.groupBy(_term(F.col("w")).alias("term")).agg(F.sum("n").alias("c_t"))
    total = float(base.agg(F.sum("_n_words")).first()[0] or 1)
    scored = together.join(entities, ["kind", "value"]).join(corpus, "term")
    information = F.log(F.lit(total) / F.col("c_e"))  # none, if there are no more words than mentions
    reveals = 1 - F.log(F.greatest(F.lit(1.0), (F.col("c_t") + by.apart) / F.col("c_te"))) / F.when(information > 0, information)
    scored = cut(scored.select("kind", "value", "term", reveals.alias("reveals")).where(F.col("reveals") >= by.generalise_at))
    flagged = near.join(small(scored), ["kind", "value", "term"])
    # one word may stand beside several entities: its strongest disclosure counts
    flagged = flagged.groupBy("_row", "start", "end").agg(F.max("reveals").alias("reveals"), F.first("term").alias("value"))
    extra = cut(flagged.select("_row", F.when(F.col("reveals") >= by.remove_at, "removed").otherwise("general").alias("kind"), "start", "end", "value"))
    out = base.select("_row", "doc_id").join(told, "_row", "left").join(_gathered(extra, "extra"), "_row", "left").join(_rewritten(texts, spans.unionByName(extra)), "_row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("extra", none).alias("extra"), "sanitised")


def _rewritten(texts: DataFrame, spans: DataFrame, block: int = 256) -> DataFrame:
    """(_row, sanitised): the texts with their spans replaced. Spans that overlap are replaced as one, by what stands for the first.

    A text is cut into blocks, so that each piece of it is taken from where it lies.
    """
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{N}+", "0"), r"\p{L}+", "x")
    put = F.when(F.col("kind") == "removed", "").when(F.col("kind") == "general", F.concat(F.lit("["), shape, F.lit("]"))).otherwise(F.concat(F.lit("["), "kind", F.lit("]")))
    order = W.partitionBy("_row").orderBy("start", "end", "kind")
    reached = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    apart = spans.select("_row", "start", "end", "kind", put.alias("put"), (F.col("start") >= reached).cast("int").alias("new"))
    apart = apart.withColumn("nth", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = apart.groupBy("_row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("put", F.struct("start", "end", "kind")).alias("put"))
    segments = merged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "put"))).alias("_segments"))

    def whole(blocks: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / block).cast("int")
            held = F.slice(blocks, first + 1, F.floor(end / block).cast("int") - first + 1)
            return F.substring(F.array_join(held, ""), start - first * block + 1, end - start)

        ends = F.concat(F.array(F.lit(0)), F.transform("_segments", lambda s: s["end"]))
        pieces = F.zip_with(F.slice(ends, 1, F.size("_segments")), F.col("_segments"), lambda e, s: F.concat(part(e, s["start"]), s["put"]))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(ends, -1), F.length("_text")))

    cut_up = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return texts.join(segments, "_row").select("_row", let(cut_up, whole).alias("sanitised"))
