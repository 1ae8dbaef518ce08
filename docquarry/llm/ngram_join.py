"""Jaccard join on word shingles with adaptive multi-match prefixes.

Shingles are ordered by document frequency (classes of it, then the hash), rare ones first; those of one document
only come first of all and can match nothing. Two sets that reach the threshold share at least c tokens, so they
share at least l tokens within their first n - c + l. Each document takes the l that costs least: the postings
its longer prefix reads, against the candidates left to verify when l of them have to agree.
Frequencies come from the packed exchange, over distinct texts: copies are put aside before, by a key of the text, and
join again at the end. Only texts whose prefix holds shingles of other texts go on, and of equal sets only one.

Links are found in rounds, since only components are wanted. First each document is verified against
pivots of each of its posting lists. What that links need not be compared again; what is left are pairs of a list that lie
in different components. A group of near copies still has very many of those, nearly alike and just below the threshold. So
the documents of one pivot (their home) are joined by their differences from what most of them have: prefixes again, but of
the few shingles in which a document differs, of which partners must share nearly all. Documents of different homes are joined by their own prefixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, own_columns
from .components import components, small
from .exchange import bucket_bounds, exchange, pack_sorted, packed, unpack_sorted, unpacked
from .wordarrays import Words, inside_documents, window_hashes

#: Longest extension of a prefix, and what it costs to verify a candidate, in postings read.
MOST_MATCHES, VERIFY_COST = 4, 20.0
#: Documents of a home that meet its majority set in one group.
SALT = 256


def shingles(docs: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start of each document's hashes with the end): the distinct shingles of each document, ascending.

    A document with fewer words than ``width`` has its whole sequence as one shingle; without words it has none.
    """
    words = Words.of(docs.column("text"), lower=True)
    one = words.hashes()
    whole = window_hashes(one, width)
    starts = np.flatnonzero(inside_documents(words.docs, width, len(whole)))
    doc = np.searchsorted(words.docs, starts, side="right") - 1
    sizes = np.diff(words.docs)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    alone = [xxhash.xxh3_64_intdigest(one[words.docs[i] : words.docs[i + 1]].tobytes()) for i in short]
    doc, hashes = np.concatenate([doc, short]), np.concatenate([whole[starts], np.array(alone, np.uint64)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(sizes) + 1))


def _classes(payloads: list[bytes]) -> list[bytes]:
    """For each chunk's hashes in a bucket: 0 if one document has it, else a class that grows with the documents."""
    tables = [unpacked(x) for x in payloads]
    lists, counts = [unpack_sorted(h) for h, _ in tables], np.concatenate([n for _, n in tables])
    _, place = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(place, counts)
    grade = np.where(total <= 1, 0, 1 + np.minimum(253, (6 * np.log2(np.maximum(total, 1))).astype(np.int64))).astype(np.uint8)
    return [packed(x) for x in np.split(grade[place], np.cumsum([len(x) for x in lists])[:-1])]


def _least_overlap(n: np.ndarray | int, num: int, den: int):
    return -(-n * num // den)


def _matches(grades: np.ndarray, n: int, c: int, alone: int) -> int:
    """The l of least estimated cost; ``grades`` of the shared shingles in order, behind ``alone`` others."""
    best, least = 1, np.inf
    for ell in range(1, min(MOST_MATCHES, c) + 1):
        read = float(np.exp2(grades[: max(0, n - c + ell - alone)] / 6.0).sum())
        cost = read + VERIFY_COST * read / ell
        if cost < least:
            best, least = ell, cost
    return best


def profiles(texts: DataFrame, width: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, n, set_key, shared, levels, ell), one row for each distinct text of (doc_id, text), doc_id being its hash.

    n: size of the set; set_key: 128-bit key of the set (null: empty). shared: hashes of the shingles that other
    texts have too, rare ones first; levels: for the first of them, the shortest l whose prefix holds it; ell: the l
    chosen. These are null where the prefix has no shared shingle, and for later equal sets of a chunk.
    """

    def sets(table: pa.Table):
        hashes, at = shingles(table, width)
        distinct, place = np.unique(hashes, return_inverse=True)
        return hashes, at, distinct, place

    def ask(table: pa.Table, buckets: int) -> list[bytes]:
        _, _, distinct, place = sets(table)
        n = np.bincount(place, minlength=len(distinct)).astype(np.uint32)
        at = bucket_bounds(distinct, buckets)
        return [packed(pack_sorted(distinct[a:b]), n[a:b]) if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]

    def finish(table: pa.Table, answers: list[bytes]) -> pa.Table:
        hashes, at, _, place = sets(table)
        grades = np.concatenate([*[unpacked(x)[0] for x in answers if x], np.zeros(0, np.uint8)])[place]
        known, rows = set(), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = int(b - a)
            key = xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if n else None
            row = (n, key, None, None, None)
            c, alone = _least_overlap(n, num, den), int((grades[a:b] == 0).sum())
            if n and key not in known and alone < n - c + min(MOST_MATCHES, c):
                g, h = grades[a:b], hashes[a:b]
                order = np.lexsort((h, g))[alone:]
                level = np.maximum(1, np.arange(alone, n) - (n - c) + 1)
                level = level[level <= min(MOST_MATCHES, c)].astype(np.int32)
                row = (n, key, h[order].view(np.int64), level, _matches(g[order], n, c, alone))
            known.add(key)
            rows.append(row)
        n, key, shared, levels, ell = zip(*rows, strict=True) if rows else [()] * 5
        return pa.table({"doc_id": table.column("doc_id"), "n": pa.array(n, pa.int64()), "set_key": pa.array(key, pa.binary()), "shared": pa.array(shared, pa.list_(pa.int64())), "levels": pa.array(levels, pa.list_(pa.int32())), "ell": pa.array(ell, pa.int32())})

    return exchange(texts, ask, _classes, finish, "doc_id long, n long, set_key binary, shared array<long>, levels array<int>, ell int", by_hash=True)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both) of pairs of sets: their sizes and how many shingles they share."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", both.alias("both"))


def _reach(num: int, den: int) -> Column:
    return den * F.col("both") >= num * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Whether two sets can reach the threshold: by their sizes n, and by the shingles m of each that others have at all."""
    n_x, n_y, m_x, m_y = (F.col(c) for c in (f"n{x}", f"n{y}", f"m{x}", f"m{y}"))
    return (den * n_x >= num * n_y) & (den * n_y >= num * n_x) & ((num + den) * F.least(m_x, m_y) >= num * (n_x + n_y))


def _to_pivots(tokens: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, by_b, n_a, n_b, both): documents against the pivots b of their lists, by_b being the pivot's share of shingles of its own.

    A list has a pivot for each band of sizes, a band being as wide as the threshold: the document with the smallest share of
    shingles that no other has, which is the least changed of a group of copies. Each document of the list is held
    against the pivots of its own band and of the next, so that cut-off copies meet those of about their length.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    first = tokens.where("level = 1").withColumn("band", band)
    least = F.min(F.struct((1 - F.col("m") / F.col("n")).alias("by"), F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("m").alias("m_b")))
    pivots = cut(first.groupBy("h", "band").agg(least.alias("p")).select("h", "band", "p.*"))
    near = first.select("doc_id", "n", "m", "h", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = near.join(pivots, ["h", "band"]).where((F.col("doc_id") != F.col("b")) & _fits("", "_b", num, den))
    pairs = pairs.select(F.col("doc_id").alias("a"), "b", "by").distinct()
    return cut(_compared(pairs.select("a", "b"), sets).join(pairs.withColumnRenamed("by", "by_b"), ["a", "b"]))


def _homes(rest: DataFrame, compared: DataFrame) -> DataFrame:
    """(doc_id, home): of the pivots that hold half of a document's shingles, and itself if it is one, the least changed; else itself."""
    there = rest.select("doc_id").distinct()
    held = compared.where(2 * F.col("both") >= F.col("n_a")).select(F.col("a").alias("doc_id"), F.struct(F.col("by_b").alias("by"), F.col("b").alias("home")).alias("p"))
    itself = compared.select(F.col("b").alias("doc_id"), F.struct(F.col("by_b").alias("by"), F.col("b").alias("home")).alias("p")).distinct()
    best = held.unionByName(itself).groupBy("doc_id").agg(F.min("p").alias("p"))
    return there.join(best, "doc_id", "left").select("doc_id", F.coalesce("p.home", "doc_id").alias("home"))


def _across_homes(rest: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): candidates with different homes, by their prefixes.

    The homes of a list meet first, by bounds of what they hold; then the documents of the home that has fewer in the list are
    held against those of the other. Of two documents the smaller set asks, by its own l, and the larger one answers with its prefix for that l.
    """
    bounds = rest.groupBy("h", "home").agg(
        F.count("*").alias("size"), F.min("n").alias("n"), F.max("n").alias("n_most"), F.max("m").alias("m"), F.max("ell").alias("ell"),
        F.min("level").alias("level"), F.min("component").alias("low"), F.max("component").alias("high"),
    )
    bounds = cut(bounds)
    other = bounds.select("h", *[F.col(c).alias(f"{c}_b") for c in bounds.columns if c != "h"])
    may = F.struct("size", "home") < F.struct("size_b", "home_b")
    may = may & (den * F.col("n_most") >= num * F.col("n_b")) & (den * F.col("n_most_b") >= num * F.col("n")) & ((num + den) * F.least("m", "m_b") >= num * (F.col("n") + F.col("n_b")))
    may = may & ((F.col("low") != F.col("high_b")) | (F.col("high") != F.col("low_b"))) & (F.greatest("level", "level_b") <= F.greatest("ell", "ell_b"))
    homes = cut(bounds.join(other, "h").where(may).select("h", "home", "home_b"))
    fewer = cut(rest.join(homes, ["h", "home"]).drop("home"))
    many = rest.select("h", F.col("home").alias("home_b"), *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "m", "ell", "level", "component")])
    asks = F.struct("n", "doc_id") < F.struct("n_b", "doc_id_b")
    ell = F.when(asks, F.col("ell")).otherwise(F.col("ell_b"))
    meets = (F.col("component") != F.col("component_b")) & _fits("", "_b", num, den) & (F.greatest("level", "level_b") <= ell)
    pairs = fewer.join(many, ["h", "home_b"]).where(meets)
    pairs = pairs.groupBy(F.least("doc_id", "doc_id_b").alias("a"), F.greatest("doc_id", "doc_id_b").alias("b")).agg(F.count("*").alias("common"), F.first(ell).alias("ell"))
    return pairs.where("common >= ell").select("a", "b")


def _differences(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, home, component, excess, away): each document as its difference from its home's majority set.

    The majority set M holds the shared shingles of over half of the members. away: the shared shingles in which a document and M differ,
    those in which few members differ first. With d all in which they differ, sets A and B have |A - B| + |B - A| = d_A + d_B - 2 common, common
    being what their differences have in common. They reach the threshold when 2 (num + den) common >= excess_A + excess_B,
    with excess = (num + den) d - (den - num) n.
    """
    own = cut(members.join(sets.select("doc_id", "n", "shared"), "doc_id"))
    seen = own.select("home", "size", F.explode("shared").alias("h")).groupBy("home", "h").agg(F.count("*").alias("c"), F.first("size").alias("size"))
    seen = cut(seen.select("home", "h", (2 * F.col("c") > F.col("size")).alias("usual"), F.least("c", F.col("size") - F.col("c")).alias("rare")))
    usual = seen.where("usual").groupBy("home").agg(F.collect_list("h").alias("usual"))  # as many as a set of average size twice at most
    # a home may hold a third of all documents: they meet their majority set in parts of about SALT documents
    parts = F.ceil(F.col("size") / SALT).cast("int")
    usual = members.select("home", parts.alias("parts")).distinct().join(usual, "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    apart = F.concat(F.array_except("usual", "shared"), F.array_except("shared", "usual"))
    differing = cut(own.join(usual, ["home", "part"], "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<long>"))).select("doc_id", "home", "component", "n", F.size("shared").cast("long").alias("m"), apart.alias("apart")))
    ordered = differing.select("doc_id", "home", F.explode("apart").alias("h")).join(seen.select("home", "h", "rare"), ["home", "h"])
    ordered = ordered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rare", "h"))).alias("away"))
    excess = (num + den) * (F.size("apart") + F.col("n") - F.col("m")) - (den - num) * F.col("n")
    none = F.array().cast("array<struct<rare:bigint,h:bigint>>")
    return cut(differing.join(ordered, "doc_id", "left").select("doc_id", "home", "component", excess.alias("excess"), F.coalesce("away", none).alias("away")))


def _within_homes(told: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): candidates with one home, by prefixes of their differences; ``told`` as _differences() has it, with components up to date.

    Documents whose excess and the home's smallest add up to nothing are one component by now, so two documents of different
    components have at least one difference in common. A document's prefix is so long that it holds the first of those which it has in common with any partner.
    """
    least = told.groupBy("home").agg(F.min_by(F.struct(F.col("component").alias("c"), F.col("excess").alias("e")), F.struct("excess", "doc_id")).alias("one"))
    told = told.join(small(cut(least)), "home")
    second = told.where(F.col("component") != F.col("one.c")).groupBy("home").agg(F.min("excess").alias("e2"))
    told = told.join(small(cut(second)), "home")  # homes with one component drop out
    partner = F.when(F.col("component") == F.col("one.c"), F.col("e2")).otherwise(F.col("one.e"))
    asked = F.greatest(F.lit(1), F.ceil((F.col("excess") + partner) / (2 * (num + den)))).cast("int")
    rows = told.select("doc_id", "home", "component", "excess", F.size("away").alias("size"), F.posexplode(F.slice("away", F.lit(1), F.greatest(F.lit(0), F.size("away") - asked + 1))).alias("at", "x"))
    rows = cut(rows.select("home", F.col("x.h").alias("h"), "doc_id", "component", "excess", (F.col("size") - F.col("at")).alias("left")))
    other = rows.select("home", "h", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "component", "excess", "left")])
    meets = (F.col("doc_id") < F.col("doc_id_b")) & (F.col("component") != F.col("component_b"))
    meets = meets & (2 * (num + den) * F.least("left", "left_b") >= F.col("excess") + F.col("excess_b"))
    return rows.join(other, ["home", "h"]).where(meets).select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def _placed(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with the component of each, by default itself."""
    return docs.join(grouped, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")


def linked(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) over the distinct sets; links that the components don't need are not listed."""
    listed = F.explode(F.arrays_zip(F.slice("shared", 1, F.size("levels")).alias("h"), F.col("levels").alias("level"))).alias("t")
    tokens = cut(sets.select("doc_id", "n", F.size("shared").cast("long").alias("m"), "ell", listed).select("doc_id", "n", "m", "ell", "t.h", "t.level"))
    compared = _to_pivots(tokens, sets, num, den)
    links = compared.where(_reach(num, den)).select("a", "b")
    grouped = cut(components(links))
    # what is left: lists that still hold more than one component
    placed = cut(_placed(tokens, grouped))
    mixed = cut(placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h"))
    rest = placed.join(mixed, "h", "left_semi")
    homes = cut(_homes(rest, compared))
    rest = cut(rest.join(homes, "doc_id"))
    sizes = homes.groupBy("home").agg(F.count("*").alias("size")).where("size > 1")
    told = _differences(homes.join(small(cut(sizes)), "home").join(rest.select("doc_id", "component").distinct(), "doc_id"), sets, num, den)
    # the most central document of a home: what is near enough to it is linked, whatever the differences
    central = told.groupBy("home").agg(F.min_by(F.struct(F.col("doc_id").alias("b"), F.col("excess").alias("e")), F.struct("excess", "doc_id")).alias("one"))
    central = told.join(small(cut(central)), "home").where((F.col("doc_id") != F.col("one.b")) & (F.col("excess") + F.col("one.e") <= 0)).select(F.col("doc_id").alias("a"), "one.b")
    known = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
    grouped = cut(components(known.unionByName(central)))
    told = cut(_placed(told.drop("component"), grouped))
    pairs = _across_homes(rest, num, den).unionByName(_within_homes(told, num, den))
    last = cut(_compared(pairs, sets).where(_reach(num, den)).select("a", "b"))
    if last.isEmpty():
        return grouped
    return components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last))


def text_key(docs: DataFrame, text: Column) -> Column:
    """A 64-bit key that tells all texts of ``docs`` apart: where texts of one hash differ by a second one, which takes billions of texts, they take a third."""
    first, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    alike = docs.select(first.alias("k"), second.alias("l")).groupBy("k").agg(F.min("l").alias("low"), F.max("l").alias("high"))
    clashing = [r.k for r in alike.where("low <> high").select("k").collect()]  # some three among 10^10 texts
    return F.when(first.isin(clashing), F.xxhash64(F.lit(2), text)).otherwise(first) if clashing else first


def groups(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Documents link when den * intersection >= num * union of their sets of distinct ``width``-word shingles (A-Z
    lower-cased; fewer words: the whole sequence as one). component_id: the smallest doc_id reachable by links,
    itself included. Null or empty texts and texts of white space have an empty set and no links. A null doc_id gets a null component
    unless its set equals or reaches another's. Repeated rows are equal sets. An empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    key = text_key(docs, t)
    keyed = cut(docs.select("doc_id", key.alias("key")))
    texts = cut(profiles(docs.select(key.alias("doc_id"), t.alias("text")), width, num, den))
    # different texts of one set: the one with the smallest key stands for all
    alike = texts.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))
    alike = small(cut(alike.where("size > 1").select("set_key", "first")))
    sets = texts.where("shared is not null").join(alike, "set_key", "left").where(F.coalesce("first", "doc_id") == F.col("doc_id"))
    found = cut(linked(sets.select("doc_id", "n", "shared", "levels", "ell"), num, den))
    placed = texts.select("doc_id", "n", "set_key").join(alike, "set_key", "left").select(F.col("doc_id").alias("key"), "n", F.coalesce("first", "doc_id").alias("rep"))
    placed = cut(placed.join(found, F.col("rep") == F.col("node"), "left").select("key", "n", F.coalesce("component", "rep").alias("part")))
    # from keys back to documents; a key or a component may be hot, so minima are partial sums, and joins are between written tables
    everyone = cut(keyed.join(placed, "key"))
    lowest = cut(everyone.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("lowest")))
    joined = everyone.join(lowest, "part", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with their own columns, whatever their names. A null doc_id stays."""
    gone = groups(docs.select("doc_id", F.col(text).alias("text")), **options).where("component_id <> doc_id").select("doc_id").distinct()
    mine = docs.select("doc_id", own_columns(docs).alias("own"))
    kept = mine.join(small(cut(gone)), "doc_id", "left_anti")
    return kept.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])
