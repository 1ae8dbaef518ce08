"""Knowledge base: full build, daily refresh, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import html, urls
from docquarry.functions.language import BODY, TITLE, is_latin_page, is_latin_title
from docquarry.functions.text import nfkc, or_empty, start, trim
from docquarry.operators import changes, chunks, sitemap
from docquarry.sources import snapshots, tables
from docquarry.sources.tables import written

#: Changed urls up to this number are broadcast to the pages; more go through an ordinary join.
BROADCAST_URLS = 100_000


@dataclass(frozen=True)
class Extent:
    """How many characters of a page's body are used; all of them by default."""

    stored: int | None = None  #: in text
    read: int | None = None  #: by the gates


WHOLE = Extent()


def extract(pages: DataFrame, extent: Extent = WHOLE) -> DataFrame:
    """(url, article_id, title, text, passes, fits): every page's title and body, and whether it passes the gates of titles and of bodies, in compatibility form; ord passes through.

    The gates read here, where the pages are, so that a text travels once.
    """
    h = or_empty(F.col("html"))
    composed = lambda c: trim(nfkc(c, h))
    ord_of = [c for c in pages.columns if c == "ord"]
    named = pages.select("url", urls.article_id(F.col("url")).alias("article_id"), composed(html.title(h)).alias("title"), composed(html.body(h)).alias("_body"), *ord_of)
    gate = lambda by: is_latin_page(F.col("title"), F.col("_body"), F.col("url"), by.first(extent.read))
    return named.select("url", "article_id", "title", start(F.col("_body"), extent.stored).alias("text"), gate(TITLE).alias("passes"), gate(BODY).alias("fits"), *ord_of)


def latest(pages: DataFrame, once: bool = True, extent: Extent = WHOLE) -> DataFrame:
    """What extract() gives, one row for each url: the last page by a column ord, if there is one; not ``once``: for each page. Pages are read where they are; only extracts meet."""
    return changes.rows_of(extract(pages, extent), once)


#: Outcomes whose rows are published; kept is a failed page with an earlier record.
PUBLISHED = ("english", "reused", "kept")
BUILT = ["url", "outcome", "article_id", "title", "text", "source_lastmod", "language", "checked_at", "in_bodies", "chunk_no"]


def build(items: DataFrame, pages: DataFrame, now: Column, previous: DataFrame | None = None, n_chunks: int = 64, reuse_days: int | None = None, once: bool = True, extent: Extent = WHOLE) -> DataFrame:
    """Every planned url with its outcome, once: titles and bodies in one pass.

    ``items``: url, lastmod; rows without a url drop out. Columns: BUILT; outcome is english, skipped, failed, kept or reused. Of repeated urls in
    items and pages the last counts, by a column ord. A failed page with a record in ``previous`` (url, title, text, and what else of BUILT there is) that
    passes the title's gate is kept: it has that record's columns. With ``reuse_days``, rows of ``previous`` (BUILT) that are still fresh stand for their pages,
    which are not read: those with the plan's lastmod or, where one is missing, checked less than so many days ago.
    Not ``once``: rows of one url stand for themselves, and items, pages and earlier rows meet each with each, as joins in SQL have them.
    ``extent``: how much of a body is stored and read by the gates.
    """
    items = changes.rows_of(items.select("url", "lastmod", *[c for c in items.columns if c == "ord"]), once)
    kept, pair = None, []
    if previous is not None:
        previous = changes.rows_of(previous, once)
    if previous is not None and reuse_days is not None:
        if not once:  # an item and an earlier row that met stay together
            pair, previous = ["_was"], written(previous.withColumn("_was", F.monotonically_increasing_id()))
        plan = written(changes.reuses(items.withColumn("title", F.lit(None).cast("string")), previous, now, {"reuse": (reuse_days, True)}, tuple(pair)))
        again = plan.where("reuse").select("url", *pair)
        if not once:
            again = again.join(pages.select("url"), "url", "left")
        kept = previous.join(again, ["url", *pair], "left_semi" if once else "inner").withColumn("outcome", F.lit("reused")).select(*BUILT)
        items = plan.where(~F.col("reuse")).select("url", "lastmod", *pair)
    got = latest(pages.join(items.select("url"), "url", "left_semi"), once, extent)
    joined = items.join(got, "url", "left")
    outcome = F.when(F.col("title").isNull(), "failed").when(F.col("passes"), "english").otherwise("skipped")
    out = joined.withColumn("outcome", outcome).withColumn("in_bodies", F.col("passes") & F.col("fits"))
    out = out.select(
        "url", "outcome", F.coalesce("article_id", urls.article_id(F.col("url"))).alias("article_id"), "title", "text", F.col("lastmod").alias("source_lastmod"),
        F.lit("en").alias("language"), now.alias("checked_at"), F.coalesce("in_bodies", F.lit(False)).alias("in_bodies"), chunks.by_hash(F.col("url"), n_chunks).alias("chunk_no"), *pair,
    )
    if previous is not None:
        had = [c for c in BUILT if c in previous.columns and c not in ("url", "outcome")]
        old = previous.where(is_latin_title(F.col("title"))).select(*[F.col(c).alias(f"_{c}") for c in ("url", *pair)], F.struct(*had).alias("_old"))
        meets = F.col("outcome") == "failed"
        for c in ("url", *pair):
            meets = meets & (F.col(c) == F.col(f"_{c}"))
        out = out.join(old, meets, "left").withColumn("_keeps", F.col("_old").isNotNull())
        # without a word on bodies, a record that has a text is in them
        told = {"outcome": F.lit("kept"), "in_bodies": F.col("_old.in_bodies") if "in_bodies" in had else F.coalesce(F.col("_old.text"), F.lit("")) != ""}
        out = out.select("url", *[F.when(F.col("_keeps"), told.get(c, F.col(f"_old.{c}") if c in had else F.col(c))).otherwise(F.col(c)).alias(c) for c in BUILT[1:]])
    return out if kept is None else out.unionByName(kept)


def plan_of(sitemaps: DataFrame, roots: DataFrame, extras: DataFrame | None = None, most: int | None = None, canonical=lambda c: c, newest: bool = False) -> DataFrame:
    """(url, lastmod) to build: the articles of the first root that has any, and extra urls beside them.

    ``sitemaps``: url, xml; ``roots``: url, root_rank. ``most``: the cap of the plan, in reading order, if one is wanted (none by default). ``newest``: see sitemap.items().
    """
    entries = written(sitemap.parse(sitemaps))
    found = sitemap.choose_root(written(sitemap.items(entries, sitemap.reach(entries, roots), canonical, newest)), roots)
    plan = (found.orderBy("ord").limit(most) if most else found).select("url", "lastmod")
    return changes.add_extras(plan, extras) if extras is not None else plan


def from_sitemaps(sitemaps: DataFrame, roots: DataFrame, pages: DataFrame, now: Column, extras: DataFrame | None = None, most: int | None = None, canonical=lambda c: c, newest: bool = False, **options) -> DataFrame:
    """The whole build: sitemaps to a plan, the plan to titles and bodies."""
    return build(plan_of(sitemaps, roots, extras, most, canonical, newest), pages, now, **options)


def publish(built: DataFrame, path: str, created_at, collation: str | None = "en_CI_AI") -> None:
    """Titles in title order and bodies by chunk under ``path``, each with its header; failed pages are counted, also those whose earlier record is kept."""
    counted = Observation()
    built = written(built.observe(counted, F.count_if(F.col("outcome").isin("failed", "kept")).alias("failed")))
    failed = counted.get["failed"]
    good = built.where(F.col("outcome").isin(*PUBLISHED))
    titles = good.select("article_id", "title", "url", "source_lastmod", "language", "checked_at")
    tables.publish(in_title_order(titles, collation), f"{path}/titles", failed, created_at)
    tables.publish(good.where("in_bodies").select("article_id", "title", "text", "url", "checked_at", "language", "chunk_no"), f"{path}/bodies", failed, created_at)


def title_order(collation: str | None = "en_CI_AI") -> list[Column]:
    return [F.collate(F.col("title"), collation) if collation else F.col("title"), F.col("url")]


def in_title_order(index: DataFrame, collation: str | None = "en_CI_AI") -> DataFrame:
    """The published order: by title under a collation, then url, dealt by range."""
    return index.orderBy(*title_order(collation))


def first_titles(index: DataFrame, n: int = 10, collation: str | None = "en_CI_AI") -> DataFrame:
    """The first titles of the published order, for a look at an index."""
    return in_title_order(index, collation).limit(n).select("title")


def _checked(index: DataFrame, items: DataFrame, pages: DataFrame, once: bool = True, extent: Extent = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(changed urls with what their pages hold and an outcome, removed urls)."""
    plan = written(changes.change_set(items, index, once))
    fetch, removed = plan.where("reason <> 'removed'"), plan.where("reason = 'removed'").select("url")
    wanted = fetch.select("url")
    wanted = F.broadcast(wanted) if plan.count() <= BROADCAST_URLS else wanted
    got = latest(pages.join(wanted, "url", "left_semi"), once, extent)
    checked = fetch.drop("article_id").join(got, "url", "left")
    checked = checked.withColumn("outcome", F.when(F.col("title").isNull(), "keep").when(F.col("passes"), "upsert").otherwise("remove"))
    return written(checked), removed


def _upserts(checked: DataFrame, now: Column) -> DataFrame:
    made = {"source_lastmod": F.col("lastmod"), "language": F.lit("en"), "checked_at": now}
    return checked.where("outcome = 'upsert'").withColumns(made)


def refresh(index: DataFrame, items: DataFrame, pages: DataFrame, now: Column, once: bool = True, extent: Extent = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(new index, outcomes by url) after one day's snapshot of items.

    The change set meets the pages by broadcast if it is small. A changed page that can't be read keeps its old row; one that
    fails the gate is removed; urls that left the sitemap go. ``once``, ``extent``: see build().
    """
    titles, _, told = refresh_with_bodies(index, None, items, pages, now, once=once, extent=extent)
    return titles, told


def refresh_with_bodies(index: DataFrame, bodies: DataFrame | None, items: DataFrame, pages: DataFrame, now: Column, n_chunks: int = 64, once: bool = True, extent: Extent = WHOLE) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(new index, new bodies, outcomes by url): the same for titles and bodies (article_id, title, text, url, checked_at, language, chunk_no) at once.

    A page that passes the title's gate and not the body's stays in the index and leaves the bodies.
    """
    checked, removed = _checked(index, items, pages, once, extent)
    upserts = _upserts(checked, now)
    gone = removed.unionByName(checked.where("outcome = 'remove'").select("url"))
    told = checked.select("url", "outcome").unionByName(removed.withColumn("outcome", F.lit("removed")))
    titles = ["article_id", "title", "url", "source_lastmod", "language", "checked_at"]
    new = changes.apply_changes(index.select(*titles), upserts.select(*titles), gone, once)
    if bodies is None:
        return new, None, told
    read = upserts.withColumn("chunk_no", chunks.by_hash(F.col("url"), n_chunks))
    without = gone.unionByName(read.where("not fits").select("url"))
    return new, changes.apply_changes(bodies, read.where("fits").select(*bodies.columns), without, once), told


#: Columns of a knowledge base that is kept in chunks.
INDEX = "article_id string, title string, text string, url string, source_lastmod string, language string, checked_at timestamp, in_bodies boolean, chunk_no int"


def refresh_chunks(spark: SparkSession, path: str, items: DataFrame, pages: DataFrame, now: Column, n_chunks: int = 64, once: bool = True, extent: Extent = WHOLE) -> tuple[DataFrame, set[int]]:
    """(outcomes by url, chunks written): the same refresh of titles and bodies kept under ``path`` (INDEX, see snapshots): only chunks with a changed url are read whole and written.

    The change set reads no texts. ``n_chunks`` is that of the first version; the refresh makes the next one.
    """
    index = snapshots.read(spark, path, INDEX)
    checked, removed = _checked(index.select("url", "source_lastmod", "article_id"), items, pages, once, extent)
    upserts = _upserts(checked, now).withColumn("in_bodies", F.col("fits"))
    gone = removed.unionByName(checked.where("outcome = 'remove'").select("url"))
    columns = [c for c in spark.createDataFrame([], INDEX).columns if c != "chunk_no"]
    touched = snapshots.merge(spark, path, INDEX, upserts.select(*columns), gone, n_chunks, once=once)
    return checked.select("url", "outcome").unionByName(removed.withColumn("outcome", F.lit("removed"))), touched


def statistics(index: DataFrame) -> DataFrame:
    """One row: pages, bodies, chunks, latest check."""
    return index.agg(
        F.count("*").alias("pages"), F.count_if("in_bodies").alias("bodies"), F.count_distinct(F.when(F.col("in_bodies"), F.col("chunk_no"))).alias("chunks"), F.max("checked_at").alias("latest")
    )
