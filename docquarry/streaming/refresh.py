"""The refresh as a stream of page drops, with what was last seen of each url as keyed state.

The state of a url is when its page was last taken. By it a drop's pages are told apart: failed ones (no HTML), late ones (older than what was taken), fresh ones (the
url was checked less than so many days before) and those to take, the last of each url. Only these are parsed and merged, by url, into the chunks of the
index that they touch. A batch writes one version of the index; after a failure it is repeated whole, from the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docquarry.jobs.kb import WHOLE, Extent, extract
from docquarry.sources import snapshots
from docquarry.sources.tables import written

DROP = "url string, html string, seen_at timestamp"
INDEX = "article_id string, title string, text string, url string, checked_at timestamp, in_bodies boolean, chunk_no int"
EVENT = "url string, outcome string, seen_at timestamp, html string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class Seen(StatefulProcessor):
    """Events (EVENT) of the pages of one url; see the module."""

    def __init__(self, fresh_days: int, state_days: int | None) -> None:
        self.fresh, self.ttl = fresh_days * DAY_MS, state_days * DAY_MS if state_days else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.taken.get()[0] if self.taken.exists() else None
        told, last = [], None
        pages = pd.concat(list(rows)).sort_values("seen_at", kind="stable")
        for seen, html in zip(pages["seen_at"], pages["html"], strict=True):
            ms = int(seen.timestamp() * 1000)
            if html is None:
                told.append(("failed", seen, None))
            elif at is not None and ms <= at:
                told.append(("late", seen, None))
            elif at is not None and ms - at < self.fresh:
                told.append(("fresh", seen, None))
            else:
                if last:
                    told.append(("replaced", last[0], None))
                at, last = ms, (seen, html)
        if last:
            self.taken.update((at,))
            told.append(("taken", *last))
        yield pd.DataFrame([(key[0], *x) for x in told], columns=["url", "outcome", "seen_at", "html"])


def events(pages: DataFrame, fresh_days: int = 0, state_days: int | None = None) -> DataFrame:
    """What becomes of each page (url, html, seen_at) of a stream; pages without a url or a time drop out.

    ``state_days``: how long by the clock the state of a url is kept; a url that is unknown again is taken as new.
    """
    known = pages.where((F.coalesce("url", F.lit("")) != "") & F.col("seen_at").isNotNull())
    return known.groupBy("url").transformWithStateInPandas(Seen(fresh_days, state_days), EVENT, "Append", "ProcessingTime" if state_days else "None")


def merge_batch(spark: SparkSession, index: str, batch: DataFrame, version: int, n_chunks: int = 64, extent: Extent = WHOLE) -> set[int]:
    """Merge the taken pages of ``batch`` (EVENT) into the index as ``version``: those that fail the title's gate leave it. Returns the chunks written."""
    taken = batch.where("outcome = 'taken'").select("url", "html", "seen_at")
    read = written(extract(taken, extent).join(taken.select("url", "seen_at"), "url"))
    upserts = read.where("passes").select("article_id", "title", "text", "url", F.col("seen_at").alias("checked_at"), F.col("fits").alias("in_bodies"))
    return snapshots.merge(spark, index, INDEX, upserts, read.where("not passes").select("url"), n_chunks, version)


def start(spark: SparkSession, drops: str, index: str, checkpoint: str, files_per_batch: int = 100, fresh_days: int = 0, state_days: int | None = None, n_chunks: int = 64, extent: Extent = WHOLE) -> StreamingQuery:
    """Read Parquet drops (DROP) in ``drops`` into versions of the index under ``index``; ``checkpoint`` has the cursor and the state. Runs until what is there is read."""
    source = spark.readStream.schema(DROP).option("maxFilesPerTrigger", files_per_batch).parquet(drops)

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.sparkSession, index, written(batch), batch_id, n_chunks, extent)

    was, name = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None), "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)  # a query takes the settings at its start with it
    try:
        return events(source, fresh_days, state_days).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def run(spark: SparkSession, drops: str, index: str, checkpoint: str, files_per_batch: int = 100, **options) -> DataFrame:
    """Take what there is of drops, and return the index as it is then."""
    start(spark, drops, index, checkpoint, files_per_batch, **options).awaitTermination()
    return snapshots.read(spark, index, INDEX)
