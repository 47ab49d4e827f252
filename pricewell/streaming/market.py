"""The market refresh as a stream of landed search pages: items once however late they come, and a row of statistics per batch.

The state is in stored tables: the items seen, by the month in which they were first seen; the history by month; the finds
of each search; the pages that don't parse; the statistics. Each batch adds to them under its number, so that a batch that runs again after a failure
adds what it had not added. Items come once as long as their month is kept (forget()); none is lost for being late.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pricewell import storage
from pricewell.functions.rules import MARKET_STORE
from pricewell.operators import matching, published, snapshots
from pricewell.operators.published import Buckets, Months, Table
from pricewell.sources import market
from pricewell.sources.schemas import TABLES

SEEN = "item_id STRING, first_seen DATE, added_by STRING"
FINDS = "card_name STRING, n BIGINT"
BROKEN = "card_name STRING, search_rank BIGINT, broken_body STRING, reason STRING, day DATE"
COUNTS = ("fetched", "broken", "fresh", "skipped", "matched", "unmatched")
STATISTICS = "run STRING, batch BIGINT, " + ", ".join(f"{c} BIGINT" for c in COUNTS)


@dataclass
class Store:
    """The stored tables of one market under a folder."""

    spark: SparkSession
    path: str
    seen: Table = field(init=False)
    history: Table = field(init=False)
    unmatched: Table = field(init=False)
    finds: Table = field(init=False)
    quarantine: Table = field(init=False)
    statistics: Table = field(init=False)

    def __post_init__(self) -> None:
        of = lambda name, schema, layout: Table(self.spark, f"{self.path}/{name}", schema, layout)
        self.seen = of("seen", SEEN, Months("first_seen"))
        self.history = of("price_history", TABLES["price_history"], Months("recorded_at"))
        self.unmatched = of("unmatched_cards", TABLES["unmatched_cards"], Buckets({"store_id": 1}))
        self.finds = of("finds", FINDS, Buckets({"card_name": 1}))
        self.quarantine = of("quarantine", BROKEN, Months("day"))
        self.statistics = of("statistics", STATISTICS, Buckets({"run": 1}))


def forget(store: Store, as_of: str, years: int = 2) -> None:
    """Drops the items seen, the history and the broken pages of months past retention."""
    for table in (store.seen, store.history, store.quarantine):
        published.retain(table, as_of, years)


def fresh_items(found: DataFrame, seen: DataFrame, added_by: str) -> DataFrame:
    """The first row of each item id by search_rank and item_pos, of items that were not seen but by this very batch.

    The table of seen items is met by the ids of the batch first, so that it is scanned and not sorted or shuffled where a batch is small.
    """
    first = market.first_seen(found, ["search_rank", "item_pos"])
    known = seen.filter(F.col("added_by") != added_by).select(F.col("item_id").alias("itemId"))
    known = known.join(found.select("itemId"), "itemId", "left_semi").distinct()
    return first.join(known, "itemId", "left_anti").select(*first.columns)


class BatchStatistics(StreamingQueryListener):
    """Writes a row of statistics for each batch: what the stream's plan observed, and what the batch's writes counted."""

    def __init__(self, store: Store, name: str):
        self.store, self.name, self.counted, self.ended = store, name, {}, threading.Event()
        self.run_id = None
        self.failed: Exception | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) != self.run_id or "found" not in p.observedMetrics or p.batchId not in self.counted:
            return
        seen = p.observedMetrics["found"]
        row = {"fetched": seen["fetched"], "broken": seen["broken"], **self.counted.pop(p.batchId)}
        try:
            made = self.store.spark.createDataFrame([(self.name, p.batchId, *(row[c] for c in COUNTS))], STATISTICS)
            self.store.statistics.append(made, self.name, p.batchId)
        except Exception as e:  # a listener's errors are only logged; wait() raises it
            self.failed = e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.ended.set()

    def wait(self, query: StreamingQuery, seconds: float = 600) -> None:
        """Waits for the query's end and for the rows of its batches."""
        try:
            query.awaitTermination()
            if not self.ended.wait(seconds):
                raise TimeoutError("the query's end was not reported")
        finally:
            self.store.spark.streams.removeListener(self)
        if self.failed:
            raise self.failed


def ingest(pages: DataFrame, printings: DataFrame, cards: DataFrame, store: Store, checkpoint: str, day: str, name: str = "market") -> tuple[StreamingQuery, BatchStatistics]:
    """Starts the query over a stream of pages (body, card_name, search_rank); pages that are there are taken in, then it ends.

    name: of the stream, the same in every run with this checkpoint.
    """
    spark = pages.sparkSession
    listener = BatchStatistics(store, name)

    def put(df: DataFrame, what: str) -> DataFrame:
        path = storage.fresh_path(spark, f"{name}-{what}")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        tag = f"{name}-{number}"
        landed = put(batch, "found")  # the stream's plan runs once for a batch, and so do its metrics
        found = landed.filter("reason is null").drop("broken_body", "reason")
        lost = landed.filter("reason is not null").withColumn("day", F.lit(day).cast("date"))
        seen = Observation()
        fresh = market.judged(fresh_items(found, store.seen.read(), tag), put(market.title_facts(found), "titles"))
        judged = put(fresh.observe(seen, F.count("*").alias("fresh"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped")), "judged")
        kept = market.kept(judged).withColumns({"store_id": F.lit(MARKET_STORE), "listing_seq": F.col("search_rank") * 1_000_000 + F.col("item_pos")})
        hits = Observation()
        match = matching.match_listings(kept, printings, cards, publish=put)
        matched = put(match.observe(hits, F.count("printing_id").alias("matched"), F.count_if(F.col("printing_id").isNull()).alias("unmatched")), "matched")
        _, history, unmatched = matching.split_matches(matched, day)
        store.history.append(snapshots.new_history(store.history.read({day[:7]}), history, (day, day)), name, number)
        store.unmatched.append(unmatched.withColumn("scraped_at", F.lit(None).cast("timestamp_ntz")), name, number)
        store.finds.append(found.groupBy("card_name").agg(F.count("itemId").alias("n")), name, number)
        store.quarantine.append(lost, name, number)
        # last, as items of a batch that broke off before are not seen yet
        store.seen.append(judged.select(F.col("itemId").alias("item_id"), F.lit(day).cast("date").alias("first_seen"), F.lit(tag).alias("added_by")), name, number)
        listener.counted[number] = {**seen.get, **hits.get}

    spark.streams.addListener(listener)
    sound = F.col("reason").isNull()
    found = market.items_and_broken(pages).observe("found", F.count_if(sound).alias("fetched"), F.count_if(~sound).alias("broken"))
    query = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    listener.run_id = str(query.runId)
    return query, listener


def run_statistics(store: Store, searched: DataFrame) -> DataFrame:
    """The statistics of all batches so far, as one row; searched: card_name of every search that went well."""
    d = store.statistics.read().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    counts = searched.select("card_name").join(store.finds.read().groupBy("card_name").agg(F.sum("n").alias("n")), "card_name", "left")
    counts = counts.agg(F.count("*").alias("searches"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("empty_searches"))
    all_of = F.col("matched") + F.col("unmatched")
    percent = F.when(all_of > 0, F.format_number(F.col("matched") * 100.0 / all_of, 1)).otherwise("0")
    return d.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").select("fetched", (F.col("fetched") - F.col("fresh")).alias("duplicates"), "skipped", "matched", "unmatched", percent.alias("match_percent"), "searches", "empty_searches")
