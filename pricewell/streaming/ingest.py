"""Incremental ingest of listings: new files only, items once however late, matched against a static index, history written once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pricewell import storage
from pricewell.operators import matching, snapshots
from pricewell.operators.published import Table
from pricewell.sources.schemas import TABLES

HISTORY = TABLES["price_history"]
#: The stored table of the items that a stream has taken in; an id can be text or bytes.
SEEN = "item_id BINARY, first_seen DATE"
#: What of a listing is matched, and what of a match is kept for the history.
USED = ("item_id", "listing_seq", "raw_name", "set_code", "set_name", "collector_number", "is_foil", "is_borderless", "price", "store_id", "price_type")
KEPT = ("item_id", "listing_seq", "printing_id", "store_id", "price", "price_type")
#: Keyed state on disk; without files laid out ahead, as most of its stores are small.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def items_once(stream: DataFrame, key: str = "item_id") -> DataFrame:
    """Each item once. There is no watermark: an item is known again however late it comes, and none is dropped for being late."""
    return stream.dropDuplicates([key])


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB stores."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest(columns: list[str]) -> Column:
    """128 bits of the values of these columns, nulls and names included."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def not_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """The first row of each item_id by listing_seq, of items that are not in seen; rows without an id are one item.

    Rows are sent by their id once and sorted where they arrive, not before as well, as few of them are alike.
    """
    n = F.row_number().over(W.partitionBy("item_id").orderBy("listing_seq"))
    first = rows.repartition("item_id").withColumn("_n", n).filter("_n = 1")
    fresh = first.join(seen.select("item_id"), "item_id", "left_anti").select(*rows.columns)
    return fresh if seen.filter("item_id is null").isEmpty() else fresh.filter("item_id is not null")


def ingest_history(
    stream: DataFrame, printings: DataFrame, cards: DataFrame, history_path: str, checkpoint: str, day: str,
    seen: Table | None = None, told_by: list[str] | None = None,
) -> StreamingQuery:
    """Starts the query: each micro-batch is matched and its new history rows are appended by month.

    A batch that is run again after a failure adds nothing, as its keys are there. Only the day's month is read back.

    The stream gives each item once (items_once), and a batch is then written once before it is matched, as the stream with
    its state runs again for each use of it. Or `seen`, a stored table (SEEN), tells items apart by item_id, or by a digest of
    the columns `told_by`: a batch is matched as it comes, and only ids and what the history needs of each listing are sent
    by id and kept. Items are seen once their history is there, so that a batch that broke off before is taken whole again.
    """
    spark = stream.sparkSession
    if seen is not None:
        stream = stream.select(*[c for c in stream.columns if c in USED or c in (told_by or ())])
    layout = HISTORY + ", recorded_month STRING"

    def write(batch: DataFrame, number: int) -> None:
        scratch = storage.fresh_path(spark, f"batch-{number}")
        put = lambda df, name: snapshots.publish(df, scratch, name, "zstd")
        if seen is None:
            matched = matching.match_listings(put(batch, "listings"), printings, cards, publish=put)
        else:
            items = batch if told_by is None else batch.withColumn("item_id", digest(told_by))
            matched = matching.match_listings(items, printings, cards, publish=put)
            matched = put(not_seen(matched.select(*KEPT), seen.read()), "fresh")
        there = storage.listed(spark, history_path)
        old = batch.sparkSession.read.schema(layout).parquet(history_path) if there else spark.createDataFrame([], layout)
        snapshots.write_history(snapshots.new_history(old, matching.history_rows(matched, day), (day, day)), history_path, spread=False)
        if seen is not None:
            seen.append(matched.select("item_id", F.lit(day).cast("date").alias("first_seen")), spread=False)
        storage.removed(spark, scratch)

    with state_on_disk(spark), storage.shuffles_freed(spark):
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
