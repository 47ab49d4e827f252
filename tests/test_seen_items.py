"""Listings told apart by a stored table of ids: once however late, whole after a break, without keyed state or left shuffle files."""

import time

import pytest
from pyspark.sql import functions as F

from pricewell import storage
from pricewell.operators.published import Months, Table
from pricewell.plans import registry
from pricewell.sources.schemas import TABLES
from pricewell.streaming import ingest

DAY, SF = "2001-11-05", "/root/testdata/sf0.001"
SHAPE = "listing_seq long, item_id string, raw_name string"
TEXT = "item_id STRING, first_seen DATE"


def name(k):
    return f"Wandering {chr(97 + k % 26) * 4} {chr(97 + k // 26) * 4}"


class Feed:
    def __init__(self, spark, tmp_path, schema=TEXT, told_by=None):
        self.spark, self.told_by = spark, told_by
        self.src, self.out, self.state = (str(tmp_path / x) for x in ("in", "out", "state"))
        self.seen = Table(spark, f"file://{tmp_path}/seen", schema, Months("first_seen"))
        self.cards = spark.createDataFrame([(f"c{k}", name(k)) for k in range(40)], "id string, name string")
        card = F.col("id")
        self.printings = self.cards.select(F.concat(F.lit("p"), card).alias("id"), card.alias("card_id"), F.lit("s").alias("set_code"), F.lit("Set").alias("set_name"), F.lit("1").alias("collector_number"), F.lit(False).alias("is_foil"))

    def run(self, rows=()):
        none = F.lit(None).cast("string")
        d = self.spark.createDataFrame(rows, SHAPE).withColumns({"set_name": none, "collector_number": none, "is_foil": F.lit(False), "price": (F.col("listing_seq") + 1).cast("decimal(12,2)"), "store_id": F.lit("s"), "price_type": F.lit("sell")})
        if rows:
            d.coalesce(1).write.mode("append").parquet(self.src)
        stream = ingest.read_stream(self.spark, self.src, d.schema)
        ingest.ingest_history(stream, self.printings, self.cards, self.out, self.state, DAY, self.seen, self.told_by).awaitTermination()

    def history(self):
        got = self.spark.read.schema(TABLES["price_history"]).parquet(self.out).collect()
        return sorted((r.printing_id, int(r.price_aud)) for r in got)


def test_late_and_repeated_items_come_once(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.run([(2, "a", name(2)), (1, "a", name(1)), (3, "b", name(3)), (4, None, name(4)), (8, "d", "Nobody knows this")])
    feed.run([(0, "a", name(5)), (9, "c", name(3)), (7, None, name(6)), (5, "d", name(7)), (6, "e", name(8)), (5, "e", name(9))])
    feed.run()
    assert feed.history() == [("pc1", 2), ("pc3", 4), ("pc4", 5), ("pc9", 6)]
    assert sorted(str(r.item_id) for r in feed.seen.read().collect()) == ["None", "a", "b", "c", "d", "e"]
    assert not (tmp_path / "state" / "state").exists()


def test_items_told_by_their_columns_after_a_batch_that_breaks_off(spark, tmp_path, monkeypatch):
    feed, right = Feed(spark, tmp_path, ingest.SEEN, ["listing_seq", "raw_name"]), Table.append

    def broken(*_, **__):
        raise OSError("the write broke off")

    monkeypatch.setattr(Table, "append", broken)
    with pytest.raises(Exception, match="broke off"):
        feed.run([(1, "x", name(1)), (2, "x", name(2)), (2, "y", name(2)), (3, "x", None)])
    monkeypatch.setattr(Table, "append", right)
    feed.run([(1, "z", name(1)), (1, "x", name(3)), (3, "w", None)])
    assert feed.history() == [("pc1", 2), ("pc2", 3), ("pc3", 2)]
    assert feed.seen.read().agg(F.count("*"), F.countDistinct("item_id"), F.max(F.length("item_id"))).first()[:] == (4, 4, 16)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString(",").split(",") if "/shuffle_" in f}


def left(spark, before):
    """The shuffle files that stay beside those of before; Spark deletes them soon after a job."""
    for _ in range(50):
        if not (more := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return more


def test_shuffles_are_freed_when_a_table_is_written(spark, tmp_path):
    d = spark.range(100_000).repartition("id").withColumn("k", F.col("id") % 100)
    before = shuffle_files(spark)
    with storage.shuffles_freed(spark):
        d.groupBy("k").agg(F.sum("id")).write.parquet(str(tmp_path / "a"))
    assert not left(spark, before)
    assert spark.read.parquet(str(tmp_path / "a")).count() == d.select("k").distinct().count() == 100


def test_listing_history_keeps_an_id_of_each_item_and_leaves_no_shuffles(spark, monkeypatch):
    made, right = {}, registry.fresh_path

    def path(session, what):
        made[what] = right(session, what)
        return made[what]

    monkeypatch.setattr(registry, "fresh_path", path)
    before = shuffle_files(spark)
    registry.queries()["str1_listing_history"](spark, SF)
    assert not left(spark, before)
    assert "state" not in {n for n, _, _ in storage.listed(spark, made["str1-state"])}
    seen = Table(spark, made["str1-seen"], ingest.SEEN, Months("first_seen")).read()
    lines = registry.Tables(spark, SF).listings.count()
    assert seen.agg(F.count("*"), F.countDistinct("item_id"), F.max(F.length("item_id"))).first()[:] == (lines, lines, 16)
