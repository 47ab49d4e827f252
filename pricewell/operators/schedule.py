"""Which cards are due for a search on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.functions.rules import TIERS


def tier(released: Column, usd: Column, as_of: str) -> Column:
    day = F.lit(as_of).cast("date")
    return F.when(released >= F.date_sub(day, 30), "hot").when((released >= F.date_sub(day, 90)) | (usd >= 20), "active").when(usd >= 2, "longTail").otherwise("skip")


def card_tiers(cards: DataFrame, printings: DataFrame, as_of: str) -> DataFrame:
    """card_name, latest_released, max_usd (no price counts 0), tier."""
    d = cards.select(F.col("id").alias("card_id"), F.col("name").alias("card_name")).join(printings.select("card_id", "released_at", "usd_price"), "card_id")
    d = d.groupBy("card_name").agg(F.max("released_at").alias("latest_released"), F.max(F.coalesce("usd_price", F.lit(0).cast("decimal(12,2)"))).alias("max_usd"))
    return d.withColumn("tier", tier(F.col("latest_released"), F.col("max_usd"), as_of))


def due_cards(cards: DataFrame, printings: DataFrame, search_log: DataFrame, as_of: str) -> DataFrame:
    """card_name, tier, tier_rank of the cards to search: never searched, or longer ago than the tier's wait (strictly)."""
    waits = cards.sparkSession.createDataFrame(TIERS, "tier STRING, tier_rank INT, after_hits INT, after_none INT")
    d = card_tiers(cards, printings, as_of).join(F.broadcast(waits), "tier").join(search_log, "card_name", "left")
    since = lambda wait: F.expr(f"last_searched_at < date_sub(DATE '{as_of}', {wait})")
    due = F.col("last_searched_at").isNull() | ((F.col("last_result_count") > 0) & since("after_hits")) | ((F.col("last_result_count") == 0) & since("after_none"))
    return d.filter(due).select("card_name", "tier", "tier_rank")


def due_order(due: DataFrame) -> DataFrame:
    return due.orderBy("tier_rank", "card_name")


def due_places(due: DataFrame) -> DataFrame:
    """due with `place`, from 1 on within each tier, in due_order()."""
    return due.withColumn("place", F.row_number().over(W.partitionBy("tier_rank").orderBy("card_name")))


def due_counts(due: DataFrame) -> DataFrame:
    return due.groupBy("tier").agg(F.count("*").alias("n"))
