"""The registered jobs take every row of their inputs."""

import pytest
from pyspark.sql import functions as F

from pricewell.functions.rules import MARKET_STORE
from pricewell.plans import registry
from pricewell.plans.views import AS_OF

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF)


def test_market_refresh_takes_every_card_and_page(spark):
    lines, cards = spark.read.parquet(f"{SF}/lineitem.parquet"), registry.Tables(spark, SF).cards
    log = run(spark, "qry9_market_log")
    assert {r["card_name"] for r in log.filter(f"last_searched_at = DATE '{AS_OF}'").collect()} == {r["name"] for r in cards.collect()}
    assert log.agg(F.sum("last_result_count")).first()[0] == lines.count()
    prices = run(spark, "qry9_market_prices").filter(F.col("store_id") == MARKET_STORE).cache()
    assert not prices.filter("url = ''").count() and prices.count()
    history = run(spark, "qry9_market_history").filter(F.col("store_id") == MARKET_STORE)
    assert {r[0] for r in history.select("printing_id").collect()} == {r[0] for r in prices.select("printing_id").collect()}
    judged = registry.market.judged(registry.market.first_seen(registry.market.items(registry.feeds.market_pages(spark, SF, "market_finds")), ["search_rank", "item_pos"]))
    assert prices.count() + run(spark, "qry9_market_unmatched").count() == judged.filter("skip_reason is null").count()


def test_store_refresh_and_stream_give_their_rows(spark):
    prices, history = run(spark, "qry8_store_prices"), run(spark, "str1_listing_history")
    assert "printing_id" in prices.columns and history.columns == ["printing_id", "store_id", "price_type", "recorded_at", "price_aud"]
    assert history.count() == history.select("printing_id", "store_id").distinct().count() > 0


def test_matching_takes_every_line(spark):
    got = run(spark, "qry7_match_all_listings")
    assert got.count() == got.select("listing_seq").distinct().count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
