"""Batch jobs: catalogue, shop and market refresh. Each gives the new snapshots; publishing them is the caller's.

The matched listings feed every output of a job. `publish` (table, name) -> table writes them once and gives them back, for
the outputs to be derived from; without it each output works them out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.functions.rules import MARKET_STORE
from pricewell.operators import matching, quality, snapshots
from pricewell.sources import catalogue, market
from pricewell.sources.schemas import MARKET_PAGE
from pricewell.sources.tables import broken_pages


def refresh_catalogue(landed: DataFrame, cards: DataFrame | None = None, printings: DataFrame | None = None) -> dict[str, DataFrame]:
    new_cards, new_printings = catalogue.card_rows(landed), catalogue.printing_rows(landed)
    return {
        "cards": new_cards if cards is None else snapshots.upsert(cards, new_cards, ["id"]),
        "printings": new_printings if printings is None else snapshots.upsert(printings, new_printings, ["id"], [c for c in snapshots.PRINTING_REFRESH if c in new_printings.columns]),
    }


Publish = Callable[[DataFrame, str], DataFrame]


def _as_it_is(df: DataFrame, name: str) -> DataFrame:
    return df


def refresh_stores(listings: DataFrame, tables: dict[str, DataFrame], ran: DataFrame, day: str, publish: Publish = _as_it_is) -> dict[str, DataFrame]:
    """listings carry store_id; ran has the store_id of every store that ran, those without listings included."""
    matched = publish(matching.match_listings(listings, tables["printings"], tables["cards"], publish=publish), "matched")
    prices, history, unmatched = matching.split_matches(matched, day)
    return {
        "store_prices": snapshots.replace_store(tables["store_prices"], prices, ran),
        "price_history": snapshots.append_history(tables["price_history"], history, (day, day)),
        "unmatched_cards": snapshots.replace_store(tables["unmatched_cards"], unmatched, ran),
        "statistics": quality.totals(matched),
    }


def refresh_market(pages: DataFrame, searched: DataFrame, tables: dict[str, DataFrame], day: str, publish: Publish = _as_it_is) -> dict[str, DataFrame]:
    """pages: body, card_name, search_rank of landed searches; searched: card_name, status.

    Old prices of successfully searched cards go, whatever the order of the searches; new matches, once per item, come.
    Failed searches leave prices and log as they are. Unmatched listings are only added. Pages that don't parse are in
    `quarantine`, and their number is that table's.
    """
    found = publish(market.items(pages), "found")
    unique = publish(market.first_seen(found, ["search_rank", "item_pos"]), "items")
    judged = market.judged(unique, publish(market.title_facts(unique), "titles"))
    kept = market.kept(judged).withColumn("store_id", F.lit(MARKET_STORE)).withColumn("listing_seq", F.col("search_rank") * 1_000_000 + F.col("item_pos"))
    matched = publish(matching.match_listings(kept, tables["printings"], tables["cards"], publish=publish), "matched")
    prices, history, unmatched = matching.split_matches(matched, day)
    ok = searched.filter("status = 'ok'")
    per_card = found.groupBy("card_name").agg(F.count("itemId").alias("n"))  # before the join, as few cards can have most items
    counts = ok.join(per_card, "card_name", "left").groupBy("card_name").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("n"))
    log = counts.select("card_name", F.lit(day).cast("date").alias("last_searched_at"), F.col("n").alias("last_result_count"))
    cleared = snapshots.clear_cards(tables["store_prices"], tables["printings"], tables["cards"], ok, MARKET_STORE)
    return {
        "store_prices": cleared.unionByName(prices, allowMissingColumns=True),
        "price_history": snapshots.append_history(tables["price_history"], history, (day, day)),
        "unmatched_cards": tables["unmatched_cards"].unionByName(unmatched, allowMissingColumns=True),
        "search_log": snapshots.upsert(tables["search_log"], log, ["card_name"], snapshots.LOG_REFRESH),
        "statistics": quality.run_statistics(found, judged, matched, counts),
        "quarantine": broken_pages(pages, MARKET_PAGE),
    }
