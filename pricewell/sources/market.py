"""The market: search pages of items with free-text titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.functions.rules import FIELD_CONDITIONS, FOIL_WORD, SKIP_TITLES, TITLE_CONDITIONS, TITLE_NOISE, TITLE_SETS, ascii_words
from pricewell.functions.text import first_match, found_any, money, plain_spaces
from pricewell.functions.text import found as found_text
from pricewell.sources.schemas import MARKET_PAGE
from pricewell.sources.tables import page_json, why_broken


def items(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of each page (a JSON string), with the page's other columns; pages without items give none.

    The outer form, as for the other one Spark adds a filter on the array, for which each page is parsed twice more.
    """
    parsed = pages.withColumn("_page", F.from_json(F.col(body), MARKET_PAGE)).drop(body)
    d = parsed.select(*[c for c in parsed.columns if c != "_page"], F.posexplode_outer(F.col("_page.itemSummaries")).alias("item_pos", "item"))
    return d.filter("item_pos is not null").select("*", "item.*").drop("item")


def items_and_broken(pages: DataFrame, body: str = "body") -> DataFrame:
    """items(), and in the same pass a row with `broken_body` and `reason`, and no item, for each page that broken_pages() reports.

    A page of which only a further field is amiss gives both its items and such a row, as items() and broken_pages() do.
    """
    d = pages.withColumn("_page", page_json(F.col(body), MARKET_PAGE)).withColumn("_reason", why_broken(F.col(body), F.col("_page")))
    row = lambda pos, item, text, reason: F.struct(pos.cast("int").alias("item_pos"), item.alias("item"), text.cast("string").alias("broken_body"), reason.cast("string").alias("reason"))
    none, all_items = F.lit(None), F.col("_page.itemSummaries")
    broken = F.filter(F.array(row(none, F.get(all_items, F.lit(-1)), F.col(body), F.col("_reason"))), lambda x: x["reason"].isNotNull())
    found = F.transform(F.coalesce(all_items, F.array()), lambda x, k: row(k, x, none, none))
    others = [c for c in pages.columns if c != body]
    d = d.select(*others, F.explode_outer(F.concat(broken, found)).alias("_row")).filter("_row is not null")
    return d.select(*others, "_row.*").select("*", "item.*").drop("item")


def first_seen(found: DataFrame, order: list[str]) -> DataFrame:
    """One row per item id, the first in the given order."""
    n = F.row_number().over(W.partitionBy("itemId").orderBy(*order))
    return found.withColumn("_n", n).filter("_n = 1").drop("_n")


def title_name(title: Column, set_name: Column) -> Column:
    """What is left of a title without its set's name and the noise."""
    quoted = F.concat(F.lit(r"(?i)\Q"), set_name, F.lit(r"\E"))
    out = F.when(set_name.isNotNull(), F.regexp_replace(title, quoted, F.lit(""))).otherwise(title)
    for p in TITLE_NOISE:
        out = F.regexp_replace(out, ascii_words(p), " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def price(offer: Column, bid: Column) -> Column:
    """The offer's price, else the current bid, in AUD and over 0, else null."""
    p = F.coalesce(offer, bid)
    value = money(p["value"])
    return F.when((p["currency"] == "AUD") & (value > 0), value)


def title_facts(found: DataFrame) -> DataFrame:
    """What the patterns say of each distinct title: _title, _set, _condition, _skip, _foil, _name.

    The number of partitions is given, as titles are small but their patterns take time.
    """
    spark = found.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    d = found.select(F.coalesce("title", F.lit("")).alias("_title")).distinct().repartition(parts, "_title")
    d = d.withColumn("_t", plain_spaces(F.col("_title"))).withColumn("_low", F.lower("_t"))
    title, low = F.col("_t"), F.col("_low")
    d = d.withColumns({"_set": first_match(title, TITLE_SETS, low), "_condition": first_match(title, TITLE_CONDITIONS, low), "_skip": found_any(title, SKIP_TITLES, low), "_foil": found_text(title, FOIL_WORD, low)})
    return d.withColumn("_name", title_name(title, F.col("_set"))).drop("_t", "_low")


def judged(found: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The items with listing columns and skip_reason, the first guard that refuses an item, null if none does.

    facts: title_facts() of at least these items, where they are written already.
    """
    kept = [c for c in found.columns if c not in ("price", "currentBidPrice", "condition", "title", "buyingOptions", "itemWebUrl")]
    d = found.withColumns({"_title": F.coalesce("title", F.lit("")), "_field": F.lower(F.coalesce("condition", F.lit(""))), "_price": price(F.col("price"), F.col("currentBidPrice"))})
    d = d.join(title_facts(found) if facts is None else facts, "_title", "left")
    field = F.col("_field")
    reason = F.when(field.contains("sealed") | field.contains("new/factory"), "sealed").when(F.col("_skip"), "title").when(F.col("_price").isNull(), "price").when(~F.coalesce(F.array_contains("buyingOptions", "FIXED_PRICE"), F.lit(False)), "auction").when(F.length("_name") < 2, "name")
    condition_code = F.coalesce("_condition", *[F.when(field.contains(k), F.lit(v)) for k, v in FIELD_CONDITIONS])
    return d.select(*kept, "title", F.col("_name").alias("raw_name"), F.col("_set").alias("set_name"), F.col("_price").alias("price"), condition_code.alias("condition"), F.col("_foil").alias("is_foil"), F.col("itemWebUrl").alias("source_url"), reason.alias("skip_reason"))


def kept(judged_items: DataFrame) -> DataFrame:
    """The judged items that no guard refuses, as listings; items that are listed are in stock."""
    none = F.lit(None).cast("string")
    return judged_items.filter("skip_reason is null").withColumns({"set_code": none, "collector_number": none, "price_type": F.lit("sell"), "in_stock": F.lit(True), "is_borderless": F.lit(False)}).drop("skip_reason")


def listings(found: DataFrame) -> DataFrame:
    return kept(judged(found))
