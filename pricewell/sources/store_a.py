"""Shop A: payloads with a map of entries, and the set codes on its index page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.functions.rules import CONDITIONS_A
from pricewell.functions.text import by_name
from pricewell.sources.schemas import STORE_A_PAYLOAD
from pricewell.sources.tables import adapter, arrival, as_listing, landed_page

BASE_URL = "https://www.mtgmate.com.au"


def entries(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of each payload (a JSON string), with its page and position; payloads without entries give none."""
    parsed = F.from_json(F.col(body), STORE_A_PAYLOAD)
    return payloads.select(landed_page(payloads, body).alias("page"), F.posexplode(F.map_values(parsed["uuid_data"])).alias("position", "e")).select("page", "position", "e.*")


def collector_number(path):
    """The last part of a path before ":"; null if empty."""
    return F.nullif(F.get(F.split(F.element_at(F.split(path, "/"), -1), ":"), F.lit(0)), F.lit(""))


def listing(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("name").alias("raw_name"), F.nullif(F.col("set_code"), F.lit("")).alias("set_code"), F.nullif(F.col("set_name"), F.lit("")).alias("set_name"),
        collector_number(F.col("link_path")).alias("collector_number"), (F.col("price") / 100).cast("decimal(12,2)").alias("price"), F.lit("sell").alias("price_type"),
        by_name(F.lower("condition"), CONDITIONS_A, F.col("condition")).alias("condition"), F.coalesce(F.col("finish") == "Foil", F.lit(False)).alias("is_foil"),
        F.lit(False).alias("is_borderless"), F.coalesce(F.col("quantity") > 0, F.lit(False)).alias("in_stock"), F.concat(F.lit(BASE_URL), "link_path").alias("source_url"),
        arrival(F.col("page"), F.col("position")).alias("listing_seq"),
    )


@adapter("mtg_mate")
def listings(payloads: DataFrame) -> DataFrame:
    return as_listing(listing(entries(payloads)))


def set_codes(pages: DataFrame, html: str = "html", page: str = "page_id", pattern: str = r"magic_sets/([a-z0-9]+)") -> DataFrame:
    """(page, code, pos): the distinct codes of each page, by where each is seen first."""
    hits = pages.select(F.col(page), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("pos", "code"))
    return hits.groupBy(page, "code").agg(F.min("pos").alias("pos"))
