"""Stored tables, the union of feeds and the shop dimension."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions.rules import STORES
from pricewell.sources.schemas import LISTING, TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table under its declared schema, so that scans are pruned and never infer."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def listing_columns() -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in LISTING.replace("DECIMAL(12,2)", "DECIMAL(12;2)").replace("\n", " ").split(",")]


def as_listing(df: DataFrame) -> DataFrame:
    """df in the listing contract: its columns, their types, null where it has none."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t.replace(";", ",")).alias(c) for c, t in listing_columns()])


def landed_page(df: DataFrame, body: str) -> Column:
    """The number under which a page landed (its column `page`), or one from its text: alike however files are split."""
    return F.col("page").cast("bigint") if "page" in df.columns else F.pmod(F.xxhash64(body), F.lit(1 << 40))


def broken_pages(pages: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """The landed pages whose text is no JSON object of the schema, whole and with the reason: what a quarantine table gets.

    An adapter gives no rows for them. A page without items, such as {}, is sound; a null or blank one is empty.
    """
    return pages.select("*", why_broken(F.col(body), page_json(F.col(body), schema)).alias("reason")).filter("reason is not null")


CORRUPT = "_corrupt_record"


def page_json(body: Column, schema: str) -> Column:
    """A page's text as a struct of the schema, with a last field for a text that is none."""
    return F.from_json(body, f"{schema}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})


def why_broken(body: Column, parsed: Column) -> Column:
    """Why a page goes to quarantine, null if it is sound; parsed: its page_json()."""
    blank = F.trim(F.coalesce(body, F.lit(""))) == ""
    return F.when(blank, "empty").when(parsed.isNull() | parsed[CORRUPT].isNotNull(), "not JSON of a page")


def arrival(page: Column, position: Column) -> Column:
    """listing_seq by page and position on it (below a million)."""
    return (page * 1_000_000 + position).cast("bigint")


#: Feed adapters by store id: landed rows -> listings.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(store_id: str):
    """Registers a feed adapter; the registry is the extension point for new shops."""

    def register(f: Callable[[DataFrame], DataFrame]):
        ADAPTERS[store_id] = f
        return f

    return register


def union_feeds(landed: dict[str, DataFrame]) -> DataFrame:
    """Listings of all feeds that have an adapter, in one shape."""
    feeds = [as_listing(ADAPTERS[s](df).withColumn("source", F.lit(s))) for s, df in landed.items() if s in ADAPTERS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def store_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STORES, "id STRING, name STRING, base_url STRING, scraper_enabled BOOLEAN")


def runnable_stores(stores: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enabled stores that have an adapter, and those that have none; registered has a column id."""
    enabled = stores.filter("scraper_enabled")
    return enabled.join(registered, "id", "left_semi"), enabled.join(registered, "id", "left_anti")


def registered_adapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sorted(ADAPTERS)], "id STRING")
