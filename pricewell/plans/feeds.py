"""Feed payloads derived from the driver tables: each has rows as SQL (for Spark and DuckDB) and the JSON that a feed lands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.plans.views import FULL_NAME, VIEWS, view
from pricewell.storage import fresh_path
from pricewell.storage import shared_dir as landing_dir  # noqa: F401

VIEWS |= {
    "market_items": f"""SELECT concat('i', CAST(l_orderkey AS STRING)) AS item_id,
        (l_orderkey * 10 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rank,
        CASE l_orderkey % 8 WHEN 0 THEN concat('MTG ', {FULL_NAME}, ' Alpha NM Foil x1') WHEN 1 THEN concat({FULL_NAME}, ' - Worldwake - Lightly Played')
        WHEN 2 THEN concat('PSA 9 ', {FULL_NAME}) WHEN 3 THEN concat({FULL_NAME}, ' M11 (', CAST(p_size AS STRING), ') [X] near mint')
        WHEN 4 THEN concat('Bulk ', {FULL_NAME}, ' booster') WHEN 5 THEN concat({FULL_NAME}, ' Theros Beyond Death EX')
        WHEN 6 THEN concat({FULL_NAME}, ' Magic: The Gathering Core Set 2020 #', CAST(p_size AS STRING), ' very good') ELSE {FULL_NAME} END AS title,
        CASE l_linenumber % 4 WHEN 0 THEN 'Used' WHEN 1 THEN 'New/Factory Sealed' WHEN 2 THEN 'Like New' ELSE NULL END AS item_condition,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS amount, CASE WHEN l_suppkey % 7 = 0 THEN 'USD' ELSE 'AUD' END AS currency,
        (l_partkey % 9 <> 0) AS fixed, (l_linenumber % 2 = 0) AS as_bid FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey""",
    "shop_a_entries": f"""SELECT CAST(p_partkey AS STRING) AS uuid, {FULL_NAME} AS name, p_partkey % 5000 + 25 AS price,
        CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END AS set_name, lower(replace(p_brand, '#', '')) AS set_code, p_type AS rarity,
        CAST(p_size % 3 AS INT) AS quantity, CASE WHEN p_partkey % 3 = 0 THEN 'Foil' ELSE 'Nonfoil' END AS finish,
        CASE p_partkey % 5 WHEN 0 THEN 'Regular' WHEN 1 THEN 'Lightly Played' WHEN 2 THEN 'DAMAGED' WHEN 3 THEN 'heavily played' ELSE 'Odd' END AS condition,
        concat('/cards/x/', p_brand, '/', CASE WHEN p_partkey % 8 = 0 THEN '' ELSE CAST(p_size AS STRING) END, CASE WHEN p_partkey % 3 = 0 THEN ':foil' ELSE '' END) AS link_path
        FROM {{part}}""",
    "shop_b_products": f"""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat({FULL_NAME}, ' - ', p_brand) WHEN 1 THEN concat({FULL_NAME}, ' (', p_brand, ')')
        WHEN 2 THEN concat({FULL_NAME}, ' Borderless (0', CAST(100 + p_size AS STRING), ')') WHEN 3 THEN concat({FULL_NAME}, ' Showcase') WHEN 4 THEN concat({FULL_NAME}, ' token')
        WHEN 5 THEN {FULL_NAME} WHEN 6 THEN concat('Some Keep - ', {FULL_NAME}, ' [', p_brand, ']') ELSE concat('Big ', {FULL_NAME}, ' [', p_brand, ']') END AS title,
        concat('h', CAST(p_partkey AS STRING)) AS handle, CASE WHEN p_partkey % 19 = 0 THEN 'Token' ELSE 'Single' END AS product_type,
        (p_partkey % 3 = 0) AS tagged, p_brand AS tag, CASE p_partkey % 4 WHEN 0 THEN 'Near Mint' WHEN 1 THEN 'NM Foil' WHEN 2 THEN 'Lightly Played' ELSE 'mint' END AS option1,
        CASE WHEN p_partkey % 7 = 0 THEN '0.00' ELSE concat(CAST(p_size AS STRING), '.50') END AS price, (p_partkey % 2 = 0) AS has_flag, (p_partkey % 4 = 0) AS available,
        CAST(p_size % 2 AS INT) AS inventory FROM {{part}}""",
    "catalogue_cards": f"""SELECT p_partkey AS pos, concat('p', CAST(p_partkey - p_partkey % 2 AS STRING)) AS id, CASE WHEN p_partkey % 37 = 0 THEN '' ELSE {FULL_NAME} END AS oracle_id,
        {FULL_NAME} AS name, CASE WHEN p_partkey % 10 = 0 THEN 'ja' ELSE 'en' END AS lang, CASE WHEN p_partkey % 13 = 0 THEN 'token' ELSE 'normal' END AS layout,
        (p_partkey % 17 = 0) AS digital, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS type_line, lower(replace(p_brand, '#', '')) AS set_code, p_brand AS set_name,
        CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE '2001-02-03' END AS released_at, CAST(p_size AS STRING) AS collector_number, p_type AS rarity, p_partkey % 3 AS finish_kind,
        CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('u', CAST(p_partkey AS STRING)) END AS image, CASE WHEN p_partkey % 2 = 0 THEN concat('f', CAST(p_partkey AS STRING)) ELSE NULL END AS face_image,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat(CAST(p_size AS STRING), '.25') END AS usd, concat(CAST(p_size AS STRING), '.75') AS usd_foil FROM {{part}}""",
}

#: The market items with the card whose search found each; an order's lines can share l_linenumber, so rank numbers them.
VIEWS["market_finds"] = VIEWS["market_items"].replace(" AS rank,", f" AS rank, {FULL_NAME} AS card_name,", 1)


def market_pages(spark: SparkSession, sf_dir: str, name: str = "market_items") -> DataFrame:
    """search_rank, body: a page of one item each, in the parts of the view's window; card_name too where the view has it."""
    d = view(spark, sf_dir, name)
    offer = F.struct(F.col("amount").alias("value"), "currency")
    none = F.lit(None).cast("struct<value:string,currency:string>")
    item = F.struct(F.col("item_id").alias("itemId"), "title", F.when(F.col("as_bid"), none).otherwise(offer).alias("price"), F.col("item_condition").alias("condition"), F.concat(F.lit("https://m.test/"), "item_id").alias("itemWebUrl"), F.array(F.when(F.col("fixed"), "FIXED_PRICE").otherwise("AUCTION")).alias("buyingOptions"), F.when(F.col("as_bid"), offer).otherwise(none).alias("currentBidPrice"))
    return d.select(*[c for c in d.columns if c == "card_name"], F.col("rank").alias("search_rank"), F.to_json(F.struct(F.array(item).alias("itemSummaries"))).alias("body"))


def shop_a_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "shop_a_entries")
    return d.select(F.to_json(F.struct(F.create_map("uuid", F.struct("*")).alias("uuid_data"))).alias("body"), F.col("uuid").cast("bigint").alias("page"))


def shop_b_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "shop_b_products")
    options = F.array(F.struct(F.lit("Condition").alias("name"), F.array().cast("array<string>").alias("values")))
    variant = F.struct("id", F.col("option1").alias("title"), "price", F.when(F.col("has_flag"), F.col("available")).alias("available"), F.col("inventory").alias("inventory_quantity"), "option1")
    product = F.struct("id", "title", "handle", "product_type", F.when(F.col("tagged"), F.array(F.lit("x"), F.concat(F.lit("Set: "), "tag"))).otherwise(F.array(F.lit("x"))).alias("tags"), options.alias("options"), F.array(variant).alias("variants"))
    return d.select(F.to_json(F.struct(F.array(product).alias("products"))).alias("body"), F.col("id").alias("page"))


def catalogue_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "catalogue_cards")
    finishes = F.when(F.col("finish_kind") == 0, F.array(F.lit("nonfoil"), F.lit("foil"))).when(F.col("finish_kind") == 1, F.array(F.lit("foil"), F.lit("etched"))).otherwise(F.array(F.lit("nonfoil")))
    return d.select("pos", "id", "oracle_id", "name", "lang", "layout", "digital", "type_line", F.col("set_code").alias("set"), "set_name", "released_at", "collector_number", "rarity", finishes.alias("finishes"), F.struct(F.col("image").alias("normal")).alias("image_uris"), F.array(F.struct(F.struct(F.col("face_image").alias("normal")).alias("image_uris"))).alias("card_faces"), F.struct("usd", "usd_foil").alias("prices"))


def catalogue_file(spark: SparkSession, sf_dir: str) -> str:
    """The place of the catalogue landed as JSON lines, each with its `pos`."""
    path = fresh_path(spark, "catalogue")
    catalogue_objects(spark, sf_dir).write.json(path)
    return path


def catalogue_array(spark: SparkSession, sf_dir: str) -> str:
    """The place of the catalogue landed as one JSON array, an object to a line, over as many files as tasks have sorted it."""
    path = fresh_path(spark, "catalogue-array")
    d = catalogue_objects(spark, sf_dir)
    lines = d.select("pos", F.concat(F.lit("  "), F.to_json(F.struct(*d.columns)), F.lit(",")).alias("value"))
    ends = spark.createDataFrame([(-(1 << 62), "["), (1 << 62, "]")], "pos long, value string")
    lines.unionByName(ends).orderBy("pos").select("value").write.text(path)
    return path
