"""Schemas of the inputs and of the stored tables, as DDL."""

CATALOGUE_CARD = """id STRING, oracle_id STRING, name STRING, lang STRING, layout STRING, digital BOOLEAN, mana_cost STRING,
type_line STRING, oracle_text STRING, colors ARRAY<STRING>, color_identity ARRAY<STRING>, legalities MAP<STRING,STRING>,
`set` STRING, set_name STRING, released_at STRING, collector_number STRING, rarity STRING, finishes ARRAY<STRING>,
image_uris STRUCT<normal:STRING>, card_faces ARRAY<STRUCT<image_uris:STRUCT<normal:STRING>>>, scryfall_uri STRING,
prices STRUCT<usd:STRING,usd_foil:STRING>"""

STORE_A_PAYLOAD = """uuid_data MAP<STRING,STRUCT<uuid:STRING,name:STRING,price:BIGINT,set_name:STRING,set_code:STRING,
rarity:STRING,quantity:INT,finish:STRING,condition:STRING,link_path:STRING>>"""

STORE_B_PAGE = """products ARRAY<STRUCT<id:BIGINT,title:STRING,handle:STRING,product_type:STRING,tags:ARRAY<STRING>,
options:ARRAY<STRUCT<name:STRING,values:ARRAY<STRING>>>,variants:ARRAY<STRUCT<id:BIGINT,title:STRING,price:STRING,
available:BOOLEAN,inventory_quantity:INT,option1:STRING,option2:STRING,option3:STRING>>>>"""

MARKET_PAGE = """itemSummaries ARRAY<STRUCT<itemId:STRING,title:STRING,price:STRUCT<value:STRING,currency:STRING>,
condition:STRING,itemWebUrl:STRING,buyingOptions:ARRAY<STRING>,currentBidPrice:STRUCT<value:STRING,currency:STRING>>>,
total INT, `limit` INT, `offset` INT"""

#: What every feed yields.
LISTING = """source STRING, listing_seq BIGINT, raw_name STRING, set_code STRING, set_name STRING, collector_number STRING,
price DECIMAL(12,2), price_type STRING, condition STRING, is_foil BOOLEAN, is_borderless BOOLEAN, in_stock BOOLEAN,
source_url STRING"""

TABLES = {
    "cards": """id STRING, name STRING, mana_cost STRING, type_line STRING, oracle_text STRING, colors ARRAY<STRING>,
        color_identity ARRAY<STRING>, legalities MAP<STRING,STRING>, updated_at TIMESTAMP_NTZ""",
    "printings": """id STRING, card_id STRING, set_code STRING, set_name STRING, released_at DATE, collector_number STRING,
        rarity STRING, is_foil BOOLEAN, image_uri STRING, scryfall_uri STRING, usd_price DECIMAL(12,2), updated_at TIMESTAMP_NTZ""",
    "stores": "id STRING, name STRING, base_url STRING, scraper_enabled BOOLEAN, created_at TIMESTAMP_NTZ",
    "store_prices": """printing_id STRING, store_id STRING, price_aud DECIMAL(12,2), price_type STRING, condition STRING,
        in_stock BOOLEAN, url STRING, scraped_at TIMESTAMP_NTZ""",
    "price_history": "printing_id STRING, store_id STRING, price_aud DECIMAL(12,2), price_type STRING, recorded_at DATE",
    "unmatched_cards": """store_id STRING, raw_name STRING, raw_set_name STRING, raw_price DECIMAL(12,2), source_url STRING,
        scraped_at TIMESTAMP_NTZ""",
    "search_log": "card_name STRING, last_searched_at DATE, last_result_count INT",
}
