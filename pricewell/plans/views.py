"""The price tables derived from the driver tables `part`, `lineitem` and `supplier`.

One SQL text per view; it means the same to Spark and to DuckDB, which checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-11-05"
FULL_NAME = "concat(p_name, ' ', p_type)"
PRICE_TYPE = "CASE WHEN l_returnflag = 'R' THEN 'buylist' ELSE 'sell' END"

VIEWS = {
    "cards": f"""SELECT {FULL_NAME} AS id, {FULL_NAME} AS name, min(p_type) AS type_line FROM {{part}} GROUP BY {FULL_NAME}""",
    "printings": f"""SELECT CAST(p_partkey AS STRING) AS id, {FULL_NAME} AS card_id, lower(replace(p_brand, '#', '')) AS set_code,
        p_brand AS set_name, CASE WHEN p_partkey % 20 = 0 THEN DATE '2001-10-20' WHEN p_partkey % 20 = 1 THEN DATE '2001-09-01'
        ELSE make_date(CAST(1995 + p_partkey % 6 AS INT), CAST(1 + p_partkey % 12 AS INT), CAST(1 + p_partkey % 28 AS INT)) END AS released_at,
        CASE WHEN p_partkey % 11 = 0 THEN concat(CAST(p_size AS STRING), 'a') WHEN p_partkey % 13 = 0 THEN concat('s', CAST(p_size AS STRING))
        ELSE CAST(p_size AS STRING) END AS collector_number, p_type AS rarity, (p_partkey % 3 = 0) AS is_foil,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('https://img.test/normal/', CAST(p_partkey AS STRING), '.jpg') END AS image_uri,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(CAST(p_size * p_size AS DECIMAL(12,2)) / 100 AS DECIMAL(12,2)) END AS usd_price
        FROM {{part}}""",
    "stores": "SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name, (s_suppkey % 4 <> 0) AS scraper_enabled FROM {supplier}",
    "store_prices": f"""SELECT CAST(l_partkey AS STRING) AS printing_id, CAST(l_suppkey AS STRING) AS store_id,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS price_aud, {PRICE_TYPE} AS price_type,
        CASE l_linenumber % 3 WHEN 0 THEN 'NM' WHEN 1 THEN 'LP' ELSE NULL END AS condition, (l_linestatus = 'O') AS in_stock
        FROM {{lineitem}}""",
    "price_history": f"""SELECT printing_id, store_id, price_type, recorded_at, price_aud FROM (SELECT CAST(l_partkey AS STRING) AS printing_id,
        CAST(l_suppkey AS STRING) AS store_id, {PRICE_TYPE} AS price_type, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS recorded_at,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS price_aud, row_number() OVER (PARTITION BY l_partkey, l_suppkey, {PRICE_TYPE},
        date_trunc('quarter', l_shipdate) ORDER BY l_orderkey, l_linenumber) AS rn FROM {{lineitem}}) t WHERE rn = 1""",
    "search_log": f"""SELECT name AS card_name, DATE '{AS_OF}' - CAST(rn % 35 AS INT) AS last_searched_at,
        CAST(CASE WHEN rn % 4 = 0 THEN 0 ELSE rn % 9 + 1 END AS INT) AS last_result_count FROM (SELECT {FULL_NAME} AS name,
        row_number() OVER (ORDER BY {FULL_NAME}) AS rn FROM {{part}} GROUP BY {FULL_NAME}) t WHERE rn % 6 <> 0""",
    # lines can share order and line number, so a further number tells them apart
    "listings": f"""SELECT (l_orderkey * 10 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_extendedprice) AS listing_seq, CASE l_orderkey % 5 WHEN 0 THEN upper({FULL_NAME})
        WHEN 1 THEN concat(p_name, ' - ', p_type, ' (Borderless 12) [X]') WHEN 2 THEN replace({FULL_NAME}, 'e', '')
        WHEN 3 THEN {FULL_NAME} ELSE concat('zz ', p_name, ' qq') END AS raw_name, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE p_brand END AS set_name,
        CASE WHEN l_orderkey % 4 = 0 THEN CAST(p_size AS STRING) ELSE NULL END AS collector_number, (l_partkey % 3 = 0) AS is_foil,
        (l_orderkey % 5 = 1) AS is_borderless, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_suppkey AS STRING) AS store_id
        FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey""",
}

# names of cards that are there in the other finish only, or in both
VIEWS["finish_listings"] = f"""SELECT CAST(p_partkey AS BIGINT) AS listing_seq, {FULL_NAME} AS raw_name, CAST(NULL AS STRING) AS set_name, CAST(NULL AS STRING) AS collector_number,
    (p_partkey % 3 <> 0) AS is_foil, (p_partkey % 2 = 0) AS is_borderless, CAST(p_retailprice AS DECIMAL(12,2)) AS price, 'x' AS store_id FROM {{part}}"""
VIEWS["searches"] = """SELECT DISTINCT query, literal FROM (SELECT split_part(p_name, ' ', 2) AS query, false AS literal FROM {part}
    UNION ALL SELECT substring(p_type, 1, 2) AS query, true AS literal FROM {part} UNION ALL SELECT concat(substring(p_type, 2, 3), '%', substring(p_name, 1, 1)) AS query, false AS literal FROM {part}
    UNION ALL SELECT concat(upper(substring(p_name, 1, 4)), '_', substring(p_name, 6, 2)) AS query, (p_partkey % 2 = 0) AS literal FROM {part}
    UNION ALL SELECT substring(p_brand, 1, 1) AS query, true AS literal FROM {part} UNION ALL SELECT '%' AS query, false AS literal FROM {part} UNION ALL SELECT ' ' AS query, false AS literal FROM {part}) x"""
VIEWS["set_pages"] = """SELECT p_partkey AS page_id, concat('<a href="/magic_sets/', lower(replace(p_brand, '#', '')), '">', p_name, '</a> <a href="/magic_sets/M', CAST(p_size AS STRING), '"> <a href="/magic_sets/m',
    CAST(p_size AS STRING), '/foil"> <a href="/magic_sets/', lower(replace(p_brand, '#', '')), '#top">') AS html FROM {part}"""
VIEWS["all_listings"] = VIEWS["listings"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "lineitem") if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(names: list[str], sql: str) -> str:
    """The query after the views it needs; SQL that starts with a comma goes on with more common table expressions."""
    tables = {t: t for t in ("part", "supplier", "lineitem")}
    views = "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**tables)})" for n in names)
    return views + ("" if sql.lstrip().startswith(",") else " ") + sql
