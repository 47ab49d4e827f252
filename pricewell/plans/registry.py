"""The named queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell import storage
from pricewell.functions import rules, text
from pricewell.operators import clustered, matching, prices, published, quality, schedule, search, snapshots
from pricewell.operators.published import Buckets, Months, Table
from pricewell.plans import feeds, jobs
from pricewell.plans.views import AS_OF, oracle, view
from pricewell.sources import catalogue, market, store_a, store_b, tables
from pricewell.sources.schemas import MARKET_PAGE, TABLES
from pricewell.storage import fresh_path
from pricewell.streaming import ingest
from pricewell.streaming import market as market_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The derived tables by name: t.cards, t.printings, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(names: str = "", sql: str | None = None):
    """Registers a query under its function's name; `names` are the views that its SQL uses."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = oracle(names.split(), sql) if names else sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


LIVE = "in_stock AND price_type = 'sell'"
TREND = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN NULL WHEN {0} > {1} * 1.01 THEN 'up' WHEN {0} < {1} * 0.99 THEN 'down' ELSE 'neutral' END"
DBL = "CAST(price_aud AS DOUBLE)"
#: Common table expressions of the search query, after the views.
BEST = f"""live AS (SELECT printing_id, min(price_aud) AS min_price, quantile_cont({DBL}, 0.5) AS market_price FROM store_prices WHERE {LIVE} GROUP BY 1),
 best AS (SELECT * FROM (SELECT p.card_id, l.*, row_number() OVER (PARTITION BY p.card_id ORDER BY l.min_price, l.printing_id) AS n FROM printings p JOIN live l ON l.printing_id = p.id) x WHERE n = 1),
 lastday AS (SELECT printing_id, avg({DBL}) AS past_price FROM (SELECT *, max(recorded_at) OVER (PARTITION BY printing_id) AS last FROM price_history WHERE price_type = 'sell') h WHERE recorded_at = last GROUP BY 1)"""
CURRENT = f"""cur AS (SELECT card_id, quantile_cont({DBL}, 0.5) AS current_price FROM store_prices s JOIN printings p ON p.id = s.printing_id WHERE {LIVE} GROUP BY 1),
 past AS (SELECT card_id, avg({DBL}) AS past_price FROM (SELECT card_id, price_aud, recorded_at, max(recorded_at) OVER (PARTITION BY card_id) AS last FROM price_history h JOIN printings p ON p.id = h.printing_id WHERE price_type = 'sell') x WHERE recorded_at = last GROUP BY 1)"""
SEARCH = f""", {BEST} SELECT c.id, c.name, c.type_line, (SELECT count(DISTINCT p.id) FROM printings p WHERE p.card_id = c.id)::INT AS printing_count, i.image_uri,
 round(b.market_price, 4) AS market_price, {TREND.format("b.market_price", "h.past_price")} AS trend FROM cards c
 LEFT JOIN (SELECT * FROM (SELECT card_id, image_uri, row_number() OVER (PARTITION BY card_id ORDER BY released_at DESC, id) AS n FROM printings WHERE image_uri IS NOT NULL AND NOT is_foil) x WHERE n = 1) i ON i.card_id = c.id
 LEFT JOIN best b ON b.card_id = c.id LEFT JOIN lastday h ON h.printing_id = b.printing_id WHERE c.name ILIKE '%ring%'"""


READ = "cards printings store_prices price_history"


@query(READ, SEARCH)
def qry1_card_search(t):
    return prices.search(t.cards, t.printings, t.store_prices, t.price_history, "ring", publisher(t)).withColumn("market_price", F.round("market_price", 4))


@query(READ, SEARCH + " ORDER BY c.name, c.id LIMIT 20 OFFSET 20")
def ord1_search_page(t):
    return prices.page(qry1_card_search(t), 20)


@query("cards", "SELECT count(*) AS n FROM cards WHERE name ILIKE '%ring%'")
def agg6_search_count(t):
    return prices.count_cards(t.cards, "ring")


SEARCHED = [("ring", False), ("r_d", False), ("r_d", True), ("re%d", True), ("  ", False), ("brushed", False)]


def _hits(q: str, literal: bool) -> str:
    if not q.strip():
        return "false"
    return f"contains(lower(name), '{q}')" if literal else f"name ILIKE '%{q}%'"


@query("cards", " UNION ALL ".join(f"SELECT '{q}' AS query, {literal} AS literal, count(*) AS n, count(*) >= 20 AS has_more FROM cards WHERE {_hits(q, literal)}" for q, literal in SEARCHED))
def flt7_search_sizes(t):
    """Hits and "is there more" of some searches, blank and literal ones among them."""
    out = None
    for q, literal in SEARCHED:
        page = prices.has_more(prices.page(prices.find_cards(t.cards, q, literal)))
        one = prices.count_cards(t.cards, q, literal).unionByName(page, allowMissingColumns=True).agg(F.max("n").alias("n"), F.bool_or("has_more").alias("has_more"))
        one = one.select(F.lit(q).alias("query"), F.lit(literal).alias("literal"), "n", "has_more")
        out = one if out is None else out.unionByName(one)
    return out


@query("cards", "SELECT id, name, NULL::VARCHAR AS mana_cost, type_line, NULL::VARCHAR AS oracle_text, split_part(type_line, ' ', 1) AS colors FROM cards WHERE id = (SELECT max(id) FROM cards)")
def flt8_card(t):
    none = F.lit(None).cast("string")
    cards = t.cards.withColumns({"mana_cost": none, "oracle_text": none, "colors": F.split("type_line", " ")})
    return prices.get_card(cards, t.cards.agg(F.max("id")).first()[0]).withColumn("colors", F.col("colors")[0])


@query("printings", "SELECT id, card_id, set_name FROM printings WHERE is_foil OR id = '7'")
def flt11_pinned_printings(t):
    return prices.pinned(t.printings, F.col("is_foil"), "7").select("id", "card_id", "set_name")


@query("cards", "SELECT id, coalesce(nullif(array_to_string(list_filter(string_split(type_line, ' '), lambda x: starts_with(x, 'S')), ','), ''), 'C') AS pips FROM cards")
def scl28_colour_pips(t):
    colors = F.filter(F.split("type_line", " "), lambda x: x.startswith("S"))
    return t.cards.select("id", F.array_join(prices.colour_pips(colors), ",").alias("pips"))


@query("cards", "SELECT id, name FROM cards WHERE name ILIKE '%r_d%t%'")
def flt6_wildcards(t):
    return prices.find_cards(t.cards, "r_d%t").select("id", "name")


@query(READ, f", {CURRENT} SELECT c.id, round(current_price, 4) AS current_price, round(past_price, 4) AS past_price, {TREND.format('current_price', 'past_price')} AS trend FROM cards c LEFT JOIN cur ON cur.card_id = c.id LEFT JOIN past ON past.card_id = c.id")
def qry2_card_trend(t):
    return prices.card_trends(t.cards, t.printings, t.store_prices, t.price_history).withColumns({c: F.round(c, 4) for c in ("current_price", "past_price")})


PRICED = "printings p LEFT JOIN store_prices sp ON sp.printing_id = p.id LEFT JOIN stores s ON s.id = sp.store_id"


def _placed(order: str, source: str, columns: str, by: str = "card_id") -> str:
    return f" SELECT {columns}, row_number() OVER (PARTITION BY {by} ORDER BY {order})::INT AS place FROM {source}"


FLAT_SETS = "(SELECT p.id, p.card_id, p.set_name, p.is_foil, price_aud, sp.store_id, condition FROM printings p LEFT JOIN store_prices sp ON sp.printing_id = p.id)"
TIES = ", store_id NULLS FIRST, condition NULLS FIRST"


@query("printings store_prices", _placed("set_name, is_foil, price_aud NULLS LAST, id" + TIES, FLAT_SETS, "id, card_id, price_aud, store_id"))
def ord3_printing_order(t):
    return _printing_places(t, False)


@query("printings store_prices", _placed("set_name, is_foil, price_aud::VARCHAR NULLS LAST, id" + TIES, FLAT_SETS, "id, card_id, price_aud, store_id"))
def ord3_printing_order_as_text(t):
    return _printing_places(t, True)


def _printing_places(t: Tables, as_text: bool) -> DataFrame:
    d = t.printings.join(t.store_prices.withColumnRenamed("printing_id", "id"), "id", "left")
    order = [*prices.printing_order(as_text), F.asc_nulls_first("store_id"), F.asc_nulls_first("condition")]
    return prices.placed(d, "card_id", order).select("id", "card_id", "price_aud", "store_id", "place")


@query("printings store_prices stores", _placed("low NULLS LAST, set_name, id", f"(SELECT p.id, p.card_id, p.set_name, min(CASE WHEN in_stock AND s.name IS NOT NULL THEN price_aud END) AS low FROM {PRICED} GROUP BY ALL)", "id, card_id, low AS low_price"))
def ord4_by_lowest(t):
    d = prices.printings_with_prices(t.printings, t.store_prices, t.stores)
    return prices.placed(d, "card_id", prices.lowest_order()).select("id", "card_id", "low_price", "place")


@query("printings store_prices stores", f"""SELECT p.id, p.card_id, count(CASE WHEN s.name IS NOT NULL AND price_aud IS NOT NULL THEN 1 END)::INT AS n_prices,
 coalesce(string_agg(CASE WHEN s.name IS NOT NULL AND price_aud IS NOT NULL THEN price_aud::VARCHAR || '|' || s.name || '|' || coalesce(condition, '') || '|' || coalesce(in_stock, false)::VARCHAR END, ';' ORDER BY price_aud, s.name, condition NULLS FIRST, in_stock), '') AS prices,
 min(CASE WHEN in_stock AND s.name IS NOT NULL THEN price_aud END) AS low_price FROM {PRICED} GROUP BY 1, 2""")
def qry3_printings_with_prices(t):
    return price_lines(prices.printings_with_prices(t.printings, t.store_prices, t.stores))


def price_lines(d: DataFrame) -> DataFrame:
    """printings_with_prices() with the prices as one text."""
    line = lambda x: F.concat_ws("|", x["price_aud"].cast("string"), x["store_name"], F.coalesce(x["condition"], F.lit("")), x["in_stock"].cast("string"))
    return d.select("id", "card_id", F.size("prices").alias("n_prices"), F.array_join(F.transform("prices", line), ";").alias("prices"), "low_price")


@query("printings store_prices stores", f"SELECT p.card_id, count(*) AS printings, count(low) AS with_prices FROM (SELECT p.id, p.card_id, min(CASE WHEN in_stock AND s.name IS NOT NULL THEN price_aud END) AS low FROM {PRICED} GROUP BY 1, 2) p GROUP BY 1")
def agg18_priced_printings(t):
    return prices.with_prices(prices.printings_with_prices(t.printings, t.store_prices, t.stores), "card_id")


@query("printings store_prices stores", f"""SELECT card_id, image_uri FROM (SELECT card_id, image_uri, row_number() OVER (PARTITION BY card_id ORDER BY (image_uri IS NULL), is_foil, (low IS NULL), low, set_name, id) AS n
 FROM (SELECT p.id, p.card_id, p.set_name, p.is_foil, p.image_uri, min(CASE WHEN in_stock AND s.name IS NOT NULL THEN price_aud END) AS low FROM {PRICED} GROUP BY ALL) x) y WHERE n = 1""")
def scl29_default_image(t):
    return prices.default_images(prices.printings_with_prices(t.printings, t.store_prices, t.stores))


DAILY = ", daily AS (SELECT p.card_id, p.id AS printing_id, p.set_name, p.set_code, p.is_foil, recorded_at AS day, min(price_aud) AS price FROM price_history h JOIN printings p ON p.id = h.printing_id WHERE price_type = 'sell' GROUP BY ALL)"
TOP = ", top AS (SELECT * FROM (SELECT card_id, printing_id, count(*) AS days, row_number() OVER (PARTITION BY card_id ORDER BY count(*) DESC, printing_id) AS place FROM daily GROUP BY 1, 2 HAVING count(*) >= 2) x WHERE place <= 8)"


@query("printings price_history", DAILY + " SELECT * FROM daily")
def agg8_daily_prices(t):
    return prices.daily_prices(t.printings, t.price_history)


@query("printings price_history", DAILY + _placed("day, set_name, is_foil, printing_id", "daily", "card_id, printing_id, day, price"))
def ord7_history_order(t):
    return prices.placed(prices.daily_prices(t.printings, t.price_history), "card_id", prices.daily_order()).select("card_id", "printing_id", "day", "price", "place")


@query("printings price_history", DAILY + " SELECT card_id, day, min(price) AS price FROM daily GROUP BY 1, 2")
def agg9_card_series(t):
    return prices.card_series(prices.daily_prices(t.printings, t.price_history))


@query("printings price_history", DAILY + """, a AS (SELECT card_id, string_agg(day::VARCHAR || '=' || price::VARCHAR, ';' ORDER BY day) AS aggregate FROM (SELECT card_id, day, min(price) AS price FROM daily GROUP BY 1, 2) x GROUP BY 1),
 b AS (SELECT card_id, string_agg(printing_id || ':' || data, ' ' ORDER BY printing_id) AS by_printing FROM (SELECT card_id, printing_id, string_agg(day::VARCHAR || '=' || price::VARCHAR, ';' ORDER BY day) AS data FROM daily GROUP BY 1, 2 HAVING count(*) >= 2) x GROUP BY 1)
 SELECT a.card_id, aggregate, coalesce(by_printing, '') AS by_printing FROM a LEFT JOIN b ON a.card_id = b.card_id""")
def qry4_price_history(t):
    return history_lines(prices.history_bundle(t.printings, t.price_history))


def history_lines(d: DataFrame) -> DataFrame:
    """history_bundle() with the days as texts."""
    points = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["day"].cast("string"), F.lit("="), x["price"].cast("string"))), ";")
    each = F.array_join(F.transform("by_printing", lambda p: F.concat(p["printing_id"], F.lit(":"), points(p["data"]))), " ")
    return d.select("card_id", points(F.col("aggregate")).alias("aggregate"), F.coalesce(each, F.lit("")).alias("by_printing"))


@query("printings price_history", DAILY + TOP + " SELECT card_id, printing_id, days, place::INT AS place FROM top")
def win6_top_printings(t):
    return prices.top_printings(prices.daily_prices(t.printings, t.price_history))


@query("printings price_history", DAILY + TOP + " SELECT d.card_id, d.day, " + ", ".join(f"min(CASE WHEN place = {k} THEN price END) AS p{k}" for k in range(1, 9)) + " FROM daily d JOIN top ON top.printing_id = d.printing_id GROUP BY 1, 2")
def set2_price_pivot(t):
    return prices.price_pivot(prices.daily_prices(t.printings, t.price_history))


@query("printings price_history", DAILY + """ SELECT card_id, round(greatest(0.0, a - pad), 4) AS low, round(b + pad, 4) AS high FROM (SELECT card_id, a, b, CASE WHEN b > a THEN (b - a) * 0.15 ELSE 1.0 END AS pad
 FROM (SELECT card_id, min(price)::DOUBLE AS a, max(price)::DOUBLE AS b, count(*) AS n FROM (SELECT card_id, day, min(price) AS price FROM daily GROUP BY 1, 2) s GROUP BY 1) r WHERE n >= 2) q""")
def agg24_chart_range(t):
    d = prices.chart_ranges(prices.card_series(prices.daily_prices(t.printings, t.price_history)))
    return d.withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query("printings store_prices", f"""SELECT card_id, low, high, round(median_price, 4) AS median_price, usd FROM (SELECT card_id, min(price_aud) AS low, max(price_aud) AS high, quantile_cont({DBL}, 0.5) AS median_price
 FROM store_prices s JOIN printings p ON p.id = s.printing_id WHERE in_stock GROUP BY 1) a LEFT JOIN (SELECT card_id, min(CASE WHEN NOT is_foil THEN usd_price END) AS usd FROM printings GROUP BY 1) u USING (card_id)""")
def qry5_card_snapshot(t):
    return prices.snapshots(t.printings, t.store_prices).withColumn("median_price", F.round("median_price", 4))


TIERED = f""", tiers AS (SELECT card_name, latest_released, max_usd, CASE WHEN latest_released >= DATE '{AS_OF}' - 30 THEN 'hot' WHEN latest_released >= DATE '{AS_OF}' - 90 OR max_usd >= 20 THEN 'active' WHEN max_usd >= 2 THEN 'longTail' ELSE 'skip' END AS tier
 FROM (SELECT c.name AS card_name, max(released_at) AS latest_released, max(coalesce(usd_price, 0)) AS max_usd FROM cards c JOIN printings p ON p.card_id = c.id GROUP BY 1) x),
 due AS (SELECT t.card_name, t.tier, CASE tier WHEN 'hot' THEN 1 WHEN 'active' THEN 2 ELSE 3 END AS tier_rank FROM tiers t LEFT JOIN search_log l ON l.card_name = t.card_name WHERE tier <> 'skip' AND (last_searched_at IS NULL
 OR (last_result_count > 0 AND last_searched_at < DATE '{AS_OF}' - (CASE tier WHEN 'hot' THEN 1 WHEN 'active' THEN 3 ELSE 7 END)) OR (last_result_count = 0 AND last_searched_at < DATE '{AS_OF}' - (CASE tier WHEN 'hot' THEN 14 WHEN 'active' THEN 21 ELSE 30 END))))"""


@query("cards printings", TIERED.split(",\n due")[0] + " SELECT card_name, latest_released, max_usd, tier FROM tiers")
def scl24_card_tiers(t):
    return schedule.card_tiers(t.cards, t.printings, AS_OF)


@query("cards printings search_log", TIERED + " SELECT card_name, tier, tier_rank FROM due")
def qry6_due_cards(t):
    return schedule.due_order(schedule.due_cards(t.cards, t.printings, t.search_log, AS_OF))


@query("cards printings search_log", TIERED + _placed("card_name", "due", "card_name, tier", "tier_rank"))
def ord2_due_order(t):
    return schedule.due_places(schedule.due_cards(t.cards, t.printings, t.search_log, AS_OF)).select("card_name", "tier", "place")


@query("cards printings search_log", TIERED + " SELECT tier, count(*) AS n FROM due GROUP BY 1")
def agg13_due_counts(t):
    return schedule.due_counts(schedule.due_cards(t.cards, t.printings, t.search_log, AS_OF))


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def _bare(x: str, rounds: int = 8) -> str:
    for _ in range(rounds):
        x = rf"trim(regexp_replace(regexp_replace({x}, '\s*\([^)]*\)\s*$', ''), '\s*\[[^\]]*\]\s*$', ''))"
    return x


def _grouped(name: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, max(CASE WHEN a = 1 THEN id END) AS f, max(CASE WHEN b = 1 THEN id END) AS l, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY (num IS NULL), num, id) AS a,
 row_number() OVER (PARTITION BY {keys} ORDER BY (num IS NOT NULL), num DESC, id) AS b FROM idx) x GROUP BY {keys})"""


MATCH = rf""", idx AS (SELECT p.id, {_key('c.name')} AS k, set_code, set_name, collector_number, is_foil, TRY_CAST(nullif(regexp_extract(collector_number, '^\s*([+-]?\d+)', 1), '') AS BIGINT) AS num FROM printings p JOIN cards c ON c.id = p.card_id),
 names AS (SELECT {_key('set_name')} AS sk, min(set_code) AS named FROM printings GROUP BY 1),
 d AS (SELECT l.*, {_key(_bare('raw_name'))} AS k, named AS sc FROM listings l LEFT JOIN names ON sk = {_key('l.set_name')}),
 l0 AS (SELECT set_code, collector_number, is_foil, max(id) AS id FROM idx GROUP BY ALL), {_grouped('l1', 'k, set_code, is_foil')}, {_grouped('l2', 'k, is_foil')}, {_grouped('l3', 'k')},
 probes AS (SELECT DISTINCT d.k FROM d LEFT JOIN l0 ON l0.set_code = sc AND l0.collector_number = d.collector_number AND l0.is_foil = d.is_foil LEFT JOIN l3 ON l3.k = d.k WHERE l0.id IS NULL AND l3.k IS NULL),
 near AS (SELECT k, near, dist FROM (SELECT p.k, l3.k AS near, levenshtein(p.k, l3.k) AS dist, row_number() OVER (PARTITION BY p.k ORDER BY levenshtein(p.k, l3.k), l3.k) AS n FROM probes p JOIN l3 ON levenshtein(p.k, l3.k) <= 2) x WHERE n = 1),
 matched AS (SELECT d.listing_seq, d.raw_name, d.set_name, d.collector_number, d.is_foil, d.is_borderless, d.price, d.store_id,
 CASE WHEN l0.id IS NOT NULL THEN l0.id WHEN l1.n IS NOT NULL THEN CASE WHEN d.is_borderless THEN l1.l ELSE l1.f END WHEN l2.n IS NOT NULL THEN CASE WHEN d.is_borderless THEN l2.l ELSE l2.f END
 WHEN l3.n IS NOT NULL THEN CASE WHEN d.is_borderless THEN l3.l ELSE l3.f END ELSE coalesce(f2.f, f3.f) END AS printing_id,
 CASE WHEN l0.id IS NOT NULL THEN 'set_collector' WHEN l1.n IS NOT NULL THEN 'exact' WHEN l2.n IS NOT NULL THEN 'name_foil' WHEN l3.n IS NOT NULL THEN 'name_only' WHEN near.k IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS match_type,
 CAST(CASE WHEN l0.id IS NOT NULL THEN 1.0 WHEN l1.n IS NOT NULL THEN CASE WHEN l1.n = 1 THEN 1.0 ELSE 0.8 END WHEN l2.n IS NOT NULL THEN CASE WHEN l2.n = 1 THEN 0.85 ELSE 0.7 END
 WHEN l3.n IS NOT NULL THEN CASE WHEN l3.n = 1 THEN 0.7 ELSE 0.6 END WHEN near.k IS NOT NULL THEN greatest(0.5, 1 - dist * 0.2) ELSE 0.0 END AS DOUBLE) AS confidence
 FROM d LEFT JOIN l0 ON l0.set_code = sc AND l0.collector_number = d.collector_number AND l0.is_foil = d.is_foil LEFT JOIN l1 ON l1.k = d.k AND l1.set_code = sc AND l1.is_foil = d.is_foil
 LEFT JOIN l2 ON l2.k = d.k AND l2.is_foil = d.is_foil LEFT JOIN l3 ON l3.k = d.k LEFT JOIN near ON near.k = d.k LEFT JOIN l2 f2 ON f2.k = near.near AND f2.is_foil = d.is_foil LEFT JOIN l3 f3 ON f3.k = near.near)"""
MATCHING = "cards printings listings"


def matched(t: Tables) -> DataFrame:
    return matching.match_listings(t.listings, t.printings, t.cards, publish=publisher(t))


@query(MATCHING, MATCH + " SELECT * FROM matched")
def qry7_match_listings(t):
    return matched(t)


@query("cards printings all_listings", MATCH.replace("FROM listings l", "FROM all_listings l") + " SELECT * FROM matched")
def qry7_match_all_listings(t):
    return matching.match_listings(t.all_listings, t.printings, t.cards, publish=publisher(t))


@query("cards", rf"""SELECT probe, key, dist FROM (SELECT a.p AS probe, b.k AS key, levenshtein(a.p, b.k) AS dist FROM (SELECT DISTINCT replace({_key('name')}, 'a', '') AS p FROM cards) a JOIN (SELECT DISTINCT {_key('name')} AS k FROM cards) b ON abs(length(a.p) - length(b.k)) <= 2) x WHERE dist <= 2""")
def jon7_near_keys(t):
    keys = publisher(t)(t.cards.select(text.name_key(F.col("name")).alias("key")).distinct(), "keys")
    return matching.near_keys(keys.select(F.replace("key", F.lit("a"), F.lit("")).alias("probe")).distinct(), keys).withColumn("dist", F.col("dist").cast("bigint"))


@query(MATCHING, MATCH + " SELECT match_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM matched), 1)::DOUBLE AS percent FROM matched GROUP BY 1")
def qry11_match_summary(t):
    return quality.summary(matched(t)).drop("place")


@query(MATCHING, MATCH + " SELECT match_type, n, row_number() OVER (ORDER BY n DESC, match_type)::INT AS place FROM (SELECT match_type, count(*) AS n FROM matched GROUP BY 1) x")
def ord8_match_summary(t):
    return quality.summary(matched(t)).drop("percent")


@query(MATCHING, MATCH + """ SELECT count(*) AS listings, count(*) FILTER (confidence >= 0.7) AS high_confidence, count(*) FILTER (is_borderless) AS borderless,
 count(*) FILTER (printing_id IS NOT NULL AND confidence < 0.7 AND NOT is_borderless) AS low_confidence, count(*) FILTER (match_type = 'unmatched') AS unmatched FROM matched""")
def agg15_match_totals(t):
    return quality.totals(matched(t))


@query(MATCHING, MATCH + " SELECT raw_name, set_name, count(*) AS n FROM matched WHERE match_type = 'unmatched' GROUP BY 1, 2")
def agg22_unmatched_names(t):
    return quality.unmatched(matched(t))


ASKED = " SELECT m.*, p.set_code AS matched_set, p.collector_number AS matched_number FROM matched m LEFT JOIN printings p ON p.id = m.printing_id WHERE "


@query(MATCHING, MATCH + ASKED + "is_borderless")
def qry11_borderless(t):
    return quality.borderless(matched(t), t.printings)


@query(MATCHING, MATCH + ASKED + "m.printing_id IS NOT NULL AND confidence < 0.7 AND NOT is_borderless")
def jon17_low_confidence(t):
    return quality.low_confidence(matched(t), t.printings)


FLAT = f"SELECT p.id, p.card_id, p.set_name, p.is_foil, p.released_at, sp.store_id, price_aud, condition, coalesce(in_stock, false) AS in_stock, s.name AS store_name FROM {PRICED} WHERE s.name IS NOT NULL AND price_aud IS NOT NULL"
SHOWN = ["id", "card_id", "set_name", "is_foil", "released_at", "store_id", "price_aud", "condition", "in_stock", "store_name"]


def flat(t: Tables) -> DataFrame:
    return prices.priced_printings(t.printings, t.store_prices, t.stores)


@query("printings store_prices stores", FLAT + " AND NOT is_foil AND coalesce(in_stock, false)")
def qry12_price_table(t):
    return prices.price_table(flat(t), foil=False, in_stock_only=True).select(*SHOWN)


@query("printings store_prices stores", f"SELECT card_id, count(*) AS n, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM ({FLAT}) x GROUP BY 1")
def ord6_table_pages(t):
    return prices.table_pages(prices.price_table(flat(t)))


@query("printings store_prices stores", FLAT + " ORDER BY released_at DESC NULLS LAST, p.id, sp.store_id, price_aud, condition NULLS FIRST, in_stock LIMIT 10 OFFSET 10")
def ord5_newest_page(t):
    return prices.table_page(prices.price_table(flat(t)).select(*SHOWN), "newest", 1)


@query("printings store_prices stores", f"SELECT DISTINCT card_id, store_name FROM ({FLAT}) x")
def agg17_shop_facets(t):
    return prices.shop_facets(flat(t))


@query("printings", "SELECT card_id, set_name, max(released_at) AS released_at, row_number() OVER (PARTITION BY card_id ORDER BY max(released_at) DESC, set_name)::INT AS place FROM printings GROUP BY 1, 2")
def agg17_set_facets(t):
    return prices.set_facets(t.printings)


@query("printings", "SELECT id, replace(image_uri, '/normal/', '/small/') AS thumbnail, TRY_CAST(nullif(regexp_extract(collector_number, '^([0-9]+)', 1), '') AS BIGINT) AS num FROM printings")
def scl27_thumbnails(t):
    return t.printings.select("id", prices.thumbnail(F.col("image_uri")).alias("thumbnail"), text.number_prefix(F.col("collector_number")).alias("num"))


@query("", f"SELECT doc_id, md5({_key('text')}) AS key_md5 FROM documents")
def scl1_name_keys(t):
    return t.base("documents").select("doc_id", F.md5(text.name_key(F.col("text"))).alias("key_md5"))


@query("listings", f"SELECT listing_seq, {_bare('raw_name')} AS bare FROM listings")
def scl3_bare_names(t):
    return t.listings.select("listing_seq", text.strip_variant(F.col("raw_name")).alias("bare"))


@query("", r"""SELECT page_id, code, min(pos) - 1 AS pos FROM (SELECT page_id, unnest(h) AS code, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="/([a-z0-9]+)', 1) AS h FROM pages) x) y GROUP BY 1, 2""")
def src5_page_codes(t):
    return store_a.set_codes(t.base("pages"), pattern='href="/([a-z0-9]+)').withColumn("pos", F.col("pos").cast("bigint"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _first(column: str, pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_q(p)}, 'i') THEN {_q(v)}" for p, v in pairs) + " END"


def _noise(column: str) -> str:
    for p in rules.TITLE_NOISE:
        column = f"regexp_replace({column}, {_q(p)}, ' ', 'gi')"
    return rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"


FIELD = "CASE " + " ".join(f"WHEN lower(coalesce(item_condition, '')) LIKE '%{k}%' THEN '{v}'" for k, v in rules.FIELD_CONDITIONS) + " END"
MARKET = rf""", firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM market_items) x WHERE n = 1),
 titles AS (SELECT title, {_first('title', rules.TITLE_SETS)} AS set_name, {_first('title', rules.TITLE_CONDITIONS)} AS title_condition, regexp_matches(title, '\bfoil\b', 'i') AS is_foil, ({" OR ".join(f"regexp_matches(title, {_q(p)}, 'i')" for p in rules.SKIP_TITLES)}) AS skip FROM (SELECT DISTINCT title FROM firsts) x),
 named AS (SELECT *, CASE WHEN set_name IS NULL THEN title ELSE regexp_replace(title, regexp_escape(set_name), '', 'gi') END AS rest FROM titles),
 done AS (SELECT *, {_noise('rest')} AS raw_name FROM named),
 judged AS (SELECT f.item_id, f.rank, f.title, raw_name, set_name, CASE WHEN currency = 'AUD' AND amount::DECIMAL(12,2) > 0 THEN amount::DECIMAL(12,2) END AS price, coalesce(title_condition, {FIELD}) AS condition, is_foil,
 CASE WHEN lower(coalesce(item_condition, '')) LIKE '%sealed%' OR lower(coalesce(item_condition, '')) LIKE '%new/factory%' THEN 'sealed' WHEN skip THEN 'title' WHEN currency <> 'AUD' OR amount::DECIMAL(12,2) <= 0 THEN 'price'
 WHEN NOT fixed THEN 'auction' WHEN length(raw_name) < 2 THEN 'name' END AS skip_reason FROM firsts f JOIN done ON done.title = f.title)"""


def judged_items(t: Tables) -> DataFrame:
    found, publish = market.items(feeds.market_pages(t.spark, t.sf_dir)), publisher(t)
    unique = publish(market.first_seen(found, ["search_rank", "item_pos"]), "items")
    return market.judged(unique, publish(market.title_facts(unique), "titles"))


@query("market_items", MARKET + " SELECT item_id, rank, title, raw_name, set_name, price, condition, is_foil, skip_reason FROM judged")
def flt5_market_items(t):
    return judged_items(t).select(F.col("itemId").alias("item_id"), F.col("search_rank").alias("rank"), "title", "raw_name", "set_name", "price", "condition", "is_foil", "skip_reason")


@query("market_items", MARKET + " SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1")
def agg14_market_reasons(t):
    return judged_items(t).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


CODES_A = "CASE lower(condition) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CONDITIONS_A.items()) + " ELSE condition END"


SHOP_A = f"""SELECT name AS raw_name, nullif(set_code, '') AS set_code, nullif(set_name, '') AS set_name, nullif(split_part(split_part(link_path, '/', -1), ':', 1), '') AS collector_number, CAST(price / 100.0 AS DECIMAL(12,2)) AS price,
 'sell' AS price_type, {CODES_A} AS condition, finish = 'Foil' AS is_foil, quantity > 0 AS in_stock, '{store_a.BASE_URL}' || link_path AS source_url FROM shop_a_entries"""


@query("shop_a_entries", SHOP_A)
def prj4_shop_a_listings(t):
    return store_a.listings(feeds.shop_a_payloads(t.spark, t.sf_dir)).drop("source", "listing_seq", "is_borderless")


SHOP_B = f""", p AS (SELECT *, regexp_matches(title, '\\bborderless\\b', 'i') AS is_borderless, nullif(regexp_extract(title, '\\((\\d{{4}})\\)', 1), '') AS num,
 trim(regexp_replace(regexp_replace(regexp_replace(title, '\\(\\d{{4}}\\)', ''), '\\bborderless\\b', '', 'i'), '\\s{{2,}}', ' ', 'g')) AS clean FROM shop_b_products WHERE NOT ({" OR ".join(f"contains(lower(title), '{k}')" for k in rules.SKIPPED_VARIANTS)})
 AND NOT regexp_matches(lower(title), '\\b(token|emblem)\\b') AND NOT contains(title, '//') AND lower(product_type) <> 'token'),
 q AS (SELECT *, CASE WHEN regexp_matches(clean, '^(.+?)\\s+[-–—]\\s+(.+)$') THEN trim(regexp_extract(clean, '^(.+?)\\s+[-–—]\\s+(.+)$', 1)) WHEN regexp_matches(clean, '^(.+?)\\s+[\\[(]([^\\])]*)[\\])]$') THEN trim(regexp_extract(clean, '^(.+?)\\s+[\\[(]([^\\])]*)[\\])]$', 1)) ELSE clean END AS n1,
 CASE WHEN tagged THEN tag WHEN regexp_matches(clean, '^(.+?)\\s+[-–—]\\s+(.+)$') THEN trim(regexp_extract(clean, '^(.+?)\\s+[-–—]\\s+(.+)$', 2)) WHEN regexp_matches(clean, '^(.+?)\\s+[\\[(]([^\\])]*)[\\])]$') THEN trim(regexp_extract(clean, '^(.+?)\\s+[\\[(]([^\\])]*)[\\])]$', 2)) END AS s1 FROM p),
 r AS (SELECT *, coalesce(instr(s1, ' [') > 0 AND length(trim(left(s1, instr(s1, ' [') - 1))) > 2 AND regexp_matches(trim(left(s1, instr(s1, ' [') - 1)), '^[A-Z]'), false) AS swap,
 regexp_matches(option1, '\\s+foil$', 'i') AS is_foil, lower(trim(regexp_replace(option1, '\\s+foil$', '', 'i'))) AS cond FROM q)
 SELECT CASE WHEN swap THEN trim(left(s1, instr(s1, ' [') - 1)) ELSE n1 END AS raw_name, CASE WHEN swap THEN nullif(trim(regexp_extract(substr(s1, instr(s1, ' [') + 2), '^(.*)\\]', 1)), '') ELSE s1 END AS set_name, CAST(CAST(num AS INT) AS VARCHAR) AS collector_number,
 CAST(price AS DECIMAL(12,2)) AS price, 'NM' AS condition, is_foil, is_borderless, CASE WHEN has_flag THEN available ELSE inventory > 0 END AS in_stock, '{store_b.BASE_URL}/products/' || handle AS source_url FROM r WHERE CAST(price AS DECIMAL(12,2)) > 0 AND cond IN ('near mint', 'nm', 'mint', 'm')"""


@query("shop_b_products", SHOP_B)
def prj5_shop_b_listings(t):
    return store_b.listings(feeds.shop_b_pages(t.spark, t.sf_dir)).select("raw_name", "set_name", "collector_number", "price", "condition", "is_foil", "is_borderless", "in_stock", "source_url")


@query("shop_a_entries shop_b_products", SHOP_B.split("\n SELECT CASE WHEN swap")[0] + f" SELECT 'mtg_mate' AS source, * EXCLUDE (set_code, price_type) FROM ({SHOP_A}) a UNION ALL BY NAME SELECT 'good_games' AS source, * EXCLUDE (is_borderless) FROM (SELECT CASE WHEN swap{SHOP_B.split(chr(10) + ' SELECT CASE WHEN swap')[1]}) b")
def src7_feed_union(t):
    landed = {"mtg_mate": feeds.shop_a_payloads(t.spark, t.sf_dir), "good_games": feeds.shop_b_pages(t.spark, t.sf_dir), "unknown": t.stores}
    return tables.union_feeds(landed).select("source", "raw_name", "set_name", "collector_number", "price", "condition", "is_foil", "in_stock", "source_url")


SEED = ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in rules.STORES)
OLD_STORES = "SELECT CASE WHEN id = '1' THEN 'mtg_mate' ELSE id END AS id, name, 'https://old.test' AS base_url, scraper_enabled, id AS was FROM stores"


@query("stores", f"""SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.base_url, o.base_url) AS base_url, coalesce(n.scraper_enabled, o.scraper_enabled) AS scraper_enabled, was
 FROM ({OLD_STORES}) o FULL JOIN (SELECT * FROM (VALUES {SEED}) v(id, name, base_url, scraper_enabled)) n ON n.id = o.id""")
def src8_store_seed(t):
    """The shop dimension put over a stored table that has one of its shops under an old name."""
    old = t.stores.select(F.when(F.col("id") == "1", "mtg_mate").otherwise(F.col("id")).alias("id"), "name", F.lit("https://old.test").alias("base_url"), "scraper_enabled", F.col("id").alias("was"))
    return snapshots.upsert(old, tables.store_dimension(t.spark), ["id"], snapshots.STORE_REFRESH)


@query("printings", "SELECT id, card_id, set_code, set_name, released_at, collector_number, rarity, is_foil, image_uri, NULL::VARCHAR AS scryfall_uri, usd_price FROM printings")
def src6_stored_printings(t):
    """A table stored without some of its declared columns, read under its declared schema."""
    root = fresh_path(t.spark, "tables")
    t.printings.write.parquet(f"{root}/printings")
    return tables.read_table(t.spark, root, "printings").drop("updated_at")


ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in rules.SET_ALIASES.items())


@query("printings", f""", own AS (SELECT {_key('set_name')} AS set_key, min(set_code) AS named_code FROM printings GROUP BY 1) SELECT * FROM own UNION ALL SELECT * FROM (VALUES {ALIASES}) v(set_key, named_code) WHERE set_key NOT IN (SELECT set_key FROM own)""")
def scl5_set_aliases(t):
    return matching.set_names(t.printings, aliases=True)


@query("shop_a_entries", "SELECT count(*) AS listings, count(*) FILTER (set_name <> '') AS with_set, count(*) FILTER (finish = 'Foil') AS foil, count(*) FILTER (quantity > 0) AS in_stock FROM shop_a_entries")
def agg23_feed_quality(t):
    return quality.feed_quality(store_a.listings(feeds.shop_a_payloads(t.spark, t.sf_dir)))


KEPT = "SELECT * FROM catalogue_cards WHERE NOT digital AND lang = 'en' AND layout <> 'token' AND oracle_id <> ''"


@query("catalogue_cards", f"SELECT oracle_id AS id, name, coalesce(type_line, 'Unknown') AS type_line FROM (SELECT *, row_number() OVER (PARTITION BY oracle_id ORDER BY pos) AS n FROM ({KEPT}) k) x WHERE n = 1")
def qry10_catalogue_cards(t):
    return catalogue.card_rows(catalogue.read_catalogue(t.spark, feeds.catalogue_file(t.spark, t.sf_dir), lines=True, pos="pos")).select("id", "name", "type_line")


@query("catalogue_cards", f"""SELECT id, card_id, set_code, set_name, released_at, collector_number, rarity, is_foil, image_uri, usd_price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC, k DESC) AS n FROM
 (SELECT pos, k, CASE WHEN foil THEN id || '_foil' ELSE id END AS id, oracle_id AS card_id, set_code, set_name, coalesce(CAST(released_at AS DATE), DATE '1993-01-01') AS released_at, collector_number, rarity, foil AS is_foil,
 coalesce(nullif(image, ''), nullif(face_image, '')) AS image_uri, CAST(CASE WHEN foil THEN usd_foil ELSE usd END AS DECIMAL(12,2)) AS usd_price
 FROM (SELECT *, 0 AS k, finish_kind = 1 AS foil FROM ({KEPT}) a UNION ALL SELECT *, 1 AS k, true AS foil FROM ({KEPT}) b WHERE finish_kind < 2) f) y) z WHERE n = 1""")
def qry10_catalogue_printings(t):
    return catalogue.printing_rows(catalogue.read_catalogue(t.spark, feeds.catalogue_file(t.spark, t.sf_dir), lines=True, pos="pos")).drop("scryfall_uri")


@query(sql=SQL["qry10_catalogue_printings"])
def qry10_catalogue_array(t):
    """From the catalogue as one JSON array, read by many tasks."""
    return catalogue.printing_rows(catalogue.read_array(t.spark, feeds.catalogue_array(t.spark, t.sf_dir), "pos")[0]).drop("scryfall_uri")


@query("store_prices stores", "SELECT * FROM store_prices WHERE store_id NOT IN (SELECT id FROM stores WHERE scraper_enabled) UNION ALL SELECT printing_id, store_id, CAST(price_aud * 2 AS DECIMAL(12,2)) AS price_aud, price_type, condition, in_stock FROM store_prices WHERE store_id IN (SELECT id FROM stores WHERE scraper_enabled) AND price_type = 'sell'")
def snk1_replace_stores(t):
    ran = t.stores.filter("scraper_enabled").select(F.col("id").alias("store_id"))
    new = t.store_prices.join(ran, "store_id", "left_semi").filter("price_type = 'sell'").withColumn("price_aud", (F.col("price_aud") * 2).cast("decimal(12,2)"))
    return snapshots.replace_store(t.store_prices, new, ran)


BATCH = f"SELECT CAST(l_partkey AS VARCHAR) AS printing_id, CAST(l_suppkey AS VARCHAR) AS store_id, 'sell' AS price_type, CAST(date_trunc('year', l_shipdate) AS DATE) AS recorded_at, CAST(l_extendedprice AS DECIMAL(12,2)) AS price_aud, l_orderkey * 10 + l_linenumber AS listing_seq FROM lineitem"


@query("price_history", f"""SELECT printing_id, store_id, price_type, recorded_at, price_aud FROM price_history UNION ALL SELECT printing_id, store_id, price_type, recorded_at, price_aud FROM (SELECT *, row_number() OVER (PARTITION BY printing_id, store_id, price_type, recorded_at ORDER BY listing_seq, price_aud) AS n FROM ({BATCH}) b) x
 WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM price_history h WHERE h.printing_id = x.printing_id AND h.store_id = x.store_id AND h.price_type = x.price_type AND h.recorded_at = x.recorded_at)""")
def snk2_append_history(t):
    return snapshots.append_history(t.price_history, history_batch(t))


def history_batch(t: Tables) -> DataFrame:
    return t.base("lineitem").select(F.col("l_partkey").cast("string").alias("printing_id"), F.col("l_suppkey").cast("string").alias("store_id"), F.lit("sell").alias("price_type"), F.to_date(F.date_trunc("year", "l_shipdate")).alias("recorded_at"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price_aud"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_seq"))


@query(MATCHING, MATCH + " SELECT store_id, raw_name, set_name AS raw_set_name, price AS raw_price FROM matched WHERE printing_id IS NULL")
def snk3_unmatched_rows(t):
    d = matched(t).withColumns({"price_type": F.lit("sell"), "condition": F.lit("NM"), "in_stock": F.lit(True), "source_url": F.lit("")})
    return matching.split_matches(d, AS_OF)[2].drop("source_url")


@query("printings", """SELECT id, card_id, set_code, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN CAST(9.99 AS DECIMAL(12,2)) ELSE usd_price END AS usd_price FROM printings UNION ALL SELECT 'n' || id, card_id, 'new', CAST(9.99 AS DECIMAL(12,2)) FROM printings WHERE CAST(id AS BIGINT) % 10 = 0""")
def snk4_upsert_printings(t):
    old = t.printings.select("id", "card_id", "set_code", "usd_price")
    return snapshots.upsert(old, changed_printings(old), ["id"], snapshots.PRINTING_REFRESH)


def changed_printings(old: DataFrame) -> DataFrame:
    price = F.lit("9.99").cast("decimal(12,2)").alias("usd_price")
    known = old.filter(F.col("id").cast("bigint") % 2 == 0).select("id", "card_id", F.lit("new").alias("set_code"), price)
    fresh = old.filter(F.col("id").cast("bigint") % 10 == 0).select(F.concat(F.lit("n"), "id").alias("id"), "card_id", F.lit("new").alias("set_code"), price)
    return known.unionByName(fresh)


@query("cards printings store_prices search_log", "SELECT * FROM store_prices WHERE NOT (store_id = '7' AND printing_id IN (SELECT p.id FROM printings p JOIN cards c ON c.id = p.card_id WHERE c.name IN (SELECT card_name FROM search_log)))")
def snk5_clear_cards(t):
    return snapshots.clear_cards(t.store_prices, t.printings, t.cards, t.search_log, "7").select("printing_id", "store_id", "price_aud", "price_type", "condition", "in_stock")


@query("price_history", f"SELECT printing_id, store_id, price_type, recorded_at, price_aud, strftime(recorded_at, '%Y-%m') AS recorded_month FROM price_history WHERE recorded_at >= DATE '{AS_OF}' - INTERVAL 24 MONTH")
def snk6_retained_history(t):
    return snapshots.retained(t.price_history, AS_OF)


CHECKS = [
    ("cards", "duplicate key", "SELECT id FROM cards GROUP BY 1 HAVING count(*) > 1"), ("printings", "duplicate key", "SELECT id FROM printings GROUP BY 1 HAVING count(*) > 1"), ("stores", "duplicate key", "SELECT id FROM stores GROUP BY 1 HAVING count(*) > 1"),
    ("price_history", "duplicate key", "SELECT printing_id FROM price_history GROUP BY printing_id, store_id, price_type, recorded_at HAVING count(*) > 1"),
    *[(c, f"orphan {k}", f"SELECT 1 FROM {c} WHERE {k} NOT IN (SELECT id FROM {p})") for c, k, p in (("printings", "card_id", "cards"), ("store_prices", "printing_id", "printings"), ("store_prices", "store_id", "stores"), ("price_history", "printing_id", "printings"), ("price_history", "store_id", "stores"))],
    *[(c, f"null {k}", f"SELECT 1 FROM {c} WHERE {k} IS NULL") for c, ks in (("cards", "id name type_line"), ("printings", "id card_id set_code released_at"), ("store_prices", "printing_id store_id price_aud price_type")) for k in ks.split()],
]


@query("cards printings stores store_prices price_history", " UNION ALL ".join(f"SELECT '{a}' AS \"table\", '{b}' AS rule, (SELECT count(*) FROM ({c}) x) AS n" for a, b, c in CHECKS))
def snk7_integrity(t):
    return snapshots.integrity(t.cards, t.printings, t.stores, t.store_prices, t.price_history)


@query("stores", "SELECT id, name, id IN ('1', '2', '3', '5') AS registered FROM stores WHERE scraper_enabled")
def flt12_runnable_stores(t):
    registered = t.spark.createDataFrame([(k,) for k in "1235"], "id STRING")
    ok, missing = tables.runnable_stores(t.stores, registered)
    return ok.select("id", "name", F.lit(True).alias("registered")).unionByName(missing.select("id", "name", F.lit(False).alias("registered")))


@query(MATCHING + " stores store_prices", MATCH + """ SELECT store_id, count(*) AS n, sum(price_aud) AS total FROM (SELECT store_id, price_aud FROM store_prices WHERE store_id NOT IN (SELECT id FROM stores WHERE scraper_enabled)
 UNION ALL SELECT store_id, price AS price_aud FROM matched WHERE printing_id IS NOT NULL AND store_id IN (SELECT id FROM stores WHERE scraper_enabled)) x GROUP BY 1""")
def qry8_store_refresh(t):
    return store_refresh(t)["store_prices"].groupBy("store_id").agg(F.count("*").alias("n"), F.sum("price_aud").alias("total"))


FINDS = MARKET.replace("FROM market_items", "FROM market_finds") + f""", listings AS (SELECT rank * 1000000 AS listing_seq, raw_name, set_name, CAST(NULL AS VARCHAR) AS collector_number, is_foil, false AS is_borderless, price,
 '{rules.MARKET_STORE}' AS store_id FROM judged WHERE skip_reason IS NULL)""" + MATCH
MARKET_JOB = "cards printings market_finds"


def publisher(t: Tables):
    return lambda df, name: snapshots.publish(df, fresh_path(t.spark, "jobs"), name)


def market_refresh(t: Tables) -> dict[str, DataFrame]:
    """The whole job: every card searched, every page judged, kept once per item and matched. Store 7 plays the market's old prices."""
    searched = t.cards.select(F.col("name").alias("card_name"), F.lit("ok").alias("status"))
    prices_then = t.store_prices.withColumns({"store_id": F.when(F.col("store_id") == "7", rules.MARKET_STORE).otherwise(F.col("store_id")), "url": F.lit("")})
    old = {"cards": t.cards, "printings": t.printings, "store_prices": prices_then, "price_history": t.price_history, "unmatched_cards": t.spark.createDataFrame([], TABLES["unmatched_cards"]), "search_log": t.search_log}
    return jobs.refresh_market(feeds.market_pages(t.spark, t.sf_dir, "market_finds"), searched, old, AS_OF, publisher(t))


@query("cards market_finds search_log", f"""SELECT coalesce(c.name, l.card_name) AS card_name, CASE WHEN c.name IS NULL THEN last_searched_at ELSE DATE '{AS_OF}' END AS last_searched_at, CASE WHEN c.name IS NULL THEN last_result_count ELSE coalesce(n, 0)::INT END AS last_result_count
 FROM cards c FULL JOIN search_log l ON l.card_name = c.name LEFT JOIN (SELECT card_name AS found, count(*) AS n FROM market_finds GROUP BY 1) f ON f.found = c.name""")
def qry9_market_log(t):
    return market_refresh(t)["search_log"]


@query(MARKET_JOB + " store_prices", FINDS + f""" SELECT *, '' AS url FROM store_prices WHERE store_id <> '7' UNION ALL SELECT printing_id, store_id, m.price AS price_aud, 'sell' AS price_type, j.condition, true AS in_stock, 'https://m.test/' || item_id AS url
 FROM matched m JOIN judged j ON j.rank * 1000000 = m.listing_seq WHERE printing_id IS NOT NULL""")
def qry9_market_prices(t):
    return market_refresh(t)["store_prices"]


@query(MARKET_JOB + " price_history", FINDS + f""" SELECT printing_id, store_id, price_type, recorded_at, price_aud FROM price_history UNION ALL SELECT printing_id, store_id, 'sell' AS price_type, DATE '{AS_OF}' AS recorded_at, price AS price_aud
 FROM (SELECT *, row_number() OVER (PARTITION BY printing_id, store_id ORDER BY listing_seq, price) AS n FROM matched WHERE printing_id IS NOT NULL) x
 WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM price_history h WHERE h.printing_id = x.printing_id AND h.store_id = x.store_id AND h.price_type = 'sell' AND h.recorded_at = DATE '{AS_OF}')""")
def qry9_market_history(t):
    return market_refresh(t)["price_history"]


@query(MARKET_JOB, FINDS + """ SELECT store_id, m.raw_name, m.set_name AS raw_set_name, m.price AS raw_price, 'https://m.test/' || item_id AS source_url FROM matched m JOIN judged j ON j.rank * 1000000 = m.listing_seq WHERE printing_id IS NULL""")
def qry9_market_unmatched(t):
    return market_refresh(t)["unmatched_cards"].drop("scraped_at")


@query("", "SELECT event_type, count(*) AS n, sum(value) AS total FROM (SELECT event_type, round(value, 2)::DECIMAL(12,2) AS value FROM events) x GROUP BY 1")
def str1_event_ingest(t):
    """The events as arriving items: new files only, once per item, written by foreachBatch until none is left."""
    out, state = fresh_path(t.spark, "str1"), fresh_path(t.spark, "str1-state")
    schema = t.base("events").schema
    source = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*")
    seen = ingest.items_once(source, "event_id")
    with ingest.state_on_disk(t.spark):
        run = seen.writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    d = t.spark.read.parquet(out)
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round("value", 2).cast("decimal(12,2)")).alias("total"))


RAN = "(SELECT id FROM stores WHERE scraper_enabled)"
FIRST_HIT = f"""SELECT printing_id, store_id, 'sell' AS price_type, DATE '{AS_OF}' AS recorded_at, price AS price_aud FROM (SELECT *, row_number() OVER (PARTITION BY printing_id, store_id ORDER BY listing_seq, price) AS n FROM matched WHERE printing_id IS NOT NULL) x WHERE n = 1"""


def arriving(t: Tables) -> DataFrame:
    return t.listings.withColumns({"price_type": F.lit("sell"), "condition": F.lit("NM"), "in_stock": F.lit(True), "source_url": F.lit("")})


def store_refresh(t: Tables) -> dict[str, DataFrame]:
    ran = t.stores.filter("scraper_enabled").select(F.col("id").alias("store_id"))
    old = {"cards": t.cards, "printings": t.printings, "store_prices": t.store_prices, "price_history": t.price_history, "unmatched_cards": t.spark.createDataFrame([], TABLES["unmatched_cards"])}
    return jobs.refresh_stores(arriving(t).join(ran, "store_id", "left_semi"), old, ran, AS_OF, publisher(t))


@query(MATCHING + " stores store_prices", MATCH + f""" SELECT * FROM store_prices WHERE store_id NOT IN {RAN}
 UNION ALL SELECT printing_id, store_id, price AS price_aud, 'sell' AS price_type, 'NM' AS condition, true AS in_stock FROM matched WHERE printing_id IS NOT NULL AND store_id IN {RAN}""")
def qry8_store_prices(t):
    return store_refresh(t)["store_prices"].drop("url")


@query(MATCHING + " stores price_history", MATCH + f""" SELECT printing_id, store_id, price_type, recorded_at, price_aud FROM price_history UNION ALL SELECT * FROM ({FIRST_HIT} AND store_id IN {RAN}) y
 WHERE NOT EXISTS (SELECT 1 FROM price_history h WHERE h.printing_id = y.printing_id AND h.store_id = y.store_id AND h.price_type = y.price_type AND h.recorded_at = y.recorded_at)""")
def qry8_store_history(t):
    return store_refresh(t)["price_history"]


@query(MATCHING + " stores", MATCH + f" SELECT store_id, raw_name, set_name AS raw_set_name, price AS raw_price FROM matched WHERE printing_id IS NULL AND store_id IN {RAN}")
def qry8_store_unmatched(t):
    return store_refresh(t)["unmatched_cards"].drop("source_url", "scraped_at")


@query(MATCHING + " stores", MATCH + f""" SELECT count(*) AS listings, count(*) FILTER (confidence >= 0.7) AS high_confidence, count(*) FILTER (is_borderless) AS borderless,
 count(*) FILTER (printing_id IS NOT NULL AND confidence < 0.7 AND NOT is_borderless) AS low_confidence, count(*) FILTER (match_type = 'unmatched') AS unmatched FROM matched WHERE store_id IN {RAN}""")
def qry8_store_statistics(t):
    return store_refresh(t)["statistics"]


@query(MARKET_JOB, FINDS + """, s AS (SELECT (SELECT count(*) FROM market_finds) AS fetched, (SELECT count(DISTINCT item_id) FROM market_finds) AS items, (SELECT count(*) FROM judged WHERE skip_reason IS NOT NULL) AS skipped,
 (SELECT count(*) FROM matched WHERE printing_id IS NOT NULL) AS matched, (SELECT count(*) FROM matched WHERE printing_id IS NULL) AS unmatched, (SELECT count(*) FROM cards) AS searches, (SELECT count(*) FROM cards WHERE name NOT IN (SELECT card_name FROM market_finds)) AS empty_searches)
 SELECT fetched, fetched - items AS duplicates, skipped, matched, unmatched, CASE WHEN matched + unmatched > 0 THEN printf('%.1f', matched * 100.0 / (matched + unmatched)) ELSE '0' END AS match_percent, searches, empty_searches FROM s""")
def qry9_market_statistics(t):
    return market_refresh(t)["statistics"]


def in_runs(t: Tables, rows: DataFrame, by: str, runs: int) -> str:
    """The folder of rows written once, in order of `by` (a line's number times 1000, and more) over as many runs.

    Where one run ends and the next begins is taken from the lines themselves, so that the rows are worked out once.
    """
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    low, high = t.base("lineitem").agg(F.min(line), F.max(line)).first()
    width = ((high or 0) - (low or 0)) // runs + 1
    run = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(runs - 1), F.expr(f"({by} div 1000 - {low or 0}) div {width}"))), F.lit(0))
    path = fresh_path(t.spark, "staged")
    rows.withColumn("_run", run.cast("int")).write.option("compression", "zstd").partitionBy("_run").parquet(path)
    return path


def land(spark: SparkSession, staged: str, run: int, path: str, schema) -> None:
    """Moves a run's files to where a stream finds them; a run without rows lands as an empty file."""
    if not storage.moved(spark, f"{staged}/_run={run}", path):
        spark.createDataFrame([], schema).write.parquet(path)


@query(MATCHING, MATCH + " " + FIRST_HIT)
def str1_listing_history(t):
    """The listings as arriving items, matched and appended to a history that isn't there yet, in two runs.

    The second run brings the later half, and all of the first half once more with days before those of the first run.
    """
    landed, out, state, seen = (fresh_path(t.spark, f"str1-{k}") for k in ("listings", "history", "state", "seen"))
    seen = Table(t.spark, seen, ingest.SEEN, Months("first_seen"))
    items = arriving(t).withColumn("ts", F.lit(AS_OF).cast("timestamp"))
    with storage.shuffles_freed(t.spark):
        staged = in_runs(t, items, "listing_seq", 2)
    for k in range(2):
        land(t.spark, staged, k, f"{landed}/{k}", items.schema)
        if k:
            early = t.spark.read.schema(items.schema).parquet(f"{landed}/0")
            early = early.withColumn("ts", F.col("ts") - F.expr("INTERVAL 400 DAYS"))
            early.write.option("compression", "zstd").parquet(f"{landed}/again")
        # a run is one batch, as the first listing of a day is the first of its batch
        stream = ingest.read_stream(t.spark, f"{landed}/*", items.schema, files_per_batch=(1 << 31) - 1)
        ingest.ingest_history(stream, t.printings, t.cards, out, state, AS_OF, seen, t.listings.columns).awaitTermination()
    return t.spark.read.schema(TABLES["price_history"]).parquet(out).select(*snapshots.HISTORY_KEY, "price_aud")


def market_stream_store(t: Tables) -> market_stream.Store:
    """The market's stored tables after its pages have come in three runs, by rank."""
    store, state = market_stream.Store(t.spark, fresh_path(t.spark, "market")), fresh_path(t.spark, "market-state")
    pages, landed = feeds.market_pages(t.spark, t.sf_dir, "market_finds"), fresh_path(t.spark, "market-pages")
    staged = in_runs(t, pages, "search_rank", 3)
    for k in range(3):
        land(t.spark, staged, k, f"{landed}/{k}", pages.schema)
        stream = ingest.read_stream(t.spark, f"{landed}/*", pages.schema)
        query, statistics = market_stream.ingest(stream, t.printings, t.cards, store, state, AS_OF)
        statistics.wait(query)
    return store


STATISTICS = SQL["qry9_market_statistics"]


@query(sql=STATISTICS)
def str1_market_statistics(t):
    """The sum of what each batch of the market's stream reported."""
    searched = t.cards.select(F.col("name").alias("card_name"))
    return market_stream.run_statistics(market_stream_store(t), searched)


@query(MARKET_JOB, FINDS + " " + FIRST_HIT)
def str1_market_history(t):
    return market_stream_store(t).history.read().select(*snapshots.HISTORY_KEY, "price_aud")


SHOP_PRICES = "printing_id STRING, store_id STRING, price_aud DECIMAL(12,2), price_type STRING, condition STRING, in_stock BOOLEAN"


def published_prices(t: Tables) -> Table:
    """The price table in parts by shop and printing."""
    made = Table(t.spark, fresh_path(t.spark, "store_prices"), SHOP_PRICES, Buckets({"store_id": 32, "printing_id": 2}))
    made.append(t.store_prices)
    return made


@query(sql=SQL["snk1_replace_stores"])
def snk1_published_stores(t):
    """Of the price table in parts, only the parts of the shops that ran are read and written."""
    made = published_prices(t)
    ran = t.stores.filter("scraper_enabled").select(F.col("id").alias("store_id"))
    new = made.read().join(ran, "store_id", "left_semi").filter("price_type = 'sell'").withColumn("price_aud", (F.col("price_aud") * 2).cast("decimal(12,2)"))
    made.replace_store(new, ran)
    return made.read()


@query(sql=SQL["snk4_upsert_printings"])
def snk4_published_printings(t):
    made = Table(t.spark, fresh_path(t.spark, "printings"), "id STRING, card_id STRING, set_code STRING, usd_price DECIMAL(12,2)", Buckets({"id": 64}))
    made.append(t.printings)
    made.upsert(changed_printings(made.read()), ["id"], snapshots.PRINTING_REFRESH)
    return made.read()


@query(sql=SQL["snk5_clear_cards"])
def snk5_published_clear(t):
    """Only the parts of shop 7 are read and written."""
    made = published_prices(t)
    made.clear_cards(t.printings, t.cards, t.search_log, "7")
    return made.read()


@query(sql=SQL["snk6_retained_history"])
def snk6_published_history(t):
    """The history added in two steps, its small files merged, its old months dropped and their files deleted."""
    made = Table(t.spark, fresh_path(t.spark, "price_history"), TABLES["price_history"], Months("recorded_at"))
    years = [r[0] for r in t.price_history.select(F.year("recorded_at")).distinct().collect()]
    for half in (0, 1):
        made.append(t.price_history.filter(F.year("recorded_at").isin([y for k, y in enumerate(sorted(years)) if k % 2 == half])))
    made.compact()
    published.retain(made, AS_OF)
    made.clean()
    return snapshots.retained(made.read(), AS_OF)


@query("cards printings finish_listings", MATCH.replace("FROM listings l", "FROM finish_listings l") + " SELECT * FROM matched")
def jon6_other_finish(t):
    """Names without set and number, in a finish that many of the cards lack: the level of the name alone."""
    return matching.match_listings(t.finish_listings, t.printings, t.cards, publish=publisher(t))


@query("cards searches", """ SELECT query, literal, count(id) AS n, min(id) AS first_id FROM searches s LEFT JOIN cards c ON trim(query) <> '' AND (CASE WHEN literal THEN contains(lower(name), lower(query)) ELSE name ILIKE concat('%', query, '%') END) GROUP BY 1, 2""")
def flt6_many_searches(t):
    """Some thousand searches in one job."""
    found = search.search_all(t.cards, t.searches).groupBy("query", "literal").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return t.searches.join(found, ["query", "literal"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("store_prices", f"""SELECT printing_id, price_type, min(price_aud) AS low, max(price_aud) AS high, round(quantile_cont({DBL}, 0.5), 4) AS median FROM store_prices GROUP BY 1, 2""")
def agg2_counted_medians(t):
    return prices.counted_medians(t.store_prices, ["printing_id", "price_type"]).withColumn("median", F.round("median", 4))


@query("store_prices", f"SELECT price_type, min(price_aud) AS low, max(price_aud) AS high, round(quantile_cont({DBL}, 0.5), 4) AS median FROM store_prices GROUP BY 1")
def agg2_market_medians(t):
    """Of groups that hold half of all prices each."""
    return prices.counted_medians(t.store_prices, ["price_type"]).withColumn("median", F.round("median", 4))


@query("set_pages", """SELECT page_id, code, min(pos) - 1 AS pos FROM (SELECT page_id, unnest(h) AS code, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'magic_sets/([a-z0-9]+)', 1) AS h FROM set_pages) x) y GROUP BY 1, 2""")
def src5_set_codes(t):
    return store_a.set_codes(t.set_pages).withColumn("pos", F.col("pos").cast("bigint"))


@query("cards", "SELECT 'cards' AS stored, (SELECT count(*) = 0 FROM cards) AS needed UNION ALL SELECT 'none yet', true")
def agg19_needs_import(t):
    """Whether each of two stored catalogues, the cards and one without a card, asks for an import."""
    flags = [(name, catalogue.needs_import(d)) for name, d in (("cards", t.cards), ("none yet", t.cards.filter("name is null and id is not null")))]
    return t.spark.createDataFrame(flags, "stored string, needed boolean")


@query("price_history", f"""SELECT printing_id, store_id, price_type, recorded_at, price_aud FROM price_history UNION ALL SELECT printing_id, store_id, price_type, recorded_at, price_aud FROM (SELECT *, row_number() OVER (PARTITION BY printing_id, store_id, price_type, recorded_at ORDER BY listing_seq, price_aud) AS n
 FROM ({BATCH}) b WHERE recorded_at BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM price_history h WHERE h.printing_id = x.printing_id AND h.store_id = x.store_id AND h.price_type = x.price_type AND h.recorded_at = x.recorded_at)""")
def snk2_append_days(t):
    """A batch of two years to a history stored by month, of which the months of these years are read."""
    made = Table(t.spark, fresh_path(t.spark, "price_history"), TABLES["price_history"], Months("recorded_at"))
    made.append(t.price_history)
    days = ("1995-01-01", "1996-12-31")
    months = {p for p in made.version().parts if days[0][:7] <= p <= days[1][:7]}
    made.append(snapshots.new_history(made.read(months), history_batch(t), days))
    return made.read()


@query("printings store_prices stores", FLAT + " AND set_name IN ('Brand#11', 'Brand#23', 'Brand#45') AND s.name IN (SELECT name FROM stores WHERE CAST(id AS BIGINT) % 3 = 0)")
def qry12_filtered_table(t):
    """Some sets and some shops."""
    shops = [r[0] for r in t.stores.filter(F.col("id").cast("bigint") % 3 == 0).select("name").collect()]  # what a reader has ticked
    return prices.price_table(flat(t), sets=["Brand#11", "Brand#23", "Brand#45"], shops=shops).select(*SHOWN)


@query(sql=f"""WITH fresh AS ({SQL["qry10_catalogue_printings"]}), old AS (SELECT * FROM fresh WHERE ascii(right(replace(id, '_foil', ''), 1)) % 3 <> 0)
 SELECT f.id, f.card_id, f.set_code, CASE WHEN o.id IS NULL THEN f.set_name ELSE 'as first seen' END AS set_name, f.released_at, f.collector_number, f.rarity, f.is_foil, f.image_uri, f.usd_price FROM fresh f LEFT JOIN old o ON o.id = f.id""")
def qry10_refreshed_printings(t):
    """A catalogue put over a stored one of two thirds of its printings: known printings take new prices and days, the rest stays."""
    landed = catalogue.read_array(t.spark, feeds.catalogue_array(t.spark, t.sf_dir), "pos")[0]
    known = catalogue.printing_rows(landed).filter(F.ascii(F.right(F.replace("id", F.lit("_foil"), F.lit("")), F.lit(1))) % 3 != 0)
    old = known.withColumns({"set_name": F.lit("as first seen"), "usd_price": F.lit("0.01").cast("decimal(12,2)"), "released_at": F.lit("1900-01-01").cast("date")})
    return jobs.refresh_catalogue(landed, catalogue.card_rows(landed), old)["printings"].drop("scryfall_uri")


@query("market_finds", """ SELECT card_name, count(*) AS n, count(DISTINCT item_id) AS items FROM market_finds GROUP BY 1""")
def src4_sound_and_broken_pages(t):
    """The market's pages twice, once cut off in the middle: each lands in the items or in quarantine, and none in both."""
    both = whole_and_cut(feeds.market_pages(t.spark, t.sf_dir, "market_finds"))
    landed = market.items_and_broken(both).groupBy("card_name")
    counts = landed.agg(F.count_if(F.col("reason").isNull()).alias("n"), F.count_distinct("itemId").alias("items"), F.count("reason").alias("broken"))
    return counts.filter("n = broken").select("card_name", "n", "items")


def whole_and_cut(pages: DataFrame) -> DataFrame:
    """Each page twice, once cut off in the middle."""
    bodies = F.array("body", F.expr("left(body, length(body) div 2)"))
    return pages.select(*[F.explode(bodies).alias("body") if c == "body" else c for c in pages.columns])


def by_card(t: Tables) -> clustered.Clustered:
    """Printings, prices and history stored by card."""
    made = clustered.Clustered(t.spark, fresh_path(t.spark, "by-card"), "card_id", 32)
    clustered.store_prices_by_card(made, t.printings, t.store_prices, t.price_history)
    return made


@query(sql=SQL["qry3_printings_with_prices"])
def qry3_clustered_prices(t):
    """From tables stored by card: joined and nested without a shuffle."""
    made, shops = by_card(t), t.stores
    return made.each_part(lambda read: price_lines(prices.printings_with_prices(read("printings"), read("store_prices"), shops)))


@query(sql=SQL["qry4_price_history"])
def qry4_clustered_history(t):
    """From tables stored by card: both the card's series and those of its printings without a shuffle."""
    made = by_card(t)
    return made.each_part(lambda read: history_lines(prices.history_bundle(read("printings"), read("price_history"))))


@query("market_finds", " SELECT card_name, count(*) AS found, count(*) AS broken FROM market_finds GROUP BY 1")
def str1_quarantined_pages(t):
    """The market's pages come in as a stream, each twice and once of these cut off in the middle: what each search found and lost."""
    store, landed = market_stream.Store(t.spark, fresh_path(t.spark, "market")), fresh_path(t.spark, "market-pages")
    pages = feeds.market_pages(t.spark, t.sf_dir, "market_finds")
    whole_and_cut(pages).write.option("compression", "zstd").parquet(landed)
    stream = ingest.read_stream(t.spark, landed, pages.schema)
    query, statistics = market_stream.ingest(stream, t.printings, t.cards, store, fresh_path(t.spark, "market-state"), AS_OF)
    statistics.wait(query)
    lost = store.quarantine.read().groupBy("card_name").agg(F.count("*").alias("broken"))
    return store.finds.read().groupBy("card_name").agg(F.sum("n").alias("found")).join(lost, "card_name", "full_outer")
