"""What readers ask of prices: search, trends, printings with prices, history, snapshots and tables.

Every query runs for all cards at once; a caller who wants one card filters by id, which reaches the scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE_SIZE, TABLE_PAGE, MOST_PRINTINGS = 20, 10, 8


def live_sell() -> Column:
    return F.col("in_stock") & (F.col("price_type") == "sell")


def median(price: Column | str) -> Column:
    """Exact continuous median as double."""
    c = F.col(price) if isinstance(price, str) else price
    return F.median(c.cast("double"))


def counted_medians(d: DataFrame, by: list[str], value: str = "price_aud") -> DataFrame:
    """by, low, high, median of `value`: the exact continuous median, as median() gives it, without a buffer of a group's values.

    Equal values of a group are counted first, within tasks too, so that a group of any size comes down to its distinct
    values, dealt over tasks; a running count then finds the one or two in the middle. Nulls don't count; groups of nulls
    only have none.
    """
    counts = d.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*by)
    run = counts.withColumns({"_upto": F.sum("_n").over(whole.orderBy(value)), "_all": F.sum("_n").over(whole)})
    holds = lambda rank: F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col(value).cast("double"))
    first, second = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    out = run.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max(holds(first)).alias("_a"), F.max(holds(second)).alias("_b"))
    return out.select(*by, "low", "high", (F.col("_a") * 0.5 + F.col("_b") * 0.5).alias("median"))


def trend(now: Column, past: Column) -> Column:
    """up over past * 1.01, down under past * 0.99, else neutral; null without either price."""
    return F.when(now.isNull() | past.isNull(), None).when(now > past * 1.01, "up").when(now < past * 0.99, "down").otherwise("neutral")


def name_like(query: str, literal: bool = False) -> Column | None:
    """Names that hold the query, whatever the case; % and _ are wildcards unless literal. None for a blank query."""
    if not query.strip():
        return None
    q = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else query
    return F.col("name").ilike(f"%{q}%")


def find_cards(cards: DataFrame, query: str, literal: bool = False) -> DataFrame:
    by = name_like(query, literal)
    return cards.limit(0) if by is None else cards.filter(by)


def count_cards(cards: DataFrame, query: str, literal: bool = False) -> DataFrame:
    return find_cards(cards, query, literal).agg(F.count("*").alias("n"))


def get_card(cards: DataFrame, card_id: str) -> DataFrame:
    return cards.filter(F.col("id") == card_id).select("id", "name", "mana_cost", "type_line", "oracle_text", "colors")


def printing_counts(cards: DataFrame, printings: DataFrame) -> DataFrame:
    """Every card with its number of printings, 0 included."""
    n = printings.groupBy("card_id").agg(F.count_distinct("id").alias("printing_count"))
    return cards.join(n.withColumnRenamed("card_id", "id"), "id", "left").withColumn("printing_count", F.coalesce("printing_count", F.lit(0)).cast("int"))


def newest_images(printings: DataFrame) -> DataFrame:
    """card_id, image_uri of the newest non-foil printing with an image, ties to the smaller id."""
    w = W.partitionBy("card_id").orderBy(F.desc_nulls_last("released_at"), "id")
    return printings.filter("image_uri is not null and not is_foil").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("card_id", "image_uri")


def cheapest_printings(printings: DataFrame, store_prices: DataFrame) -> DataFrame:
    """card_id, printing_id, min_price, market_price (median) of each card's cheapest live printing.

    Prices meet the given printings before they are aggregated, so those of other printings go no further; one aggregation
    gives both the minimum and the median.
    """
    d = store_prices.filter(live_sell()).select("printing_id", "price_aud").join(printings.select(F.col("id").alias("printing_id"), "card_id"), "printing_id")
    live = d.groupBy("card_id", "printing_id").agg(F.min("price_aud").alias("min_price"), median("price_aud").alias("market_price"))
    best = F.min_by(F.struct("printing_id", "min_price", "market_price"), F.struct("min_price", "printing_id"))
    return live.groupBy("card_id").agg(best.alias("b")).select("card_id", "b.*")


def last_day_mean(history: DataFrame, key: str, lag_days: int = 0) -> DataFrame:
    """key, past_price: the mean sell price of the key's last recorded day (lag_days before its end at the latest).

    Rows are summed by key and day first, within tasks too, as decimals; the last day is chosen among those sums.
    """
    days = history.filter("price_type = 'sell'").groupBy(key, "recorded_at").agg(F.sum("price_aud").cast("double").alias("s"), F.count("price_aud").alias("n"))
    if lag_days:
        days = days.withColumn("_end", F.max("recorded_at").over(W.partitionBy(key))).filter(F.col("recorded_at") <= F.date_sub("_end", lag_days))
    return days.groupBy(key).agg(F.max_by(F.col("s") / F.nullif("n", F.lit(0)), "recorded_at").alias("past_price"))


def search(cards: DataFrame, printings: DataFrame, store_prices: DataFrame, history: DataFrame, query: str, publish: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """id, name, type_line, printing_count, image_uri, market_price, trend of the cards found.

    publish (table, name) -> table, where given, writes the found cards' cheapest printings once, as both prices and history use them.
    """
    found = find_cards(cards, query)
    mine = printings.join(found.select(F.col("id").alias("card_id")), "card_id", "left_semi")
    best = cheapest_printings(mine, store_prices)
    best = publish(best, "best") if publish else best
    past = last_day_mean(history.join(best.select("printing_id"), "printing_id", "left_semi"), "printing_id")
    best = best.join(past, "printing_id", "left").select(F.col("card_id").alias("id"), "market_price", trend(F.col("market_price"), F.col("past_price")).alias("trend"))
    images = newest_images(mine).withColumnRenamed("card_id", "id")
    return printing_counts(found.select("id", "name", "type_line"), mine).join(images, "id", "left").join(best, "id", "left")


def page(found: DataFrame, offset: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page by name; there may be more if it is full."""
    return found.orderBy("name", "id").offset(offset).limit(size)


def has_more(shown: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return shown.agg((F.count("*") == size).alias("has_more"))


def card_trends(cards: DataFrame, printings: DataFrame, store_prices: DataFrame, history: DataFrame, lag_days: int = 0) -> DataFrame:
    """id, current_price (median over all live printings), past_price, trend of every card."""
    of = printings.select(F.col("id").alias("printing_id"), "card_id")
    now = store_prices.filter(live_sell()).join(of, "printing_id").groupBy("card_id").agg(median("price_aud").alias("current_price"))
    past = last_day_mean(history.join(of, "printing_id"), "card_id", lag_days)
    d = cards.select("id").join(now.withColumnRenamed("card_id", "id"), "id", "left").join(past.withColumnRenamed("card_id", "id"), "id", "left")
    return d.withColumn("trend", trend(F.col("current_price"), F.col("past_price")))


def priced_printings(printings: DataFrame, store_prices: DataFrame, stores: DataFrame) -> DataFrame:
    """Printings with all their prices and shops' names; printings without prices stay.

    Prices that name their card, as tables stored by card do, meet printings by it too.
    """
    s = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"))
    p = store_prices.withColumnRenamed("printing_id", "id").join(s, "store_id", "left")
    return printings.join(p, ["id", *(c for c in p.columns if c == "card_id")], "left")


def printings_with_prices(printings: DataFrame, store_prices: DataFrame, stores: DataFrame) -> DataFrame:
    """One row per printing with prices[] (store_name, price_aud, condition, in_stock) by price, and the lowest in stock.

    Only rows with a shop's name and a price are nested; unknown stock counts as none; the list may be empty.
    """
    d = priced_printings(printings, store_prices, stores)
    stock = F.coalesce("in_stock", F.lit(False))
    one = F.when(F.col("store_name").isNotNull() & F.col("price_aud").isNotNull(), F.struct("price_aud", "store_name", "condition", stock.alias("in_stock")))
    return d.groupBy(*printings.columns).agg(F.array_sort(F.collect_list(one)).alias("prices"), F.min(F.when(stock & F.col("store_name").isNotNull(), F.col("price_aud"))).alias("low_price"))


def printing_order(as_text: bool = False) -> list[Column]:
    """By set, foil and price; as_text compares prices as texts ('10.00' before '9.00')."""
    price = F.col("price_aud").cast("string") if as_text else F.col("price_aud")
    return [F.asc_nulls_last("set_name"), F.asc("is_foil"), price.asc_nulls_last(), F.asc("id")]


def lowest_order() -> list[Column]:
    """By the lowest price in stock; printings without come last, by set."""
    return [F.asc_nulls_last("low_price"), F.asc("set_name"), F.asc("id")]


def by_lowest(d: DataFrame) -> DataFrame:
    return d.orderBy(*lowest_order())


def daily_order() -> list[Column]:
    """Of daily prices: by day, set and foil."""
    return [F.asc("day"), F.asc("set_name"), F.asc("is_foil"), F.asc("printing_id")]


def placed(d: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """d with `place`, from 1 on within each `by`, in the given order."""
    return d.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def pinned(d: DataFrame, keep: Column, pin: str | None) -> DataFrame:
    """The printings that `keep` admits, and the pinned one."""
    return d.filter(keep | (F.col("id") == F.lit(pin))) if pin is not None else d.filter(keep)


def with_prices(d: DataFrame, *by: str) -> DataFrame:
    """How many printings there are and how many have a price in stock, by the given columns."""
    return d.groupBy(*by).agg(F.count("*").alias("printings"), F.count_if(F.col("low_price").isNotNull()).alias("with_prices"))


def default_images(d: DataFrame) -> DataFrame:
    """card_id, image_uri: the first non-foil printing with an image, else the first with one, in by_lowest() order."""
    order = F.struct(F.col("low_price").isNull(), "low_price", "set_name", "id")
    plain = F.min_by("image_uri", F.when(F.col("image_uri").isNotNull() & ~F.col("is_foil"), order))
    any_one = F.min_by("image_uri", F.when(F.col("image_uri").isNotNull(), order))
    return d.groupBy("card_id").agg(F.coalesce(plain, any_one).alias("image_uri"))


def thumbnail(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^(.*?)/normal/", "$1/small/")


def colour_pips(colors: Column) -> Column:
    return F.when(F.size(colors) == 0, F.array(F.lit("C"))).otherwise(colors)


def daily_prices(printings: DataFrame, history: DataFrame) -> DataFrame:
    """card_id, printing_id, set_name, set_code, is_foil, day, price: the day's lowest sell price over shops.

    History that names its card, as a table stored by card does, meets printings by it too.
    """
    p = printings.select(F.col("id").alias("printing_id"), "card_id", "set_name", "set_code", "is_foil")
    key = ["printing_id", *(c for c in history.columns if c == "card_id")]
    low = history.filter("price_type = 'sell'").groupBy(*key, F.col("recorded_at").alias("day")).agg(F.min("price_aud").alias("price"))
    return p.join(low, key).select("card_id", "printing_id", "set_name", "set_code", "is_foil", "day", "price")


def card_series(daily: DataFrame) -> DataFrame:
    return daily.groupBy("card_id", "day").agg(F.min("price").alias("price"))


def printing_series(daily: DataFrame, least: int = 2) -> DataFrame:
    """One row per printing with data[] (day, price) by day; printings with fewer than `least` days are left out."""
    d = daily.groupBy("card_id", "printing_id", "set_name", "set_code", "is_foil").agg(F.array_sort(F.collect_list(F.struct("day", "price"))).alias("data"))
    return d.filter(F.size("data") >= least)


def history_bundle(printings: DataFrame, history: DataFrame) -> DataFrame:
    """card_id, aggregate[], by_printing[] of every card with history."""
    daily = daily_prices(printings, history)
    total = card_series(daily).groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("day", "price"))).alias("aggregate"))
    each = printing_series(daily).groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("printing_id", "set_name", "set_code", "is_foil", "data"))).alias("by_printing"))
    return total.join(each, "card_id", "left")


def top_printings(daily: DataFrame, most: int = MOST_PRINTINGS) -> DataFrame:
    """card_id, printing_id, days, place: a card's printings with the most days (at least 2), ties to the smaller id."""
    n = daily.groupBy("card_id", "printing_id").agg(F.count("*").alias("days")).filter("days >= 2")
    return n.withColumn("place", F.row_number().over(W.partitionBy("card_id").orderBy(F.desc("days"), "printing_id"))).filter(F.col("place") <= most)


def price_pivot(daily: DataFrame, most: int = MOST_PRINTINGS) -> DataFrame:
    """card_id, day, p1..p8: a row per day, a column for each of the card's top printings, gaps null.

    The days of a printing are gathered, as many as its history keeps, so that the daily prices are worked out once both for
    the order of the printings and for their columns.
    """
    each = daily.groupBy("card_id", "printing_id").agg(F.collect_list(F.struct("day", "price")).alias("data")).filter(F.size("data") >= 2)
    place = F.row_number().over(W.partitionBy("card_id").orderBy(F.desc(F.size("data")), "printing_id"))
    d = each.withColumn("place", place).filter(F.col("place") <= most).select("card_id", "place", F.explode("data").alias("x")).select("card_id", "place", "x.*")
    return d.groupBy("card_id", "day").agg(*[F.min(F.when(F.col("place") == k, F.col("price"))).alias(f"p{k}") for k in range(1, most + 1)])


def chart_ranges(series: DataFrame) -> DataFrame:
    """card_id, low, high: [max(0, min - pad), max + pad] with a pad of 15 % of the spread, or 1; from 2 days on."""
    d = series.groupBy("card_id").agg(F.min(F.col("price").cast("double")).alias("a"), F.max(F.col("price").cast("double")).alias("b"), F.count("*").alias("n")).filter("n >= 2")
    pad = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) * 0.15).otherwise(1.0)
    return d.select("card_id", F.greatest(F.lit(0.0), F.col("a") - pad).alias("low"), (F.col("b") + pad).alias("high"))


def snapshots(printings: DataFrame, store_prices: DataFrame) -> DataFrame:
    """card_id, low, high, median_price of the prices in stock of any type, and usd, the lowest of non-foils.

    Cards with nothing in stock have no row.
    """
    of = printings.select(F.col("id").alias("printing_id"), "card_id")
    stock = store_prices.filter("in_stock").join(of, "printing_id").groupBy("card_id").agg(F.min("price_aud").alias("low"), F.max("price_aud").alias("high"), median("price_aud").alias("median_price"))
    usd = printings.groupBy("card_id").agg(F.min(F.when(~F.col("is_foil"), F.col("usd_price"))).alias("usd"))
    return stock.join(usd, "card_id", "left")


def price_table(d: DataFrame, foil: bool | None = None, sets: list[str] | None = None, shops: list[str] | None = None, in_stock_only: bool = False) -> DataFrame:
    """priced_printings() rows with a shop and price under the filters; None or an empty list admits all."""
    d = d.filter("store_name is not null and price_aud is not null").withColumn("in_stock", F.coalesce("in_stock", F.lit(False)))
    if foil is not None:
        d = d.filter(F.col("is_foil") == foil)
    if sets:
        d = d.filter(F.col("set_name").isin(sets))
    if shops:
        d = d.filter(F.col("store_name").isin(shops))
    return d.filter("in_stock") if in_stock_only else d


TABLE_ORDERS = {
    "price_asc": lambda: F.asc("price_aud"), "price_desc": lambda: F.desc("price_aud"),
    "newest": lambda: F.desc_nulls_last("released_at"), "oldest": lambda: F.asc_nulls_first("released_at"),
}


def table_page(rows: DataFrame, order: str = "price_asc", page: int = 0, size: int = TABLE_PAGE) -> DataFrame:
    ties = ["id", "store_id", "price_aud", F.asc_nulls_first("condition"), "in_stock"]
    return rows.orderBy(TABLE_ORDERS[order](), *ties).offset(page * size).limit(size)


def table_pages(rows: DataFrame, size: int = TABLE_PAGE) -> DataFrame:
    return rows.groupBy("card_id").agg(F.count("*").alias("n")).withColumn("pages", F.ceil(F.col("n") / size))


def shop_facets(rows: DataFrame) -> DataFrame:
    """card_id, store_name: the shops that list a card."""
    return rows.filter("store_name is not null and price_aud is not null").select("card_id", "store_name").distinct()


def set_facets(printings: DataFrame) -> DataFrame:
    """card_id, set_name, released_at (the set's latest), place by newest first."""
    d = printings.groupBy("card_id", "set_name").agg(F.max("released_at").alias("released_at"))
    return d.withColumn("place", F.row_number().over(W.partitionBy("card_id").orderBy(F.desc_nulls_last("released_at"), "set_name")))
