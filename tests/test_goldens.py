"""Golden rows of the feeds, the text functions, the matcher and the snapshots."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricewell.functions import text
from pricewell.operators import matching, prices, schedule, snapshots
from pricewell.plans import jobs
from pricewell.sources import catalogue, market, store_a, store_b, tables

TITLES = [
    ("MTG Magic Lightning Bolt M11 NM Foil x1", "Lightning Bolt M11", "Magic 2011", True, "NM"),
    ("Magic The Gathering - Jace, the Mind Sculptor - JTMS - Worldwake - NM", "Jace, the Mind Sculptor JTMS", "Worldwake", False, "NM"),
    ("BLACK LOTUS Alpha MTG Magic Rare HP 1x", "BLACK LOTUS Alpha", "Limited Edition Alpha", False, "HP"),
    ("Lightning bolt x4 playset mtg near mint", "Lightning bolt", None, False, "NM"),
    ("PSA 9 Black Lotus Alpha MTG", None, None, None, None),
    ("MTG Mystery Lot 100 cards bulk", None, None, None, None),
    ("Counterspell Unlimited Edition NM", "Counterspell", "Unlimited Edition", False, "NM"),
    ("Ragavan Nimble Pilferer MH2 NM foil", "Ragavan Nimble Pilferer MH2", None, True, "NM"),
    ("Wrenn and Six Modern Horizons 2 LP", "Wrenn and Six Modern Horizons 2", None, False, "LP"),
    ("Thassa's Oracle Theros Beyond Death NM", "Thassa's Oracle Beyond Death", "Theros", False, "NM"),
]


def test_market_titles(spark):
    page = {"itemSummaries": [{"itemId": str(k), "title": t[0], "price": {"value": "10", "currency": "AUD"}, "condition": "Used", "itemWebUrl": "u", "buyingOptions": ["FIXED_PRICE"]} for k, t in enumerate(TITLES)]}
    found = market.items(spark.createDataFrame([(json.dumps(page), 0), ("{}", 1)], "body string, search_rank int"))
    got = {r["itemId"]: r for r in market.judged(found).collect()}
    assert len(got) == len(TITLES)
    for k, (_, name, set_name, foil, condition) in enumerate(TITLES):
        r = got[str(k)]
        if name is None:
            assert r["skip_reason"] == "title"
        else:
            assert (r["skip_reason"], r["raw_name"], r["set_name"], r["is_foil"], r["condition"], r["price"]) == (None, name, set_name, foil, condition, Decimal("10.00"))


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (text.name_key, "Éowyn, Lady - of // Rohan", "eowyn lady of rohan"), (text.name_key, "Æther Vial", "ther vial"), (text.name_key, "稲妻", ""),
    (text.name_key, "ñandú café", "nandu cafe"), (text.strip_variant, "Ajani, Outland Chaperone (Borderless 284)", "Ajani, Outland Chaperone"),
    (text.strip_variant, "Lightning Bolt [SLD]", "Lightning Bolt"), (text.strip_variant, "A (b) [c] (d)", "A"), (text.strip_variant, "b([)[]", "b("),
    (text.number_prefix, "149", 149), (text.number_prefix, "12a", 12), (text.number_prefix, "s5", None), (text.number_prefix, None, None),
    (store_a.collector_number, "/cards/Lightning_Bolt/M11/149", "149"), (store_a.collector_number, "/cards/B/M11/305:foil", "305"), (store_a.collector_number, "/cards/", None),
    (prices.thumbnail, "a/normal/b/normal/c", "a/small/b/normal/c"),
])
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want


def test_accents_against_unicode(spark):
    import re
    import unicodedata

    r = random.Random(1)
    xs = ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x300, 0x370), r.randrange(0x1E00, 0x1F00)])) for _ in range(12)) for _ in range(300)]
    want = [re.sub("[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", x)).lower()).strip() for x in xs]
    got = [x[0] for x in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x string").orderBy("k").select(text.name_key(F.col("x"))).collect()]
    assert got == want


def test_trend_and_tiers(spark):
    d = spark.createDataFrame([(10.20, 10.0), (10.10, 10.0), (9.80, 10.0), (1.0, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in d.select(prices.trend(F.col("a"), F.col("b"))).collect()] == ["up", "neutral", "down", None, None]
    d = spark.createDataFrame([("2001-10-06", 0.0), ("2001-10-05", 0.0), ("2001-08-06", 20.0), ("2001-08-06", 2.0), ("2001-08-06", 1.99)], "r string, u double")
    assert [r[0] for r in d.select(schedule.tier(F.col("r").cast("date"), F.col("u"), "2001-11-05")).collect()] == ["hot", "active", "active", "longTail", "skip"]


def test_due_is_strict(spark):
    cards = spark.createDataFrame([(x, x) for x in "abcd"], "id string, name string")
    printings = spark.createDataFrame([(x, "2001-11-01") for x in "abcd"], "card_id string, r string").select("card_id", F.col("r").cast("date").alias("released_at"), F.lit(None).cast("decimal(12,2)").alias("usd_price"))
    log = spark.createDataFrame([("a", "2001-11-04", 3), ("b", "2001-11-03", 3), ("c", "2001-10-22", 0), ("d", "2001-10-21", 0)], "card_name string, d string, last_result_count int").withColumn("last_searched_at", F.col("d").cast("date"))
    assert {r["card_name"] for r in schedule.due_cards(cards, printings, log, "2001-11-05").collect()} == {"b", "d"}


def shop_b(spark, title, variant, tags=(), options=("Condition",)):
    p = {"id": 1, "title": title, "handle": "h", "product_type": "Single", "tags": list(tags), "options": [{"name": o, "values": []} for o in options], "variants": [{"id": 1, "price": "3.50", "inventory_quantity": 1, **variant}]}
    return store_b.listings(spark.createDataFrame([(json.dumps({"products": [p]}),), ("{}",)], "body string")).collect()


def test_shop_b(spark):
    r = shop_b(spark, "Spider-Man 2099 (0216) ()", {"title": "Near Mint Foil", "option1": "Near Mint Foil", "available": False})[0]
    assert (r["raw_name"], r["collector_number"], r["is_foil"], r["in_stock"]) == ("Spider-Man 2099", "216", True, False)
    assert not r["set_name"]
    r = shop_b(spark, "Helm's Deep - Shinka, the Bloodsoaked Keep [The LotR: Commander]", {"title": "Near Mint / Non-Foil"}, options=("Title",))[0]
    assert (r["raw_name"], r["set_name"], r["is_foil"], r["in_stock"]) == ("Shinka, the Bloodsoaked Keep", "The LotR: Commander", False, True)
    r = shop_b(spark, "Lightning Bolt Borderless - Magic 2011", {"title": "Default Title"}, tags=["x", "Set: M11"])[0]
    assert (r["raw_name"], r["set_name"], r["is_borderless"], r["condition"]) == ("Lightning Bolt", "M11", True, "NM")
    for title in ("Bolt Showcase", "Forest // Forest", "Goblin Token"):
        assert not shop_b(spark, title, {"title": "NM", "option1": "NM"})
    assert not shop_b(spark, "Bolt", {"title": "LP", "option1": "Lightly Played"})
    assert not shop_b(spark, "Bolt", {"title": "NM", "option1": "NM", "price": "0"})


def test_shop_a(spark):
    e = {"uuid": "u", "name": "Bolt", "price": 800, "set_name": "", "set_code": "m11", "quantity": 0, "finish": "Foil", "condition": "Regular", "link_path": "/cards/B/M11/305:foil"}
    r = store_a.listings(spark.createDataFrame([(json.dumps({"uuid_data": {"u": e}}),), ("{}",)], "body string")).collect()
    assert len(r) == 1
    assert (r[0]["price"], r[0]["set_name"], r[0]["condition"], r[0]["is_foil"], r[0]["in_stock"], r[0]["collector_number"]) == (Decimal("8.00"), None, "NM", True, False, "305")


CARDS = [("L", "Lightning Bolt"), ("S", "Solo")]
PRINTINGS = [("a", "L", "m11", "Magic 2011", "149", False), ("a_foil", "L", "m11", "Magic 2011", "149", True), ("b", "L", "2x2", "Double", "117", False), ("c", "L", "sld", "Lair", "901", False), ("s_foil", "S", "x", "X", "7", True)]
LISTINGS = [
    ("Lightning Bolt", "m11", None, "149", True, False, "a_foil", "set_collector", 1.0), ("Lightning Bolt", "m11", None, None, False, False, "a", "exact", 1.0),
    ("Lightning Bolt", None, None, None, True, False, "a_foil", "name_foil", 0.85), ("Lightning Bolt", None, None, None, False, False, "b", "name_foil", 0.7),
    ("Lightning Bolt", None, None, None, False, True, "c", "name_foil", 0.7), ("Lightning Bolt (Showcase 9)", "zzz", None, None, False, False, "b", "name_foil", 0.7),
    ("Solo", None, None, None, False, False, "s_foil", "name_only", 0.7), ("Lightnin Bolt", None, None, None, False, False, "b", "fuzzy", 0.8),
    ("Lightning Blot", None, None, None, False, False, "b", "fuzzy", 0.6), ("Counterspell", None, None, None, False, False, None, "unmatched", 0.0),
    ("Lightning Bolt", None, "MAGIC 2011", None, False, False, "a", "exact", 1.0),
]


def catalogue_frames(spark):
    return spark.createDataFrame(PRINTINGS, "id string, card_id string, set_code string, set_name string, collector_number string, is_foil boolean"), spark.createDataFrame(CARDS, "id string, name string")


def test_matching(spark):
    printings, cards = catalogue_frames(spark)
    d = spark.createDataFrame([(k, *x[:6]) for k, x in enumerate(LISTINGS)], "listing_seq long, raw_name string, set_code string, set_name string, collector_number string, is_foil boolean, is_borderless boolean")
    got = sorted(matching.match_listings(d, printings, cards).collect(), key=lambda r: r["listing_seq"])
    assert [(r["printing_id"], r["match_type"], r["confidence"]) for r in got] == [x[6:] for x in LISTINGS]
    sure = matching.match_listings(d, printings, cards, min_confidence=0.75).filter("match_type = 'name_foil'").collect()
    assert {r["printing_id"] for r in sure} == {"a_foil"}


def test_near_keys_lose_nothing(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab ") for _ in range(r.randrange(0, 9)))
    keys, probes = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    k, p = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame([(x,) for x in probes], "probe string")
    want = {(r["probe"], r["key"]) for r in p.crossJoin(k).filter(F.levenshtein("probe", "key") <= 2).collect()}
    assert {(r["probe"], r["key"]) for r in matching.near_keys(p, k).collect()} == want


HISTORY = "printing_id string, store_id string, price_type string, recorded_at date, price_aud decimal(12,2)"


def test_history_first_wins_and_is_idempotent(spark):
    empty = spark.createDataFrame([], HISTORY)
    batch = spark.createDataFrame([("p", "s", "sell", "5.00", 1), ("p", "s", "sell", "4.00", 2)], "printing_id string, store_id string, price_type string, v string, listing_seq long").select("printing_id", "store_id", "price_type", F.lit("2001-01-01").cast("date").alias("recorded_at"), F.col("v").cast("decimal(12,2)").alias("price_aud"), "listing_seq")
    once = snapshots.append_history(empty, batch)
    assert [r["price_aud"] for r in once.collect()] == [Decimal("5.00")]
    assert [r["price_aud"] for r in snapshots.append_history(once, batch).collect()] == [Decimal("5.00")]


def test_replace_clears_a_store_without_rows(spark):
    old = spark.createDataFrame([("p", "1"), ("q", "2")], "printing_id string, store_id string")
    ran = spark.createDataFrame([("1",)], "store_id string")
    assert [r["store_id"] for r in snapshots.replace_store(old, old.limit(0), ran).collect()] == ["2"]


def test_upsert_is_idempotent_and_keeps_columns(spark):
    old = spark.createDataFrame([("a", "s1", 1), ("b", "s2", 2)], "id string, set_code string, usd_price int")
    new = spark.createDataFrame([("a", "zz", None), ("c", "s3", 3)], "id string, set_code string, usd_price int")
    want = {("a", "s1", None), ("b", "s2", 2), ("c", "s3", 3)}
    once = snapshots.upsert(old, new, ["id"], ["usd_price"])
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in snapshots.upsert(once, new, ["id"], ["usd_price"]).collect()} == want


def test_catalogue(spark, tmp_path):
    card = {"id": "1", "oracle_id": "o", "name": "N", "lang": "en", "layout": "normal", "digital": False, "set": "s", "set_name": "S", "collector_number": "1", "rarity": "r", "finishes": ["nonfoil", "foil", "etched"], "prices": {"usd": "1.5", "usd_foil": None}, "card_faces": [{"image_uris": {"normal": "f"}}]}
    rows = [card, card | {"name": "Second"}, card | {"id": "2", "lang": "ja"}, card | {"id": "3", "layout": "token"}, card | {"id": "4", "oracle_id": ""}, card | {"id": "5", "digital": True}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    made = jobs.refresh_catalogue(catalogue.read_catalogue(spark, str(tmp_path / "c.json")))
    assert [(r["id"], r["name"], r["type_line"], r["colors"]) for r in made["cards"].collect()] == [("o", "N", "Unknown", [])]
    got = {r["id"]: r for r in made["printings"].collect()}
    assert set(got) == {"1", "1_foil"}
    assert (got["1"]["usd_price"], got["1"]["image_uri"], str(got["1"]["released_at"])) == (Decimal("1.50"), "f", "1993-01-01")


def test_feeds_union_and_shops(spark):
    e = {"uuid": "u", "name": "Bolt", "price": 100, "set_name": "S", "set_code": "s", "quantity": 1, "finish": "", "condition": "Odd", "link_path": "/x/1"}
    landed = {"mtg_mate": spark.createDataFrame([(json.dumps({"uuid_data": {"u": e}}),)], "body string"), "nobody": spark.createDataFrame([("x",)], "body string")}
    assert [(r["source"], r["condition"]) for r in tables.union_feeds(landed).collect()] == [("mtg_mate", "Odd")]
    ok, missing = tables.runnable_stores(tables.store_dimension(spark), tables.registered_adapters(spark))
    assert {r["id"] for r in ok.collect()} == {"mtg_mate", "good_games"}
    assert {r["id"] for r in missing.collect()} == {"ebay_au"}


def test_market_refresh(spark):
    printings, cards = catalogue_frames(spark)
    old = spark.createDataFrame([("a", "ebay_au", 1), ("s_foil", "ebay_au", 2), ("a", "other", 3)], "printing_id string, store_id string, p int").select("printing_id", "store_id", F.col("p").cast("decimal(12,2)").alias("price_aud"), F.lit("sell").alias("price_type"), F.lit("NM").alias("condition"), F.lit(True).alias("in_stock"), F.lit("").alias("url"))
    item = {"itemId": "i", "title": "Solo NM foil", "price": {"value": "9", "currency": "AUD"}, "itemWebUrl": "u", "buyingOptions": ["FIXED_PRICE"]}
    pages = spark.createDataFrame([("Solo", 1, json.dumps({"itemSummaries": [item, item]}))], "card_name string, search_rank int, body string")
    searched = spark.createDataFrame([("Solo", "ok"), ("Lightning Bolt", "failed")], "card_name string, status string")
    tabs = {"printings": printings, "cards": cards, "store_prices": old, "price_history": spark.createDataFrame([], HISTORY), "unmatched_cards": spark.createDataFrame([], "store_id string, raw_name string, raw_set_name string, raw_price decimal(12,2), source_url string"), "search_log": spark.createDataFrame([], "card_name string, last_searched_at date, last_result_count int")}
    made = jobs.refresh_market(pages, searched, tabs, "2001-11-05")
    assert {(r["printing_id"], r["store_id"], int(r["price_aud"])) for r in made["store_prices"].collect()} == {("a", "ebay_au", 1), ("a", "other", 3), ("s_foil", "ebay_au", 9)}
    assert [(r["card_name"], r["last_result_count"]) for r in made["search_log"].collect()] == [("Solo", 2)]
    s = made["statistics"].first()
    assert (s["fetched"], s["duplicates"], s["matched"], s["match_percent"]) == (2, 1, 1, "100.0")


def test_stream_equals_batch(spark, tmp_path):
    from pricewell.streaming import ingest

    printings, cards = catalogue_frames(spark)
    d = spark.createDataFrame([(k, f"i{k % 9}", *x[:6]) for k, x in enumerate(LISTINGS)], "listing_seq long, item_id string, raw_name string, set_code string, set_name string, collector_number string, is_foil boolean, is_borderless boolean")
    d = d.withColumns({"price": F.lit("2.00").cast("decimal(12,2)"), "store_id": F.lit("s"), "price_type": F.lit("sell"), "condition": F.lit("NM"), "in_stock": F.lit(True), "source_url": F.lit(""), "ts": F.lit("2001-11-05").cast("timestamp")})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    d.coalesce(1).write.parquet(src)
    snapshots.write_history(spark.createDataFrame([], HISTORY), out)
    for _ in range(2):
        stream = ingest.items_once(ingest.read_stream(spark, src, d.schema))
        ingest.ingest_history(stream, printings, cards, out, str(tmp_path / "state"), "2001-11-05").awaitTermination()
    got = {(r["printing_id"], str(r["recorded_at"])) for r in spark.read.parquet(out).collect()}
    _, history, _ = matching.split_matches(matching.match_listings(d, printings, cards), "2001-11-05")
    assert got == {(r["printing_id"], str(r["recorded_at"])) for r in snapshots.new_history(spark.createDataFrame([], HISTORY), history).collect()}
