"""Texts that rows share are worked out once each, not row by row."""

import json

from pyspark.sql import functions as F

from pricewell.operators import matching, snapshots
from pricewell.plans import registry
from pricewell.sources import market

LISTING = "listing_seq long, raw_name string, set_name string, collector_number string, is_foil boolean, price int, store_id string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_listings_are_worked_out_once(spark, tmp_path):
    cards = spark.createDataFrame([("c1", "Lightning Bolt"), ("c2", "Opt")], "id string, name string")
    printings = spark.createDataFrame([("p1", "c1", "s", "Set One", "1", False), ("p2", "c2", "t", "Set (Two)", "2", True)], "id string, card_id string, set_code string, set_name string, collector_number string, is_foil boolean")
    rows = [(1, "LIGHTNING bolt (x) [y]", None, None, False), (2, None, "set one", "1", False), (3, "Opt", "", "9", True), (4, "Lightnin Bolt", "Set One", None, True), (5, None, None, None, None), (6, "", "set two", "2", True), (7, "Nothing like it", None, None, False)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows * 50], LISTING)
    written = {}

    def publish(df, name):
        written[name] = snapshots.publish(df, str(tmp_path), name)
        return written[name]

    made = matching.match_listings(d, printings, cards, publish=publish)
    assert "regexp" not in plan(made) and "translate" not in plan(made)
    assert written["known"].count() == written["known"].select("_raw").distinct().count() == 5
    got = made.groupBy("listing_seq", "printing_id", "match_type").agg(F.count("*").alias("n")).orderBy("listing_seq").collect()
    want = [(1, "p1", "name_foil"), (2, "p1", "set_collector"), (3, "p2", "name_foil"), (4, "p1", "fuzzy"), (5, None, "unmatched"), (6, "p2", "set_collector"), (7, None, "unmatched")]
    assert [tuple(r) for r in got] == [(*w, 50) for w in want]
    plain = matching.match_listings(d, printings, cards)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, made.collect()))


def page(*items):
    return json.dumps({"itemSummaries": list(items)})


def item(k, title, value="5"):
    return {"itemId": k, "title": title, "price": {"value": value, "currency": "AUD"}, "buyingOptions": ["FIXED_PRICE"]}


BODIES = [page(item("a", "Opt NM Foil"), item("b", "Opt NM Foil", "0"), item(None, None)), page(), "{}", None, " ", page(item("c", "PSA 9 Opt"))[:-4], page(item("d", "PSA 9 Opt"))]


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame(list(enumerate(BODIES)), "search_rank long, body string")
    assert plan(market.items(pages)).count("from_json") == 1
    assert plan(market.items_and_broken(pages)).count("from_json") == 1
    found = market.items_and_broken(pages)
    good = market.items(pages.filter("search_rank <> 5")).select("search_rank", "item_pos", "itemId", "title").collect()
    assert sorted(map(repr, good)) == sorted(map(repr, found.filter("reason is null").select("search_rank", "item_pos", "itemId", "title").collect()))
    assert [(r[0], r[1], r[2]) for r in sorted(good)] == [(0, 0, "a"), (0, 1, "b"), (0, 2, None), (6, 0, "d")]
    assert {r.search_rank: r.reason for r in found.filter("reason is not null").collect()} == {3: "empty", 4: "empty", 5: "not JSON of a page"}


def test_titles_are_judged_once_each(spark, tmp_path):
    found = market.items(spark.createDataFrame(list(enumerate(BODIES)), "search_rank long, body string").filter("search_rank <> 5"))
    facts = snapshots.publish(market.title_facts(found), str(tmp_path), "titles")
    assert facts.count() == facts.select("_title").distinct().count() == 3
    made = market.judged(found, facts)
    assert "RLIKE" not in plan(made)
    got = {r.itemId: (r.raw_name, r.condition, r.is_foil, r.skip_reason) for r in made.collect()}
    assert got == {"a": ("Opt", "NM", True, None), "b": ("Opt", "NM", True, "price"), None: ("", None, False, "name"), "d": ("PSA 9 Opt", None, False, "title")}
    assert sorted(map(repr, made.collect())) == sorted(map(repr, market.judged(found).collect()))


def test_runs_are_written_once_in_order_and_whole(spark):
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    rows = t.listings.select("listing_seq")
    odd = spark.createDataFrame([(None,), (-1,), (1 << 60,)], "listing_seq long")
    path = registry.in_runs(t, rows.unionByName(odd), "listing_seq", 3)
    ends = [spark.read.parquet(f"{path}/_run={k}").agg(F.count("*"), F.min("listing_seq"), F.max("listing_seq")).first() for k in range(3)]
    assert sum(e[0] for e in ends) == rows.count() + 3
    assert ends[0][2] < ends[1][1] and ends[1][2] < ends[2][1]
    registry.land(spark, path, 0, f"{path}-landed/0", rows.schema)
    registry.land(spark, path, 0, f"{path}-landed/none", rows.schema)
    assert spark.read.schema("listing_seq long").parquet(f"{path}-landed/*").count() == ends[0][0]
