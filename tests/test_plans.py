"""Plans and orders: pruned history, spread writes, stable arrival numbers, stems of patterns."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pricewell.functions import rules, text
from pricewell.operators import matching, prices, schedule, snapshots
from pricewell.plans import feeds
from pricewell.sources import catalogue, market, store_a, store_b, tables
from pricewell.sources.schemas import MARKET_PAGE, STORE_A_PAYLOAD, STORE_B_PAGE, TABLES

HISTORY = TABLES["price_history"]


def history(spark, days, shops=3):
    rows = [(f"p{k}", f"s{k % shops}", "sell", d, k) for d in days for k in range(40)]
    d = spark.createDataFrame(rows, "printing_id string, store_id string, price_type string, d string, k int")
    return d.select("printing_id", "store_id", F.col("k").cast("decimal(12,2)").alias("price_aud"), "price_type", F.col("d").cast("date").alias("recorded_at"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_days_batch_reads_its_month_only(spark, tmp_path):
    path = str(tmp_path / "history")
    snapshots.write_history(history(spark, ["2001-09-03", "2001-10-03", "2001-11-03", "2001-11-04"]), path)
    stored = spark.read.schema(HISTORY + ", recorded_month STRING").parquet(path)
    batch = history(spark, ["2001-11-04", "2001-11-04"]).withColumn("listing_seq", F.lit(1)).unionByName(history(spark, ["2001-11-04"]).withColumns({"listing_seq": F.lit(2), "store_id": F.lit("new")}))
    new = snapshots.new_history(stored, batch, ("2001-11-04", "2001-11-04"))
    assert {r["store_id"] for r in new.collect()} == {"new"} and new.count() == 40
    scan = next(x for x in plan(new).splitlines() if "PartitionFilters: [isnotnull" in x)
    assert "recorded_month" in scan.split("PartitionFilters: ")[1].split("]")[0]
    snapshots.write_history(new, path)
    assert snapshots.new_history(spark.read.schema(HISTORY + ", recorded_month STRING").parquet(path), batch, ("2001-11-04", "2001-11-04")).count() == 0


def test_a_months_rows_are_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        d = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("printing_id"), F.lit("s").alias("store_id"), F.lit("1.00").cast("decimal(12,2)").alias("price_aud"), F.lit("sell").alias("price_type"), F.lit("2001-11-04").cast("date").alias("recorded_at"))
        snapshots.write_history(d, str(tmp_path / "h"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "h" / "recorded_month=2001-11").glob("part-*"))) > 1


@pytest.mark.parametrize("page", [True, False])
def test_arrival_numbers_do_not_depend_on_splits(spark, page):
    a = [(json.dumps({"uuid_data": {f"u{k}{j}": {"name": f"n{k}{j}", "price": 100, "quantity": 1} for j in range(3)}}), k) for k in range(20)]
    b = [(json.dumps({"products": [{"title": f"t{k}", "handle": "h", "variants": [{"title": "NM", "price": "1", "option1": "NM"}] * 2}] * 2}), k) for k in range(20)]
    for rows, read in ((a, store_a.listings), (b, store_b.listings)):
        d = spark.createDataFrame(rows, "body string, page long")
        d = d if page else d.drop("page")
        got = [sorted((r["listing_seq"], r["raw_name"]) for r in read(d.repartition(n)).collect()) for n in (2, 7)]
        assert got[0] == got[1] and len({x for x, _ in got[0]}) == len(got[0]) > 20


def test_stems_are_in_every_match():
    patterns = [*rules.SKIP_TITLES, rules.FOIL_WORD, *(p for p, _ in rules.TITLE_SETS + rules.TITLE_CONDITIONS), r"a|b", r"(x)?yz", r"ab?c"]
    found = {p: text.stem(p) for p in patterns}
    assert found[r"a|b"] is None and found[r"(x)?yz"] == "yz" and found[r"ab?c"] is None
    assert sum(v is None for v in found.values()) < 12
    r = random.Random(2)
    words = sorted({w for p in patterns for w in re.findall("[a-z0-9%]+", re.sub(r"\\[a-z]", " ", p))})
    for _ in range(4_000):
        title = "".join(r.choice(words) + r.choice(["", " ", " ", "s", "-"]) for _ in range(6))
        for p, s in found.items():
            if s and re.search(p, title, re.I):
                assert s in title.lower(), (p, s, title)


def test_word_boundaries_are_ascii_ones():
    """The patterns as handed to Java find what the same patterns with plain boundaries of ASCII words find."""
    patterns = [*rules.SKIP_TITLES, rules.FOIL_WORD, *rules.TITLE_NOISE, *(p for p, _ in rules.TITLE_SETS + rules.TITLE_CONDITIONS), r"\bx\s\b.", r"\b\d\b", r"a\b-\bb"]
    assert not any("\\b" in rules.ascii_words(p) for p in patterns)
    r = random.Random(4)
    words = sorted({w for p in patterns for w in re.findall("[a-z0-9%]+", re.sub(r"\\[a-z]", " ", p))})
    for _ in range(1_500):
        title = "".join(r.choice(words) + r.choice(["", " ", " ", "s", "-", "_", "é", "("]) for _ in range(6))
        for p in patterns:
            a, b = re.search(rules.ascii_words(p), title), re.search(p, title, re.I | re.A)
            assert (a and a.span()) == (b and b.span()), (p, title)


def test_search_prices_only_of_the_cards_found(spark):
    """The prices meet the printings found before they are aggregated."""
    cards = spark.createDataFrame([("a", "Ring"), ("b", "Sword")], "id string, name string").withColumn("type_line", F.lit("x"))
    printings = spark.createDataFrame([("1", "a", False), ("2", "b", False)], "id string, card_id string, is_foil boolean").withColumns({"released_at": F.lit("2001-01-01").cast("date"), "image_uri": F.lit("i")})
    sell = spark.createDataFrame([("1", "5.00", True, "sell"), ("1", "7.00", True, "sell"), ("2", "1.00", True, "sell")], "printing_id string, v string, in_stock boolean, price_type string").withColumn("price_aud", F.col("v").cast("decimal(12,2)"))
    past = history(spark, ["2001-01-01"]).limit(0)
    [r] = prices.search(cards, printings, sell, past, "ring").collect()
    assert (r["id"], r["market_price"], r["trend"]) == ("a", 6.0, None)
    tree = plan(prices.cheapest_printings(printings, sell)).splitlines()
    first = min(k for k, x in enumerate(tree) if "Join" in x)
    assert all("median" not in x for x in tree[first:])


def test_last_day_with_lag(spark):
    h = history(spark, ["2001-01-01", "2001-01-05", "2001-01-09"]).filter("printing_id in ('p1', 'p4')")
    h = h.withColumn("price_aud", (F.col("price_aud") + F.dayofmonth("recorded_at")).cast("decimal(12,2)"))
    mean = lambda lag: {r["store_id"]: r["past_price"] for r in prices.last_day_mean(h, "store_id", lag).collect()}
    assert mean(0) == {"s1": 11.5} and mean(3) == {"s1": 7.5} and mean(5) == {"s1": 3.5}


def test_small_operators(spark):
    assert catalogue.needs_import(spark.createDataFrame([], TABLES["cards"])) and not catalogue.needs_import(spark.createDataFrame([("a",)], "id string"))
    d = spark.createDataFrame([("a", "L", "S", 9.0, True), ("b", "L", "R", None, False), ("c", "L", "Q", 10.0, False)], "id string, card_id string, set_name string, low_price double, is_foil boolean")
    assert [r["id"] for r in prices.by_lowest(d).collect()] == ["a", "c", "b"]
    assert [(r["id"], r["place"]) for r in prices.placed(d, "card_id", prices.lowest_order()).orderBy("place").collect()] == [("a", 1), ("c", 2), ("b", 3)]
    priced = d.withColumn("price_aud", F.col("low_price").cast("decimal(12,2)")).withColumn("set_name", F.lit("S")).withColumn("is_foil", F.lit(False))
    assert [r["id"] for r in priced.orderBy(*prices.printing_order()).collect()] == ["a", "c", "b"]
    assert [r["id"] for r in priced.orderBy(*prices.printing_order(as_text=True)).collect()] == ["c", "a", "b"]
    assert tuple(prices.with_prices(d).first()) == (3, 2)
    assert [r["id"] for r in prices.pinned(d, F.col("is_foil"), "b").collect()] == ["a", "b"]
    assert [r["id"] for r in prices.pinned(d, F.col("is_foil"), None).collect()] == ["a"]
    pips = spark.createDataFrame([([],), (["W", "U"],)], "c array<string>").select(prices.colour_pips(F.col("c")).alias("p"))
    assert [r["p"] for r in pips.collect()] == [["C"], ["W", "U"]]
    due = spark.createDataFrame([("b", "hot", 1), ("a", "active", 2), ("a2", "hot", 1)], "card_name string, tier string, tier_rank int")
    assert [r["card_name"] for r in schedule.due_order(due).collect()] == ["a2", "b", "a"]
    assert {(r["card_name"], r["place"]) for r in schedule.due_places(due).collect()} == {("a2", 1), ("b", 2), ("a", 1)}


def test_matching_spreads_rows_without_set_or_number(spark):
    d = spark.range(5_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("raw_name"))
    keys = d.select(matching._or_nothing(F.lit(None).cast("string"), F.col("raw_name")).alias("k"))
    assert keys.distinct().count() > 500


def test_local_landing_folder_is_for_local_mode_only(spark, monkeypatch):
    class Far:
        sparkContext = type("C", (), {"master": "spark://host:7077"})
        conf = type("F", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        feeds.landing_dir(Far)


def test_a_json_array_is_read_by_lines(spark, tmp_path):
    """The rows of multiLine, from many tasks; what is no whole object is reported, not lost."""
    cards = [{"id": f"c{k}", "oracle_id": f"o{k}", "name": f'a "[{k}]", {{x}},]', "lang": "en", "digital": False, "finishes": ["foil"], "prices": {"usd": "1.00"}, "legalities": {"a": "b"}} for k in range(3_000)]
    (tmp_path / "c.json").write_text("[\n" + ",\n".join("  " + json.dumps(c) for c in cards) + "\n]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got, broken = catalogue.read_array(spark, str(tmp_path / "c.json"))
        assert got.rdd.getNumPartitions() > 4
        whole = catalogue.read_catalogue(spark, str(tmp_path / "c.json"))
        assert sorted(map(repr, got.drop("pos").collect())) == sorted(map(repr, whole.drop("pos").collect())) and broken.isEmpty()
        assert [r["id"] for r in got.orderBy("pos").collect()] == [c["id"] for c in cards]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("text", "ids", "broken"), [
    ('[{"id":"a"},{"id":"b"}]', ["a", "b"], 0), ('[{"id":"a"},\n{"id":"b"\n},\n{"id":"c"}]', ["a", "c"], 2), ("[]", [], 0), ("[\n\n]\n", [], 0),
    ('[\n{"id":"a"},\n7,\n"x",\n{"id":"b"},\n]', ["a", "b"], 2), ('﻿[ {"id":"a"} ]', ["a"], 0), ('[{"id":"a"}\n,{"id":"b"}\n]', ["a", "b"], 0), ('[null,\n{"id":"b"}]', ["b"], 1),
])
def test_odd_json_arrays(spark, tmp_path, text, ids, broken):
    (tmp_path / "c.json").write_text(text, encoding="utf-8")
    got, lines = catalogue.read_array(spark, str(tmp_path / "c.json"))
    assert [r["id"] for r in got.orderBy("pos").collect()] == ids and lines.count() == broken


def test_broken_pages_go_to_quarantine(spark):
    """Pages that don't parse are kept whole with the reason; sound ones, those without items too, are not."""
    sound = ['{"itemSummaries": []}', "{}", '{"itemSummaries": [{"itemId": "a", "title": "t"}]}', '{"other": 1}']
    bad = ['{"itemSummaries": [{"itemId": "a"', "<html>", "[1]", "", "  ", None, '{"itemSummaries": 3}']
    pages = spark.createDataFrame([(k, b) for k, b in enumerate(sound + bad)], "page int, body string")
    got = {r["page"]: r["reason"] for r in tables.broken_pages(pages, MARKET_PAGE).collect()}
    assert set(got) == set(range(4, 11)) and sorted(got.values()).count("empty") == 3
    assert market.items(pages).count() == 1
    for schema, body in ((STORE_A_PAYLOAD, '{"uuid_data": {}}'), (STORE_B_PAGE, '{"products": []}')):
        two = spark.createDataFrame([(body,), (body[:-3],)], "body string")
        assert [r["body"] for r in tables.broken_pages(two, schema).collect()] == [body[:-3]]


def test_integrity_counts_what_is_broken(spark):
    """Every rule against plain counts; one scan of a table for its own rules; the rows themselves in quarantine."""
    cards = spark.createDataFrame([("a", "A", "x"), ("a", "B", None), (None, None, "x")], "id string, name string, type_line string")
    day = F.lit("2001-01-01").cast("date")
    printings = spark.createDataFrame([("1", "a", "s"), ("1", "lost", "s"), ("2", None, None), ("3", "lost", "s")], "id string, card_id string, set_code string").withColumn("released_at", day)
    stores = spark.createDataFrame([("s",), ("t",)], "id string")
    prices_ = spark.createDataFrame([("1", "s", 1), ("9", "s", 1), ("9", "u", None), (None, "t", 2)], "printing_id string, store_id string, price_aud int").withColumn("price_type", F.lit("sell"))
    h = spark.createDataFrame([("1", "s"), ("1", "s"), ("9", "s"), ("9", "s"), ("2", "zz")], "printing_id string, store_id string").withColumns({"price_type": F.lit("sell"), "recorded_at": day})
    got = {(r["table"], r["rule"]): r["n"] for r in snapshots.integrity(cards, printings, stores, prices_, h).collect()}
    want = {("cards", "duplicate key"): 1, ("cards", "null id"): 1, ("cards", "null name"): 1, ("cards", "null type_line"): 1, ("printings", "duplicate key"): 1, ("printings", "orphan card_id"): 2, ("printings", "null card_id"): 1, ("printings", "null set_code"): 1, ("store_prices", "orphan printing_id"): 2, ("store_prices", "orphan store_id"): 1, ("store_prices", "null printing_id"): 1, ("store_prices", "null price_aud"): 1, ("price_history", "duplicate key"): 2, ("price_history", "orphan printing_id"): 2, ("price_history", "orphan store_id"): 1}
    assert {k: n for k, n in got.items() if n} == want and len(got) == 20
    rows = {(r["table"], r["rule"], r["key"], r["n"]) for r in snapshots.quarantine({"cards": cards, "printings": printings, "stores": stores, "store_prices": prices_, "price_history": h}).collect()}
    assert ("printings", "orphan card_id", '{"id":"3"}', 1) in rows and ("store_prices", "orphan printing_id", '{"printing_id":"9","store_id":"u"}', 1) in rows
