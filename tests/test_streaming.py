"""The streams lose nothing: late and repeated items over several runs, batches that break off, statistics of every batch."""

import json

import pytest
from pyspark.sql import functions as F

from pricewell.functions.rules import MARKET_STORE
from pricewell.operators import matching, published, quality, snapshots
from pricewell.operators.published import Table
from pricewell.sources import market as market_source
from pricewell.sources.schemas import TABLES
from pricewell.streaming import ingest, market

DAY = "2001-11-05"
SHAPE = "listing_seq long, item_id string, raw_name string, ts string"


def name(k):
    return f"Wandering {chr(97 + k % 26) * 4} {chr(97 + k // 26) * 4}"


def catalogue(spark):
    cards = spark.createDataFrame([(f"c{k}", name(k)) for k in range(40)], "id string, name string")
    printings = cards.select(F.concat(F.lit("p"), F.col("id")).alias("id"), F.col("id").alias("card_id"), F.lit("s").alias("set_code"), F.lit("Set").alias("set_name"), F.lit("1").alias("collector_number"), F.lit(False).alias("is_foil"))
    return printings, cards


def listings(spark, rows):
    d = spark.createDataFrame(rows, SHAPE).withColumn("ts", F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("string")
    return d.withColumns({"set_code": none, "set_name": none, "collector_number": none, "is_foil": F.lit(False), "is_borderless": F.lit(False), "price": (F.col("listing_seq") + 1).cast("decimal(12,2)"), "store_id": F.lit("s"), "price_type": F.lit("sell"), "condition": F.lit("NM"), "in_stock": F.lit(True), "source_url": F.lit("")})


def test_late_and_repeated_listings_over_restarts(spark, tmp_path):
    """Files whose days go back and forth over years: every item gets in, and gets in once."""
    printings, cards = catalogue(spark)
    days = ["2001-11-05", "2001-11-01", "1999-01-01", "2001-11-06", "2000-02-02"]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, day in enumerate(days):
        new = [(k * 10 + j, f"i{k * 6 + j}", name(k * 6 + j), day) for j in range(6)]
        old = [(k * 10 + 6 + j, f"i{j}", name(j + 30), day) for j in range(min(4, k * 6))]  # an item's id again, with another name
        d = listings(spark, new + old)
        d.coalesce(1).write.mode("append").parquet(src)
        stream = ingest.items_once(ingest.read_stream(spark, src, d.schema))
        ingest.ingest_history(stream, printings, cards, out, state, DAY).awaitTermination()
    got = spark.read.schema(TABLES["price_history"]).parquet(out).collect()
    assert sorted(r["printing_id"] for r in got) == sorted(f"pc{k}" for k in range(30))
    assert {r["printing_id"]: int(r["price_aud"]) for r in got}["pc7"] == 12


def page(rank, card, items):
    made = [{"itemId": i, "title": title, "price": {"value": value, "currency": "AUD"}, "condition": "Used", "itemWebUrl": f"u/{i}", "buyingOptions": ["FIXED_PRICE"]} for i, title, value in items]
    return rank, card, json.dumps({"itemSummaries": made})


PAGES = "search_rank long, card_name string, body string"
FIRST = [page(1, name(1), [("a", name(1) + " NM", "5"), ("b", name(2), "6"), ("a", name(1) + " NM", "4")]), page(2, name(3), [("b", name(3), "1"), ("c", "PSA 9 " + name(3), "2")])]
SECOND = [page(3, name(1), [("a", name(9), "7"), ("d", name(1), "3")]), page(4, name(4), []), page(5, name(5), [("e", "Nobody knows this", "3"), ("f", name(5) + " foil", "1")])]
THIRD = [page(6, name(3), [("c", name(3), "8"), ("g", name(3), "9")])]


def run(spark, store, src, state, pages, cards=None):
    d = spark.createDataFrame(pages, PAGES)
    d.coalesce(1).write.mode("append").parquet(src)
    again(spark, store, src, state)


def again(spark, store, src, state):
    printings, cards = catalogue(spark)
    query, statistics = market.ingest(ingest.read_stream(spark, src, spark.read.parquet(src).schema), printings, cards, store, state, DAY)
    statistics.wait(query)


def batch_job(spark, pages):
    """history and statistics of all pages as one batch."""
    printings, cards = catalogue(spark)
    found = market_source.items(spark.createDataFrame(pages, PAGES))
    judged = market_source.judged(market_source.first_seen(found, ["search_rank", "item_pos"]))
    kept = market_source.kept(judged).withColumns({"store_id": F.lit(MARKET_STORE), "listing_seq": F.col("search_rank") * 1_000_000 + F.col("item_pos")})
    matched = matching.match_listings(kept, printings, cards)
    history = snapshots.new_history(spark.createDataFrame([], TABLES["price_history"]), matching.split_matches(matched, DAY)[1])
    counts = cards.select(F.col("name").alias("card_name")).join(found.groupBy("card_name").agg(F.count("itemId").alias("n")), "card_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows(history, snapshots.HISTORY_KEY), tuple(quality.run_statistics(found, judged, matched, counts).first())


def rows(df, columns):
    return sorted(map(repr, df.select(*columns, "price_aud").collect()))


def made(spark, store):
    searched = catalogue(spark)[1].select(F.col("name").alias("card_name"))
    return rows(store.history.read(), snapshots.HISTORY_KEY), tuple(market.run_statistics(store, searched).first())


def test_market_pages_over_restarts_are_those_of_one_batch(spark, tmp_path):
    store, src, state = market.Store(spark, f"file://{tmp_path}/m"), str(tmp_path / "in"), str(tmp_path / "state")
    for k, pages in enumerate((FIRST, SECOND, THIRD)):
        run(spark, store, src, state, pages)
        assert store.statistics.read().count() == k + 1
    want = batch_job(spark, FIRST + SECOND + THIRD)
    assert made(spark, store) == want
    fetched, duplicates, skipped, matched, unmatched, percent, searches, empty = want[1]
    assert (fetched, duplicates, skipped, unmatched) == (11, 4, 1, 1) and searches == 40 and empty == 37
    again(spark, store, src, state)  # a run without new files
    assert made(spark, store) == want and store.seen.read().count() == 7


@pytest.mark.parametrize("broken", ["price_history", "seen"])
def test_a_batch_that_breaks_off_is_made_good(spark, tmp_path, monkeypatch, broken):
    store, src, state = market.Store(spark, f"file://{tmp_path}/m"), str(tmp_path / "in"), str(tmp_path / "state")
    run(spark, store, src, state, FIRST)
    right = Table.append

    def append(self, rows, source=None, number=0):
        if self.path.endswith(broken):
            raise OSError("the write broke off")
        return right(self, rows, source, number)

    monkeypatch.setattr(Table, "append", append)
    with pytest.raises(Exception, match="broke off"):
        run(spark, store, src, state, SECOND)
    monkeypatch.setattr(Table, "append", right)
    again(spark, store, src, state)
    assert made(spark, store) == batch_job(spark, FIRST + SECOND)


def test_items_and_history_past_retention_go(spark, tmp_path):
    store, src, state = market.Store(spark, f"file://{tmp_path}/m"), str(tmp_path / "in"), str(tmp_path / "state")
    run(spark, store, src, state, FIRST)
    market.forget(store, "2003-11-30")
    assert store.seen.read().count() == 3 and store.history.read().count() == 2
    market.forget(store, "2003-12-01")
    assert store.seen.read().count() == 0 and store.history.read().count() == 0
    assert isinstance(store.seen.layout, published.Months)


def test_broken_pages_go_to_quarantine_once_and_the_rest_comes_in(spark, tmp_path):
    store, src, state = market.Store(spark, f"file://{tmp_path}/m"), str(tmp_path / "in"), str(tmp_path / "state")
    rank, card, body = FIRST[0]
    cut, blank, none, odd = [(rank, card, b) for b in (body[:-9], " ", None, body[:-1] + ', "total": "many"}')]
    run(spark, store, src, state, FIRST + [cut, blank])
    run(spark, store, src, state, SECOND + [none, odd])
    again(spark, store, src, state)
    got = store.quarantine.read().orderBy("reason", F.col("broken_body").asc_nulls_first()).collect()
    assert [(r.broken_body, r.reason) for r in got] == [(None, "empty"), (" ", "empty"), *((b, "not JSON of a page") for b in sorted([cut[2], odd[2]]))]
    assert [r.broken for r in store.statistics.read().orderBy("batch").collect()] == [2, 2]
    pages = FIRST + [cut, blank] + SECOND + [none, odd]
    assert made(spark, store) == batch_job(spark, pages)
    market.forget(store, "2003-12-01")
    assert store.quarantine.read().isEmpty()
