"""Many searches by grams against a scan; near keys by removed characters and parts against all pairs; counted medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pricewell.operators import matching, prices, search
from pricewell.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_find_what_a_scan_finds(spark):
    r = random.Random(2)
    names = ["".join(r.choice("abcAB %_\\é-") for _ in range(r.randrange(0, 12))) for _ in range(400)] + [None, ""]
    asked = ["".join(r.choice("abA%_\\é-") for _ in range(r.randrange(0, 6))) for _ in range(150)] + ["%", "_", "", "  ", "%%", "ab%_c", "a_b", "\\%", "zzz"]
    asked = [q for q in asked if not q.endswith("\\") and "\\" not in q.replace("\\%", "").replace("\\_", "").replace("\\\\", "")]
    cards = spark.createDataFrame(list(enumerate(names)), "id int, name string").cache()
    searches = spark.createDataFrame([(q, b) for q in set(asked) for b in (False, True)], "query string, literal boolean")
    got = {}
    for q, b, k in search.search_all(cards, searches).collect():
        got.setdefault((q, b), set()).add(k)
    for q in set(asked):
        for b in (False, True):
            want = {x["id"] for x in prices.find_cards(cards, q, b).collect()} if q.strip() else set()
            assert got.get((q, b), set()) == want, (q, b)


def test_a_search_looks_at_the_names_of_its_rarest_gram(spark):
    cards = spark.range(5_000).select("id", F.concat(F.lit("the common name "), F.col("id").cast("string")).alias("name"))
    index = search.gram_index(cards).cache()
    sizes = search.gram_sizes(index)
    asked = spark.createDataFrame([("common name 4321", True), ("THE%4_21", False)], "query string, literal boolean")
    each = asked.withColumn("gram", F.explode(search.asked_grams(F.col("query"), F.col("literal")))).join(sizes, "gram")
    rarest = {x["query"]: x["df"] for x in each.groupBy("query").agg(F.min("df").alias("df")).collect()}
    assert rarest["common name 4321"] < 30 and rarest["THE%4_21"] < 1_500
    found = search.search_all(cards, asked, index, sizes).collect()
    assert sorted((x["query"], x["id"]) for x in found) == [("THE%4_21", 4021), ("THE%4_21", 4121), ("THE%4_21", 4221), ("THE%4_21", 4321), ("THE%4_21", 4421), ("THE%4_21", 4521), ("THE%4_21", 4621), ("THE%4_21", 4721), ("THE%4_21", 4821), ("THE%4_21", 4921), ("common name 4321", 4321)]


@pytest.mark.parametrize("lengths", [(0, 5), (3, 12), (7, 16)])
def test_near_keys_of_all_lengths(spark, lengths):
    r = random.Random(sum(lengths))
    word = lambda: "".join(r.choice("abcd ") for _ in range(r.randrange(*lengths)))
    keys, probes = sorted({word() for _ in range(250)}), sorted({word() for _ in range(120)})
    k, p = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame([(x,) for x in probes], "probe string")
    want = {(x["probe"], x["key"]) for x in p.crossJoin(k).filter(F.levenshtein("probe", "key") <= 2).collect()}
    assert {(x["probe"], x["key"]) for x in matching.near_keys(p, k).collect()} == want


def test_short_keys_have_few_candidates(spark):
    """Of all keys of four letters out of twelve a probe meets some hundreds, near as many as are within the distance."""
    letters = "abcdefghijkl"
    keys = spark.createDataFrame([(a + b + c + d,) for a in letters for b in letters for c in letters for d in letters[:6]], "key string")
    probes = spark.createDataFrame([("abcd",), ("kkac",), ("lhda",)], "probe string")
    met = matching.near_candidates(probes, keys)
    near = matching.near_keys(probes, keys)
    assert met.count() <= 1.2 * near.count() < 0.1 * 3 * keys.count()


def test_large_blocks_are_dealt_over_slots(spark, monkeypatch):
    keys = spark.range(4_000).select(F.concat(F.lit("commonpart"), F.md5(F.col("id").cast("string")).substr(1, 9)).alias("key"))
    probes = keys.limit(5).withColumnRenamed("key", "probe")
    assert matching.near_keys(probes, keys).filter("dist = 0").count() == 5
    monkeypatch.setattr(matching, "HOT", 2.0)  # no block is large then
    assert matching.near_keys(probes, keys).filter("dist = 0").count() == 5


def test_listings_without_names_are_spread(spark):
    d = spark.range(3_000).select(F.col("id").alias("listing_seq"), F.lit(None).cast("string").alias("raw_name"), F.lit(None).cast("string").alias("set_name"), F.lit(None).cast("string").alias("collector_number"), F.lit(False).alias("is_foil"), F.lit(1).alias("price"))
    cards = spark.createDataFrame([("c", "Name")], "id string, name string")
    printings = spark.createDataFrame([("p", "c", "s", "S", "1", False)], "id string, card_id string, set_code string, set_name string, collector_number string, is_foil boolean")
    got = matching.match_listings(d, printings, cards)
    assert got.count() == 3_000 and {r[0] for r in got.select("match_type").distinct().collect()} == {"unmatched"}


def test_counted_medians(spark):
    r = random.Random(9)
    rows = [(k, r.choice([None, r.randrange(1, 9), r.randrange(1, 10_000)])) for k in "abc" for _ in range(r.randrange(1, 90))] + [("one", 5), ("two", 1), ("two", 2), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v int").withColumn("price_aud", (F.col("v") / 100).cast("decimal(12,2)"))
    medians = prices.counted_medians(d, ["k"])
    got = {x["k"]: (x["low"], x["high"], x["median"]) for x in medians.collect()}
    old = {x["k"]: (x["low"], x["high"], x["m"]) for x in d.groupBy("k").agg(F.min("price_aud").alias("low"), F.max("price_aud").alias("high"), prices.median("price_aud").alias("m")).filter("m is not null").collect()}
    assert got == old and set(got) == {"a", "b", "c", "one", "two"}
    assert got["a"][2] == pytest.approx(statistics.median(v / 100 for k, v in rows if k == "a" and v is not None))
    assert "ObjectHashAggregate" not in plan(medians)


def test_the_level_of_the_name_alone_is_reached(spark):
    got = {r["match_type"]: r["count"] for r in registry.queries()["jon6_other_finish"](spark, SF).groupBy("match_type").count().collect()}
    assert got.get("name_only", 0) > 10
