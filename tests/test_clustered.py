"""Tables stored by one key: no shuffle, point reads, hot keys beside the buckets, whole generations."""

import re

import pytest
from pyspark.sql import functions as F

from pricewell import storage
from pricewell.operators import clustered, prices
from pricewell.operators.clustered import Clustered, Layout
from pricewell.operators.published import Conflict

CARDS, PRINTINGS = 40, 400


@pytest.fixture(scope="module")
def tables(spark):
    """Card c0 has over a third of the printings; the last printing is of no card, and the last prices of no printing."""
    n = F.col("id")
    card = F.when(n % 3 == 0, "c0").when(n < PRINTINGS - 1, F.concat(F.lit("c"), (n % CARDS).cast("string")))
    printings = spark.range(PRINTINGS).select(
        F.concat(F.lit("p"), n.cast("string")).alias("id"), F.when(n == PRINTINGS - 1, None).otherwise(card).alias("card_id"),
        F.lit("set").alias("set_name"), F.lit("s").alias("set_code"), (n % 2 == 0).alias("is_foil"),
    )
    row = spark.range(6000).select(F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(PRINTINGS + 5)).cast("string")).alias("printing_id"), (n % 5).cast("string").alias("store_id"), (n % 97 + 1).cast("decimal(12,2)").alias("price_aud"), F.when(n % 4 == 0, "buylist").otherwise("sell").alias("price_type"), n)
    store_prices = row.select("printing_id", "store_id", "price_aud", "price_type", F.lit("NM").alias("condition"), (n % 2 == 0).alias("in_stock"))
    history = row.select("printing_id", "store_id", "price_type", F.date_add(F.lit("2001-01-01").cast("date"), (n % 50).cast("int")).alias("recorded_at"), "price_aud")
    stores = spark.range(5).select(n.cast("string").alias("id"), F.concat(F.lit("shop "), n).alias("name"))
    return {"printings": printings, "store_prices": store_prices, "history": history, "stores": stores}


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    made = Clustered(spark, f"file://{tmp_path_factory.mktemp('by-card')}", "card_id", 8, least=500)
    clustered.store_prices_by_card(made, tables["printings"], tables["store_prices"], tables["history"])
    return made


def rows(df):
    return sorted(map(repr, df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the one scan of df gave to the rest of its plan."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_rows_are_whole(tables, store):
    assert rows(store.read("printings")) == rows(tables["printings"])
    assert rows(store.read("store_prices").drop("card_id")) == rows(tables["store_prices"])
    assert rows(store.read("price_history").drop("card_id")) == rows(tables["history"])


def test_hot_keys_and_rows_without_one_lie_beside_the_buckets(spark, store):
    for name in ("printings", "store_prices", "price_history"):
        even = {r[0] for r in store.even(name).select("card_id").distinct().collect()}
        assert len(even) == CARDS - 1 and not even & {None, "c0"}
        assert {r[0] for r in store.hot(name).select("card_id").distinct().collect()} == {None, "c0"}
    folder = f"{store.path}/data/{store.generation()['name']}/even/store_prices"
    files = [n for n, _, _ in storage.listed(spark, folder) if n.endswith(".parquet")]
    buckets = [re.search(r"_(\d{5})\.", n)[1] for n in files]
    assert len(buckets) == len(set(buckets)) <= 8  # one file each


def test_joined_and_grouped_without_a_shuffle(tables, store):
    store.session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        even = prices.history_bundle(store.even("printings"), store.even("price_history"))
        assert "Exchange" not in plan(even) and plan(even).count("SortMergeJoin") == 3
        nested = prices.printings_with_prices(store.even("printings"), store.even("store_prices"), tables["stores"].hint("broadcast"))
        assert "SortMergeJoin" in plan(nested) and "Exchange hashpartitioning" not in plan(nested)
    finally:
        store.session.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_both_parts_give_what_the_plain_tables_give(tables, store):
    got = store.each_part(lambda read: prices.history_bundle(read("printings"), read("price_history")))
    assert rows(got) == rows(prices.history_bundle(tables["printings"], tables["history"]))
    got = store.each_part(lambda read: prices.printings_with_prices(read("printings"), read("store_prices"), tables["stores"]))
    want = prices.printings_with_prices(tables["printings"], tables["store_prices"], tables["stores"])
    assert rows(got) == rows(want)
    assert want.filter("card_id is null and size(prices) > 0").count() == 1  # the printing without a card keeps its prices


def test_the_callers_session_keeps_its_settings(spark, store):
    assert store.session.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_card_opens_one_bucket(store):
    d = store.even("store_prices").filter("card_id = 'c1'")
    bucket = F.pmod(F.hash("card_id"), F.lit(8))
    same = store.even("store_prices").filter(bucket == d.select(bucket).first()[0])
    assert 0 < d.count() < same.count() and scanned(d) == same.count() < store.even("store_prices").count()


def test_an_id_skips_row_groups_by_its_bloom_filter(spark, tmp_path):
    d = spark.range(16_000).select(F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("string")).alias("card_id"), F.xxhash64(F.col("id") + 7).cast("string").alias("printing_id"))
    one = F.col("printing_id") == d.first()[1]
    # without a dictionary, which would let row groups be skipped as well
    plain = (("parquet.enable.dictionary", "false"),)
    seen = {}
    for name, layout in {"with": Layout((), ("printing_id",), options=plain), "without": Layout(options=plain)}.items():
        made = Clustered(spark, f"file://{tmp_path}/{name}", "card_id", 16)
        made.store({"prices": (d, layout)})
        made.session.conf.set("spark.sql.adaptive.enabled", "false")
        assert made.read("prices").filter(one).count() == 1
        seen[name] = scanned(made.even("prices").filter(one))
    assert seen["without"] > 12_000 and seen["with"] < 4_000


def test_generations(spark, tmp_path):
    made = Clustered(spark, f"file://{tmp_path}/g", "k", 4)
    of = lambda n: {"t": (spark.range(n).select((F.col("id") % 3).alias("k"), F.col("id").alias("odd.name"), F.col("id").alias("_hot")), Layout(("odd.name",)))}
    assert made.store(of(0)) == 1
    assert made.read("t").count() == 0
    old = made.read("t", 1)
    assert made.store(of(10)) == 2
    assert (old.count(), made.read("t").count(), made.read("t", 1).count()) == (0, 10, 0)
    spark.sql(f"DROP TABLE clustered_{made.generation()['name']}_t")  # as for a new driver, whose catalogue knows nothing of it
    assert rows(Clustered(spark, made.path, "k", 4).read("t")) == rows(of(10)["t"][0])
    assert len(made.clean()) == 1 and made.read("t").count() == 10
    assert [n for n, _, _ in storage.listed(spark, f"{made.path}/manifest")] == ["0000000002.json"]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    made = Clustered(spark, f"file://{tmp_path}/g", "k", 2)
    d = {"t": (spark.range(4).withColumnRenamed("id", "k"), Layout())}
    made.store(d)
    monkeypatch.setattr(Clustered, "_last", lambda self: 0)
    with pytest.raises(Conflict):
        made.store(d)
    monkeypatch.undo()
    assert made.generation(1) == made.generation() and made.read("t").count() == 4
