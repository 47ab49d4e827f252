"""Stored tables in parts: only touched parts are read and written, readers keep whole versions, months go, small files merge."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricewell import storage
from pricewell.operators import published, snapshots
from pricewell.operators.published import Buckets, Conflict, Months, Table
from pricewell.sources.schemas import TABLES

PRICES = "printing_id STRING, store_id STRING, price_aud DECIMAL(12,2), price_type STRING, condition STRING, in_stock BOOLEAN"


def prices(spark, stores, n=60, price="1.00"):
    d = spark.range(n * len(stores))
    names = F.array(*[F.lit(s) for s in stores])
    return d.select(F.concat(F.lit("p"), (F.col("id") % n).cast("string")).alias("printing_id"), F.element_at(names, (F.col("id") % len(stores) + 1).cast("int")).alias("store_id"), F.lit(price).cast("decimal(12,2)").alias("price_aud"), F.lit("sell").alias("price_type"), F.lit("NM").alias("condition"), F.lit(True).alias("in_stock"))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/prices", PRICES, Buckets({"store_id": 7, "printing_id": 3}))
    t.append(prices(spark, ["a", "b", "c", "d", "e"], 60))
    return t


def files_by_part(t, version):
    return {p: t.folders(version, {p}) for p in version.parts}


def test_a_store_is_replaced_in_its_own_parts(spark, table):
    before, old = table.version(), table.read()
    new, ran = prices(spark, ["b"], 5, "9.00"), spark.createDataFrame([("b",), ("gone",)], "store_id string")
    want = rows(snapshots.replace_store(old, new, ran))
    touched = table.touched(ran, before)
    assert 0 < len(touched) < len(before.parts)
    read = table.read(touched, before).inputFiles()
    assert read and all(any(f"_part={p}/" in x for p in touched) for x in read)
    after = table.replace_store(new, ran)
    assert rows(table.read()) == want
    a, b = files_by_part(table, before), files_by_part(table, after)
    assert {p: f for p, f in a.items() if p not in touched} == {p: f for p, f in b.items() if p not in touched}
    assert all(a[p] != b.get(p) for p in touched)
    assert rows(old) == rows(prices(spark, ["a", "b", "c", "d", "e"], 60))  # who has the old version still reads it


def test_an_empty_batch_clears_its_store(spark, table):
    table.replace_store(prices(spark, ["b"], 1).limit(0), spark.createDataFrame([("b",)], "store_id string"))
    assert {r[0] for r in table.read().select("store_id").distinct().collect()} == {"a", "c", "d", "e"}


def test_a_failed_write_leaves_the_old_table(spark, table):
    before = rows(table.read())
    with pytest.raises(Exception, match="on purpose"):
        table.change(spark.createDataFrame([("a",)], "store_id string"), lambda old: old.withColumn("price_type", F.when(F.col("printing_id") == "p7", F.raise_error(F.lit("on purpose"))).otherwise("x")))
    assert rows(table.read()) == before and table.version().number == 1
    table.clean()
    assert len(storage.listed(spark, f"{table.path}/data")) == 1 and rows(table.read()) == before


def test_of_two_changes_that_meet_one_fails(spark, table):
    def meanwhile(old):
        table.append(prices(spark, ["f"], 2))
        return old.limit(0)

    with pytest.raises(Conflict):
        table.change(spark.createDataFrame([("a",)], "store_id string"), meanwhile)
    assert {r[0] for r in table.read().select("store_id").distinct().collect()} == set("abcdef")


def test_rows_cannot_get_into_untouched_parts(spark, table):
    one = lambda s: spark.createDataFrame([(s,)], "store_id string")
    other = next(s for s in "bcde" if not table.touched(one(s), table.version()) & table.touched(one("a"), table.version()))
    with pytest.raises(ValueError, match="untouched"):
        table.change(one("a"), lambda old: old.withColumn("store_id", F.lit(other)))


def test_upsert_by_key(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/p", "id STRING, set_code STRING, usd_price INT", Buckets({"id": 16}))
    old = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("set_code"), F.col("id").cast("int").alias("usd_price"))
    t.append(old)
    new = spark.createDataFrame([("3", "zz", 1), ("new", "n", None)], "id string, set_code string, usd_price int")
    before = t.version()
    for _ in range(2):
        t.upsert(new, ["id"], ["usd_price"])
        assert rows(t.read()) == rows(snapshots.upsert(old, new, ["id"], ["usd_price"]))
    same = [p for p, f in before.parts.items() if t.version().parts.get(p) == f]
    assert len(same) >= len(before.parts) - 2


def test_only_the_stores_own_prices_are_cleared(spark, table):
    printings = spark.range(60).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), (F.col("id") % 2).cast("string").alias("card_id"))
    cards = spark.createDataFrame([("0", "Zero"), ("1", "One")], "id string, name string")
    searched = spark.createDataFrame([("One",)], "card_name string")
    want = rows(snapshots.clear_cards(table.read(), printings, cards, searched, "c"))
    before = table.version()
    table.clear_cards(printings, cards, searched, "c")
    assert rows(table.read()) == want and len(want) == 300 - 30
    changed = {p for p in before.parts if table.version().parts.get(p) != before.parts[p]}
    assert 0 < len(changed) <= 3


def history(spark, days):
    d = spark.createDataFrame([(f"p{k}", d) for d in days for k in range(30)], "printing_id string, d string")
    return d.select("printing_id", F.lit("s").alias("store_id"), F.lit("1.00").cast("decimal(12,2)").alias("price_aud"), F.lit("sell").alias("price_type"), F.col("d").cast("date").alias("recorded_at"))


def test_months_go_and_small_files_merge(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/h", TABLES["price_history"], Months("recorded_at"))
    days = ["1999-09-30", "1999-11-04", "1999-11-05", "2001-11-01", "2001-11-02", "2001-11-03"]
    for d in days:
        t.append(history(spark, [d]))
    all_rows = t.read()
    assert {p: len(s) for p, s in t.sizes(t.version()).items()} == {"1999-09": 1, "1999-11": 2, "2001-11": 3}
    merged = t.compact()
    assert {p: len(s) for p, s in t.sizes(merged).items()} == {"1999-09": 1, "1999-11": 1, "2001-11": 1}
    assert rows(t.read()) == rows(all_rows) and t.compact().number == merged.number
    published.retain(t, "2001-11-05")
    assert set(t.version().parts) == {"1999-11", "2001-11"}
    want = snapshots.retained(history(spark, days), "2001-11-05")
    assert rows(snapshots.retained(t.read(), "2001-11-05")) == rows(want)
    gone = t.clean()
    left = [f for w, _, _ in storage.listed(spark, f"{t.path}/data") for f, _, folder in storage.listed(spark, f"{t.path}/data/{w}") if folder]
    assert gone and sorted(left) == ["_part=1999-11", "_part=2001-11"] and rows(snapshots.retained(t.read(), "2001-11-05")) == rows(want)


def test_large_files_stay_and_large_parts_are_split(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/h", TABLES["price_history"], Months("recorded_at"))
    wide = spark.range(30_000).select(F.md5(F.col("id").cast("string")).alias("printing_id"), F.md5((F.col("id") + 1).cast("string")).alias("store_id"), F.lit("1.00").cast("decimal(12,2)").alias("price_aud"), F.lit("sell").alias("price_type"), F.lit("2001-11-04").cast("date").alias("recorded_at"))
    for k in range(6):
        t.append(wide.filter(F.col("printing_id").substr(1, 1) == F.lit(f"{k}")))
    sizes = t.sizes(t.version())["2001-11"]
    target = sum(sizes) // 2
    assert 1 < len(t.sizes(t.compact(target))["2001-11"]) < 6
    number = t.version().number
    t.compact(min(t.sizes(t.version())["2001-11"]) // 4)
    assert t.version().number == number


def test_additions_of_a_source_count_once(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/h", TABLES["price_history"], Months("recorded_at"))
    for n in (0, 0, 1, 0, 1):
        t.append(history(spark, ["2001-11-01"]), "stream", n)
    assert t.read().count() == 60 and t.version().marks == {"stream": 1}
    assert t.read().agg(F.sum("price_aud")).first()[0] == Decimal(60)
